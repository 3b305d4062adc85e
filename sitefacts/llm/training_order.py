"""Token ids as fixed-stride binary shards in training order.

Documents become sequences of ``SEQUENCE`` ids (the last one of each padded). Sequences are numbered by the data alone: by
doc_id, text and place in the text, from counts per range of doc_id and their prefix sums. A keyed Feistel network over the
smallest even-bit domain, walked until it lands below the number of sequences, permutes the numbers into slots: every
sequence gets one slot, every slot one sequence, the same ones however the input is split. Shards hold consecutive slots at
a fixed stride, so slot s of a shard begins at byte (s - first) * stride; a reader that stopped at any slot resumes there.

The token table is written once to the cluster's shared folder, so texts are encoded once; ids are compressed until they
reach their shard. ``shards`` gives one row for each shard with its payload; ``write_shards`` writes these as binary files
with a manifest, each under a temporary name and then renamed, and leaves files alone that an earlier, interrupted call
finished; ``read_slots`` seeks in them.

Null and empty texts give no sequence. Repeated rows give repeated sequences; a null doc_id comes first. Other columns,
whatever their names, stay behind. Counts that reach the driver are one row for each range.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from array import array
from collections import Counter
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefacts.llm.common import cut, shared_folder, texts
from sitefacts.llm.pieces import model_path, vocabulary
from sitefacts.llm.sentencepiece_codec import MODEL

SEQUENCE, SHARD = 1024, 512
#: Shards that one task sorts and writes, at most about twice as many: a quarter of a GB each of 1 MB.
TASK_SHARDS = 256
#: Texts that are encoded together.
TOGETHER = 256
KEY = "epoch-1"
PAD = 0
ROUNDS = 6
NULL_ID = -(2**63)


def token_table(docs: DataFrame, model: str = MODEL, sequence: int = SEQUENCE) -> DataFrame:
    """``doc_id, of_text, task, copy, chunk, chunks, n_tokens, ids`` of every sequence.

    ``ids`` are packed little-endian integers, unpadded and compressed; ``of_text`` is a hash of the text; ``copy`` counts
    equal rows within a task.
    """

    def run(batches):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=model_path(model))
        itemsize = vocabulary(model_path(model)).dtype.itemsize
        code = "H" if itemsize == 2 else "I"
        width, task = itemsize * sequence, TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        copies: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                found = part.column(1).to_pylist()
                rows = []
                for doc_id, text, ids in zip(part.column(0).to_pylist(), found, library.encode(found, num_threads=1) if found else ()):
                    if not text:
                        continue
                    doc_id = NULL_ID if doc_id is None else doc_id
                    of_text = xxhash.xxh3_64_intdigest(text.encode()) - 2**63
                    packed = array(code, ids).tobytes()
                    chunks = -(-len(packed) // width)
                    for k in range(chunks):
                        piece = packed[k * width : (k + 1) * width]
                        rows.append((doc_id, of_text, task, copies[doc_id, of_text], k, chunks, len(piece) // itemsize, squeeze(piece)))
                    copies[doc_id, of_text] += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("of_text", pa.int64()), ("task", pa.int32()), ("copy", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary())])
    return texts(docs).mapInArrow(run, "doc_id long, of_text long, task int, copy long, chunk int, chunks int, n_tokens int, ids binary")


def numbered(tokens: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, of_text, task, first, copies, before`` of each text of each task, and how many sequences there are.

    Copy c of a text in a task and its chunk k have the number ``first + k * copies + before + c``.
    """
    texts_ = tokens.where("chunk = 0").groupBy("doc_id", "of_text", "task").agg(F.max("chunks").cast("long").alias("chunks"), F.count("*").alias("n"))
    ranged = cut(texts_.repartitionByRange("doc_id", "of_text").sortWithinPartitions("doc_id", "of_text", "task").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.sum(F.col("chunks") * F.col("n")).alias("n")).orderBy("part").collect()  # a row for each range
    offsets = dict(zip([r["part"] for r in counts], accumulate([0] + [r["n"] for r in counts])))

    def run(batches):
        at, key, held = None, None, []

        def told(held, at):
            copies = sum(r[4] for r in held)
            before = 0
            for doc_id, of_text, task, _, n in held:
                yield doc_id, of_text, task, at, copies, before
                before += n

        def rows():
            nonlocal at, key, held
            for batch in batches:
                for *row, part in zip(*(batch.column(k).to_pylist() for k in range(6))):
                    at = offsets[part] if at is None else at
                    if key != row[:2] and held:
                        yield from told(held, at)
                        at += held[0][3] * sum(r[4] for r in held)
                        held = []
                    key = row[:2]
                    held.append(row)
            yield from told(held, at)

        out = []
        for row in rows():
            out.append(row)
            if len(out) == 20_000:
                yield packed(out)
                out = []
        yield packed(out)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("of_text", pa.int64()), ("task", pa.int32()), ("first", pa.int64()), ("copies", pa.int64()), ("before", pa.int64())])
    one_each = ranged.select("doc_id", "of_text", "task", "chunks", "n", "part")
    return one_each.mapInArrow(run, "doc_id long, of_text long, task int, first long, copies long, before long"), sum(r["n"] for r in counts)


def feistel(numbers: np.ndarray, size: int, key: str = KEY) -> np.ndarray:
    """Slots below ``size`` of numbers below ``size``: a keyed permutation."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & mask)
        return (left << np.uint64(half)) | right

    out = once(numbers.astype("uint64"))
    while (beyond := np.flatnonzero(out >= size)).size:
        out[beyond] = once(out[beyond])
    return out.astype("int64")


def in_training_order(docs: DataFrame, model: str = MODEL, sequence: int = SEQUENCE, shard: int = SHARD, key: str = KEY) -> DataFrame:
    """``slot, shard, doc_id, chunk, n_tokens, ids`` (compressed), dealt by ranges of whole shards and sorted by slot."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_table(docs, model, sequence).write.option("compression", "uncompressed").parquet(path)
    tokens = spark.read.parquet(path)
    numbers, size = numbered(tokens)
    shards = -(-size // shard)

    @F.pandas_udf("long")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy("int64"), size, key))

    parts = max(1, min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // TASK_SHARDS)))
    number = F.col("first") + F.col("chunk") * F.col("copies") + F.col("before") + F.col("copy")
    out = tokens.join(numbers, ["doc_id", "of_text", "task"]).select(slot_of(number).alias("slot"), "doc_id", "chunk", "n_tokens", "ids")
    out = out.withColumn("shard", F.floor(F.col("slot") / shard).cast("long"))
    out = out.repartitionById(parts, F.floor(F.col("shard") * parts / max(1, shards)).cast("int"))
    return out.sortWithinPartitions("slot").select("slot", "shard", F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "chunk", "n_tokens", "ids")


def shards(docs: DataFrame, model: str = MODEL, sequence: int = SEQUENCE, shard: int = SHARD, key: str = KEY) -> DataFrame:
    """One row for each shard: ``shard, first_slot, n_sequences, stride, doc_ids, chunks, n_tokens, payload``."""

    def run(batches):
        dtype = vocabulary(model_path(model)).dtype
        pad = np.array([PAD], dtype).tobytes()
        stride = dtype.itemsize * sequence
        whole = zstandard.ZstdDecompressor().decompress
        rows: list[tuple] = []

        def packed():
            return pa.RecordBatch.from_pydict(
                {
                    "shard": [rows[0][1]], "first_slot": [rows[0][0]], "n_sequences": [len(rows)], "stride": [stride],
                    "doc_ids": [[r[2] for r in rows]], "chunks": [[r[3] for r in rows]], "n_tokens": [[r[4] for r in rows]],
                    "payload": [b"".join(whole(r[5]) + pad * (sequence - r[4]) for r in rows)],
                },
                schema=pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n_sequences", pa.int64()), ("stride", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("chunks", pa.list_(pa.int32())), ("n_tokens", pa.list_(pa.int32())), ("payload", pa.binary())]),
            )

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if rows and rows[0][1] != row[1]:
                    yield packed()
                    rows = []
                rows.append(row)
        if rows:
            yield packed()

    schema = "shard long, first_slot long, n_sequences long, stride long, doc_ids array<long>, chunks array<int>, n_tokens array<int>, payload binary"
    return in_training_order(docs, model, sequence, shard, key).mapInArrow(run, schema)


def _place(folder: str):
    """File system and path of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _name(shard: int) -> str:
    return f"shard-{shard:010d}.bin"


def write_shards(made: DataFrame, folder: str) -> DataFrame:
    """Write rows of ``shards`` as one file each and a manifest; returns the manifest, a row for each shard without its payload.

    A file of the right length and checksum is left as it is, so a call after a lost driver goes on where that one stopped;
    the result of an attempt that runs twice is the same file.
    """
    from pyarrow import fs

    def run(batches):
        place, root = _place(folder)
        place.create_dir(root, recursive=True)
        for batch in batches:
            checks = []
            for number, payload in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                payload = payload.as_buffer()
                checks.append(xxhash.xxh3_64_hexdigest(payload))
                path = f"{root}/{_name(number)}"
                info = place.get_file_info(path)
                if info.type != fs.FileType.NotFound and info.size == len(payload):
                    with place.open_input_stream(path) as held:
                        if xxhash.xxh3_64_hexdigest(held.read()) == checks[-1]:
                            continue
                partial = f"{path}.{uuid.uuid4().hex}"
                with place.open_output_stream(partial) as out:
                    out.write(payload)
                place.move(partial, path)
            keep = [batch.column(c) for c in ("shard", "first_slot", "n_sequences", "stride", "doc_ids", "chunks", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(checks, pa.string())], ["shard", "first_slot", "n_sequences", "stride", "doc_ids", "chunks", "n_tokens", "checksum"])

    written = made.mapInArrow(run, "shard long, first_slot long, n_sequences long, stride long, doc_ids array<long>, chunks array<int>, n_tokens array<int>, checksum string")
    written.write.mode("overwrite").parquet(f"{folder}/manifest")
    place, root = _place(folder)
    head = made.sparkSession.read.parquet(f"{folder}/manifest")
    first = head.agg(F.min(F.struct("shard", "n_sequences", "stride")).alias("x"), F.sum("n_sequences").alias("n")).first()
    with place.open_output_stream(f"{root}/layout.json") as out:
        shape = {"shard": first["x"]["n_sequences"], "stride": first["x"]["stride"], "slots": first["n"]} if first["x"] else {"shard": 0, "stride": 0, "slots": 0}
        out.write(json.dumps(shape).encode())
    return head


def read_slots(spark: SparkSession, folder: str, first: int, end: int) -> DataFrame:
    """``slot, ids`` of slots ``first`` to ``end`` (exclusive) of a folder of shards: each task seeks to its part of a file."""
    place, root = _place(folder)
    with place.open_input_stream(f"{root}/layout.json") as held:
        shape = json.loads(held.read())
    size, stride = shape["shard"], shape["stride"]
    first, end = max(0, first), min(end, shape["slots"])

    def run(batches):
        place, root = _place(folder)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                lo, hi = max(first, number * size), min(end, (number + 1) * size)
                with place.open_input_file(f"{root}/{_name(number)}") as file:
                    file.seek((lo - number * size) * stride)
                    held = file.read((hi - lo) * stride)
                yield pa.RecordBatch.from_arrays([pa.array(range(lo, hi), pa.int64()), pa.array([held[k : k + stride] for k in range(0, len(held), stride)], pa.binary())], ["slot", "ids"])

    wanted = spark.range(first // size, -(-end // size)) if first < end else spark.range(0)
    return wanted.mapInArrow(run, "slot long, ids binary")
