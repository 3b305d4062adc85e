"""Removal of repeated byte strings across documents, by suffix arrays of content-defined shards.

A string of ``SPAN`` bytes that also starts in a document of a smaller id goes from all others. Suffixes are sorted by
induced sorting (``suffix_array``), a shard at a time, and permuted common prefixes tell which of them share ``SPAN`` bytes.

1. Documents are written once as a bucketed table; all later passes over texts are co-located with it.
2. Each string of ``SPAN`` bytes is known by its anchor, the smallest hash of the 24-byte grams in it, so equal strings have
   equal anchors wherever they stand. Anchors are counted in blocks by 4-byte keys; a string whose anchor occurs in one
   document only has no equal elsewhere and is done. (A short key can only keep a string too many.)
3. What remains is cut into pieces, the stretches of one anchor (76 bytes at most). Equal pieces of a bucket are sent once,
   with their smallest id, to the anchor's shard: a passage of a third of all documents costs one piece a bucket. An anchor
   with many different pieces (a common phrase) is ``crowded``: its strings go one by one, dealt by their own bytes.
4. A shard sorts the suffixes of its pieces; suffixes that share ``SPAN`` bytes form a run, and the smallest id of a run is
   that of the string's first document. A bit for each string goes back to the bucket: whether a smaller id than the
   piece's own holds it.
5. Each bucket marks the bytes of its documents and cuts them out. Strings are judged on the input.

Shards and blocks are as many as the data asks for, so none grows with it. Pieces are told apart by 64-bit hashes.

Null text is empty; texts under ``SPAN`` bytes lose nothing. A null doc_id is smaller than all others, and rows of one id,
repeated rows too, never cut each other. No rows give no rows. Other columns stay behind.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import cut, shared_folder, texts
from sitefacts.llm.suffix_array import common_prefixes, suffix_array

SPAN, GRAM = 50, 24
#: Strings of ``SPAN`` bytes that one gram can stand for at most, and bytes of the longest piece.
STRINGS = SPAN - GRAM + 1
LONGEST = SPAN + STRINGS - 1
#: Bytes of texts in a bucket, buckets in a file, anchors in a block, bytes of pieces in a shard.
BUCKET_BYTES, IN_A_FILE, BLOCK_KEYS, SHARD_BYTES = 4_000_000, 4, 1_000_000, 2_000_000
#: Different pieces of an anchor in one bucket above which they are counted, and in all buckets above which it is crowded.
COUNTED, CROWDED = 3, 4096
#: Positions that are hashed at once.
STEP = 1 << 18
NULL_ID = -(2**63)

_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BYTES = np.random.default_rng(24).integers(0, 2**63, 256, dtype="int64").astype("uint64")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _SPREAD
    return h ^ (h >> np.uint64(29))


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_MIX), k, 2**64))


def _anchors(flat: np.ndarray) -> np.ndarray:
    """For each string of ``SPAN`` bytes of ``flat`` the smallest hash of its grams."""
    h, size = _BYTES[flat], 1
    held = {1: h}
    while size < 16:
        h = h[:-size] * _power(size) + h[size:]
        size *= 2
        held[size] = h
    n = len(flat) - GRAM + 1
    low = _mixed(held[16][:n] * _power(8) + held[8][16 : 16 + n])
    size = 1
    while 2 * size <= STRINGS:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(low) - STRINGS + size], low[STRINGS - size :])


def _places(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one anchor in texts laid end to end: start, strings, anchor, and number of the text."""
    sizes = np.diff(ends, prepend=0)
    last = np.repeat(ends - SPAN, sizes)
    starts, keys, counts = [], [], []
    for lo in range(0, len(flat) - SPAN + 1, STEP):
        found = _anchors(flat[lo : lo + STEP + SPAN - 1])
        at = np.arange(lo, lo + len(found))
        inside = at <= last[lo : lo + len(found)]
        new = np.append(True, (found[1:] != found[:-1]) | (last[lo + 1 : lo + len(found)] != last[lo : lo + len(found) - 1])) & inside
        begin = np.flatnonzero(new)
        held = np.append(0, np.cumsum(inside))
        starts.append(begin + lo)
        keys.append(found[begin])
        counts.append(held[np.append(begin[1:], len(found))[: len(begin)]] - held[begin])
    if not starts:
        none = np.empty(0, "int64")
        return none, none, none.astype("uint64"), none
    start, key, count = np.concatenate(starts), np.concatenate(keys), np.concatenate(counts)
    # A stretch that was cut by a step goes on.
    goes_on = np.append(False, (start[1:] % STEP == 0) & (key[1:] == key[:-1]) & (start[:-1] + count[:-1] == start[1:]) & (last[start[1:]] == last[start[:-1]]))
    first = np.flatnonzero(~goes_on)
    count = np.add.reduceat(count, first) if len(first) else count[:0]
    start, key = start[first], key[first]
    return start, count, key, np.searchsorted(ends, start, "right")


def _contents(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings at ``start``, none longer than ``LONGEST``."""
    width = -(-LONGEST // 8) * 8
    padded = np.append(flat, np.zeros(width, "uint8"))
    rows = np.lib.stride_tricks.as_strided(padded, (len(flat) + 1, width), (1, 1))
    out = np.empty(len(start), "uint64")
    for lo in range(0, len(start), 16384):
        part = rows[start[lo : lo + 16384]]
        size = length[lo : lo + 16384]
        part[np.arange(width) >= size[:, None]] = 0
        h = size.astype("uint64")
        for column in part.view("<u8").T:
            h = _mixed((h ^ column) * _MIX)
        out[lo : lo + 16384] = h
    return out


def _long_pieces(start, count, key, number):
    """Stretches of one repeated gram may be longer than a piece: cut every ``STRINGS`` strings."""
    if not len(count) or count.max() <= STRINGS:
        return start, count, key, number
    parts = -(-count // STRINGS)
    of = np.repeat(np.arange(len(start)), parts)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    return start[of] + turn * STRINGS, np.minimum(count[of] - turn * STRINGS, STRINGS), key[of], number[of]


def _block(key: np.ndarray, blocks: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _flat(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes laid end to end, and ends of a bucket's texts, in an order that hangs on the rows alone."""
    batch = batch.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    column = batch.column("text")
    column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    wide = pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], "int64" if wide else "int32", len(column) + 1 + column.offset)[column.offset :].astype("int64") if len(column) else np.zeros(1, "int64")
    data = column.buffers()[2] if len(column) else None
    flat = np.frombuffer(data, "uint8")[ends[0] : ends[-1]] if data is not None else np.empty(0, "uint8")
    return batch.column("doc_id").to_numpy(), flat, ends[1:] - ends[0]


def _split(order: np.ndarray, by: np.ndarray):
    """Pairs of a value of ``by`` and the members of ``order``, which is sorted by it, that have it."""
    if len(order):
        edges = np.flatnonzero(np.diff(by[order].astype("int64"))) + 1
        for members in np.split(order, edges):
            yield int(by[members[0]]), members


def _bucketed(docs: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int]:
    """``bucket, doc_id, text`` (bytes) as a table in the shared folder, a few buckets to a file, and the texts' bytes."""
    spark = docs.sparkSession
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    files = -(-buckets // IN_A_FILE)
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text")
    name = f"suffix_{uuid.uuid4().hex}"
    rows.repartition(files, "bucket").write.bucketBy(files, "bucket").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name), size


def _requests(rows: DataFrame, blocks: int) -> DataFrame:
    """Keys of each bucket's anchors by block: those of one document, those of several, and counts of crowded ones."""

    def run(batch: pa.Table) -> pa.Table:
        _, flat, ends = _flat(batch)
        start, count, key, number = _long_pieces(*_places(flat, ends))
        order = np.lexsort((number, key))
        line, who = key[order], number[order]
        new = np.append(True, line[1:] != line[:-1]) if len(line) else np.empty(0, bool)
        first = np.flatnonzero(new)
        several = np.zeros(len(line), bool)
        several[1:] = ~new[1:] & (who[1:] != who[:-1])
        several = np.logical_or.reduceat(several, first) if len(first) else several
        distinct, times = line[first], np.diff(np.append(first, len(line)))
        many = np.repeat(times > COUNTED, times)
        at = order[many]
        pairs = np.unique(np.stack([key[at], _contents(flat, start[at], count[at] + SPAN - 1)]), axis=1) if len(at) else np.empty((2, 0), "uint64")
        crowd, pieces = np.unique(pairs[0], return_counts=True)
        crowd, pieces = crowd[pieces > COUNTED], pieces[pieces > COUNTED]
        block, crowd_block = _block(distinct, blocks), _block(crowd, blocks)
        out = []
        for b, members in _split(np.argsort(block, kind="stable"), block):
            short = distinct[members].astype("uint32")
            held = np.flatnonzero(crowd_block == b) if len(crowd) else []
            out.append((b, short[~several[members]].tobytes(), short[several[members]].tobytes(), crowd[held].astype("uint32").tobytes(), pieces[held].astype("uint32").tobytes()))
        bucket = batch.column("bucket")[0].as_py()
        return pa.table(
            {"bucket": pa.array([bucket] * len(out), pa.int32()), "block": pa.array([x[0] for x in out], pa.int32())} | {c: pa.array([x[k] for x in out], pa.binary()) for k, c in enumerate(("keys", "common", "crowd", "pieces"), 1)}
        )

    return rows.groupBy("bucket").applyInArrow(run, "bucket int, block int, keys binary, common binary, crowd binary, pieces binary")


def _replies(requests: DataFrame, most: int) -> DataFrame:
    """For each bucket and block the keys that more than one document has, which of them are crowded, and about how many bytes follow."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda c: [np.frombuffer(x, "uint32") for x in table.column(c).to_pylist()]
        keys, common, crowd, pieces = map(read, ("keys", "common", "crowd", "pieces"))
        block = table.column("block")[0].as_py()
        found, where = np.unique(np.concatenate(keys + common), return_inverse=True)
        times = np.bincount(where, minlength=len(found))
        shared = times > 1
        shared[np.searchsorted(found, np.concatenate(common))] = True
        total = COUNTED * times
        np.add.at(total, np.searchsorted(found, np.concatenate(crowd)), np.concatenate(pieces).astype("int64"))
        crowded = shared & (total > most)
        out = []
        for bucket, own, several, many, n in zip(table.column("bucket").to_pylist(), keys, common, crowd, pieces):
            own = np.sort(np.concatenate([own, several]))
            at = np.searchsorted(found, own)
            own, hot = own[shared[at]], crowded[at][shared[at]]
            if len(own):
                size = LONGEST * int(np.maximum(n, COUNTED).sum()) + LONGEST * len(own) + STRINGS * SPAN * int(hot.sum())
                out.append((bucket, block, own.tobytes(), np.packbits(hot).tobytes(), size))
        kinds = (("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("bits", pa.binary()), ("size", pa.int64()))
        return pa.table({c: pa.array([x[k] for x in out], t) for k, (c, t) in enumerate(kinds)})

    return requests.groupBy("block").applyInArrow(run, "bucket int, part int, keys binary, bits binary, size long")


class _Bucket:
    """A bucket's documents and those of its pieces that other documents may hold."""

    def __init__(self, docs: pa.Table, replies: list[dict], blocks: int, shards: int):
        self.ids, self.flat, self.ends = _flat(docs)
        start, count, key, number = _long_pieces(*_places(self.flat, self.ends))
        known = [(np.uint64(r["part"]) << np.uint64(32)) | np.frombuffer(r["keys"], "uint32").astype("uint64") for r in replies]
        hot = [np.unpackbits(np.frombuffer(r["bits"], "uint8"), count=len(k)).astype(bool) for r, k in zip(replies, known)]
        known, hot = np.concatenate([np.empty(0, "uint64"), *known]), np.concatenate([np.empty(0, bool), *hot])
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        code = (_block(key, blocks) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
        at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
        shared = known[at] == code if len(known) else np.zeros(len(code), bool)
        crowded = hot[at] & shared if len(known) else shared
        plain, many = shared & ~crowded, np.flatnonzero(crowded)
        each = np.repeat(many, count[many])
        turn = np.arange(len(each)) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
        self.start = np.concatenate([start[plain], start[each] + turn])
        self.count = np.concatenate([count[plain], np.ones(len(each), "int64")])
        self.number = np.concatenate([number[plain], number[each]])
        content = _contents(self.flat, self.start, self.count + SPAN - 1)
        route = _mixed(np.concatenate([key[plain], content[plain.sum() :]]) * _MIX)
        content, first, self.piece = np.unique(content, return_index=True, return_inverse=True)
        self.first = first
        self.shard = ((route[first] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        self.least = np.full(len(first), 2**63 - 1, "int64")
        np.minimum.at(self.least, self.piece, self.ids[self.number])
        self.order = np.argsort(self.shard, kind="stable")

    def pieces(self):
        """Shard, bytes, strings and smallest ids of the pieces, a row for each shard."""
        for shard, members in _split(self.order, self.shard):
            at = self.first[members]
            size = self.count[at] + SPAN - 1
            take = np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            yield shard, self.flat[take].tobytes(), self.count[at].astype("uint8").tobytes(), self.least[members].tobytes()

    def removed(self, verdicts: list[dict]) -> np.ndarray:
        """Which bytes go, from a bit for each string of each piece."""
        bits = np.zeros(len(self.first), "uint32")
        by_shard = {v["part"]: np.frombuffer(v["bits"], "uint32") for v in verdicts}
        for shard, members in _split(self.order, self.shard):
            bits[members] = by_shard[shard]
        elsewhere = bits[self.piece]
        later = self.ids[self.number] > self.least[self.piece]
        of = np.repeat(np.arange(len(self.start)), self.count)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        gone = later[of] | ((elsewhere[of] >> turn.astype("uint32")) & 1).astype(bool)
        at = (self.start[of] + turn)[gone]
        edges = np.bincount(at, minlength=len(self.flat) + 1) - np.bincount(at + SPAN, minlength=len(self.flat) + 1)
        return np.cumsum(edges)[: len(self.flat)] > 0


def _verdicts(pieces: DataFrame) -> DataFrame:
    """For each bucket's row of pieces in a shard, a bit for each of their strings: whether a smaller id holds it."""

    def run(table: pa.Table) -> pa.Table:
        counts = [np.frombuffer(x, "uint8").astype("int64") for x in table.column("strings").to_pylist()]
        count = np.concatenate(counts)
        ids = np.concatenate([np.frombuffer(x, "int64") for x in table.column("ids").to_pylist()])
        flat = np.frombuffer(b"".join(table.column("bytes").to_pylist()), "uint8")
        size = count + SPAN - 1
        begin = np.cumsum(size) - size
        _, first, which = np.unique(_contents(flat, begin, size), return_index=True, return_inverse=True)
        least = np.full(len(first), 2**63 - 1, "int64")
        np.minimum.at(least, which, ids)
        # Pieces end to end, a 1 behind each and a 0 at the end; bytes that UTF-8 never has are read as one.
        room = size[first] + 1
        ends = np.cumsum(room)
        text = np.ones(ends[-1] + 1, "uint8")
        text[-1] = 0
        owner = np.repeat(np.arange(len(first)), room)
        offset = np.arange(ends[-1]) - (ends - room)[owner]
        within = np.flatnonzero(offset < size[first][owner])
        text[within] = np.minimum(flat[begin[first][owner[within]] + offset[within]], 0xFD) + 2
        order = suffix_array(text)
        shared = common_prefixes(text, order)
        whole = np.append(offset < count[first][owner], False)  # a string of SPAN bytes starts here
        order = order[whole[order]]
        runs = np.flatnonzero(np.append(True, shared[order[1:]] < SPAN))
        low = np.minimum.reduceat(least[owner[order]], runs)
        smallest = np.empty(len(text), "int64")
        smallest[order] = np.repeat(low, np.diff(np.append(runs, len(order))))
        of = np.repeat(np.arange(len(count)), count)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        held = smallest[(ends - room)[which][of] + turn] < ids[of]
        bits = np.add.reduceat(held.astype("uint32") << turn.astype("uint32"), np.cumsum(count) - count).astype("uint32")
        edges = np.cumsum([0, *map(len, counts)])
        packed = [bits[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({"bucket": table.column("bucket"), "part": table.column("shard"), "bits": pa.array(packed, pa.binary())})

    return pieces.groupBy("shard").applyInArrow(run, "bucket int, part int, bits binary")


def remove_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, block_keys: int = BLOCK_KEYS, shard_bytes: int = SHARD_BYTES, crowded: int = CROWDED) -> DataFrame:
    """``doc_id, n_bytes, kept`` (the remaining bytes) and ``removed`` (start and length of each maximal removed run).

    The bucketed table stays in the shared folder, since the result is read from it.
    """
    rows, size = _bucketed(docs, bucket_bytes)
    blocks = max(1, size * 2 // (STRINGS + 1) // block_keys)
    replies = cut(_replies(_requests(rows, blocks), crowded))
    shards = max(1, -(-(replies.agg(F.sum("size")).first()[0] or 0) // shard_bytes))

    def send(docs: pa.Table, found: pa.Table) -> pa.Table:
        out, bucket = [], None
        if found.num_rows:
            bucket = found.column("bucket")[0].as_py()
            out = list(_Bucket(docs, found.to_pylist(), blocks, shards).pieces())
        kinds = (("shard", pa.int32()), ("bytes", pa.binary()), ("strings", pa.binary()), ("ids", pa.binary()))
        return pa.table({"bucket": pa.array([bucket] * len(out), pa.int32())} | {c: pa.array([x[k] for x in out], t) for k, (c, t) in enumerate(kinds)})

    by_bucket = rows.groupBy("bucket")
    pieces = by_bucket.cogroup(replies.groupBy("bucket")).applyInArrow(send, "bucket int, shard int, bytes binary, strings binary, ids binary")
    verdicts = cut(_verdicts(pieces))
    answers = replies.select("bucket", "part", "keys", "bits").unionByName(verdicts.withColumn("keys", F.lit(None).cast("binary")))

    def finish(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "kept": pa.array([], pa.binary()), "removed": pa.array([], _RUNS)})
        found = found.to_pylist()
        bucket = _Bucket(docs, [x for x in found if x["keys"] is not None], blocks, shards)
        gone = bucket.removed([x for x in found if x["keys"] is None])
        begins = np.append(0, bucket.ends[:-1])
        before = np.append(False, gone[:-1])
        before[begins[begins < len(gone)]] = False
        start = np.flatnonzero(gone & ~before)
        after = np.append(gone[1:], False)
        after[bucket.ends[(bucket.ends > 0)] - 1] = False
        length = np.flatnonzero(gone & ~after) + 1 - start
        owner = np.searchsorted(bucket.ends, start, "right")
        edges = np.searchsorted(owner, np.arange(len(bucket.ids) + 1))
        left = np.append(0, np.cumsum(~gone))
        kept = pa.Array.from_buffers(pa.binary(), len(bucket.ids), [None, pa.py_buffer(left[np.append(0, bucket.ends)].astype("int32")), pa.py_buffer(bucket.flat[~gone])])
        runs = pa.StructArray.from_arrays([pa.array(start - begins[owner]), pa.array(length)], ["start", "length"])
        removed = pa.ListArray.from_arrays(pa.array(edges.astype("int32")), runs)
        return pa.table({"doc_id": pa.array(bucket.ids), "n_bytes": pa.array(np.diff(bucket.ends, prepend=0)), "kept": kept, "removed": removed})

    out = by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(finish, "doc_id long, n_bytes long, kept binary, removed array<struct<start: long, length: long>>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    found = remove_repeats(docs)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
