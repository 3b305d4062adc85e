"""Streams of reviews: late, repeated and replayed submissions, and a view that is refreshed and restarted."""

import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitefacts.streaming import reviews

SCHEMA = "site_id string, submitted_at timestamp, hotel_name string"


@pytest.fixture
def place(spark, tmp_path):
    class Place:
        taken, out, state = (str(tmp_path / x) for x in ("in", "done", "state"))

        def put(self, *rows):
            frame = spark.createDataFrame(list(rows), "site_id string, at string, hotel_name string")
            frame.select("site_id", F.to_timestamp("at").alias("submitted_at"), "hotel_name").coalesce(1).write.mode("append").parquet(self.taken)

        def run(self, files=1, **how):
            query = reviews.completed(reviews.submissions(spark, self.taken, SCHEMA, files), self.out, self.state, **how)
            assert query.awaitTermination(180)
            return query

        def found(self):
            return sorted((r.site_id, r.hotel_name) for r in spark.read.parquet(self.out).collect())

    return Place()


def test_first_arrival_wins_over_late_and_repeated_ones(place):
    place.put(("a", "2026-01-02 00:00:00", "later"), ("a", "2026-01-01 00:00:00", "first"), ("b", None, "b-null"), ("b", "2026-01-03 00:00:00", "b"), (None, "2026-01-01 00:00:00", "nobody"))
    place.run()
    assert place.found() == [("a", "first"), ("b", "b")]
    place.put(("a", "2025-01-01 00:00:00", "earlier but late"), ("c", None, "c"), ("a", "2026-01-01 00:00:00", "first"))
    place.put(("c", "2026-01-01 00:00:00", "c again"), ("d", "2026-01-01 00:00:00", "d"))
    place.run()
    assert place.found() == [("a", "first"), ("b", "b"), ("c", "c"), ("d", "d")]


def test_one_site_with_most_submissions_is_one_value_of_state(spark, place):
    place.put(*(("hot", f"2026-01-01 00:{k // 60 % 60:02d}:{k % 60:02d}", f"h{k}") for k in range(3000, 0, -1)), *((f"s{k}", "2026-01-01 00:00:00", "x") for k in range(50)))
    query = place.run()
    assert len(place.found()) == 51 and ("hot", "h1") in place.found()
    place.put(*(("hot", "2026-01-01 00:00:00", "again") for _ in range(500)))
    query = place.run()
    assert len(place.found()) == 51
    assert query.lastProgress.stateOperators[0].numRowsTotal == 51


def test_a_batch_that_runs_again_replaces_its_rows(spark, place, tmp_path):
    place.put(("a", "2026-01-01 00:00:00", "a"))
    place.run()
    place.put(("b", "2026-01-01 00:00:00", "b"), ("a", "2026-01-01 00:00:00", "again"))
    place.run()
    before = place.found()
    for commit in (tmp_path / "state" / "commits").glob("*1*"):  # as if the last batch had not been confirmed
        commit.unlink()
    place.run()
    assert place.found() == before == [("a", "a"), ("b", "b")]


def test_state_can_expire(spark, place):
    for text in ("a", "a new round"):
        place.put(("a", "2026-01-01 00:00:00", text))
        query = reviews.completed(reviews.submissions(spark, place.taken, SCHEMA), place.out, place.state, every="1 second", keep_ms=1)
        for _ in range(90):  # such a stream never runs out of work
            time.sleep(1)
            if any(Path(place.out).glob("batch=*/*.parquet")) and ("a", text) in place.found():
                break
        query.stop()
    assert place.found() == [("a", "a"), ("a", "a new round")]
    with pytest.raises(ValueError, match="steady"):
        place.run(keep_ms=1)
    sites = spark.createDataFrame([("a", "pending_review"), ("z", "pending_review")], "site_id string, status string")
    shown = reviews.status(sites, spark.read.parquet(place.out))
    assert sorted((r.site_id, r.status, r.serves_final) for r in shown.collect()) == [("a", "completed", True), ("z", "pending_review", False)]


def test_a_view_is_refreshed_and_restarted(spark, place, tmp_path):
    shown = []

    def refresh():
        view = reviews.refreshes(spark, place.out, SCHEMA)
        assert reviews.watch(view, lambda batch: shown.append(sorted(r.site_id for r in batch.collect())), str(tmp_path / "view"), None).awaitTermination(120)

    for round_, sites in enumerate(("ab", "bc", "d")):
        place.put(*((s, f"2026-01-0{round_ + 1} 00:00:00", s) for s in sites))
        place.run()
        refresh()
    assert shown == [["a", "b"], ["c"], ["d"]]
    refresh()  # a restart with nothing new
    place.put(("e", "2026-01-09 00:00:00", "e"))
    place.run()
    refresh()
    assert [x for x in shown[3:] if x] == [["e"]]


def test_rows_of_a_site_come_in_parts():
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def update(self, value):
            self.held = value

    first = reviews._First(("t",), None)
    first.done = Value()
    parts = [pd.DataFrame({"t": t, "v": v}) for t, v in (([3.0, None], ["c", "n"]), ([2.0, 2.0], ["b", "b2"]), ([5.0], ["e"]))]
    assert pd.concat(first.handleInputRows(("s",), iter(parts), None)).values.tolist() == [[2.0, "b"]]
    assert list(first.handleInputRows(("s",), iter(parts), None)) == []
