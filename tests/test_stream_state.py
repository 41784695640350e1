"""Streams that keep state (T1, T3): equal to batch, bounded, restartable, late articles counted."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidewire.operators.news import NEWS_KEY
from tidewire.sources import store as U
from tidewire.streaming import ingest as T

SCHEMA = "news_id long, pub_time timestamp_ntz, ticker string, title string, summary string, sentiment_score double"
DAY = dt.datetime(2024, 5, 1)


def articles(spark, rows):
    """(id, hours after the first of May, ticker, title, score)."""
    made = [(i, None if h is None else DAY + dt.timedelta(hours=h), t, title, None, s) for i, h, t, title, s in rows]
    return spark.createDataFrame(made, SCHEMA)


def land(frame, path):
    frame.coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("memory", [None, "0 seconds", "1 hour"])
def test_upsert_equals_batch_at_any_age(spark, tmp_path, memory):
    land_, store, check = (str(tmp_path / n) for n in ("land", "store", "check"))
    batches = [
        articles(spark, [(1, 500, "A", "x", 0.1), (2, 500, "A", "x", 0.2), (3, 1, "A", None, 0.3), (4, None, "A", "n", 0.4)]),
        # Fetched again, and articles that are weeks older than all before.
        articles(spark, [(1, 500, "A", "x", 0.1), (3, 1, "A", None, 0.3), (5, -2000, "B", "old", 0.5), (4, None, "A", "n", 0.4)]),
        articles(spark, [(6, -2000, "B", "old", 0.9), (7, -2001, None, "older", 0.6), (5, -2000, "B", "old", 0.5)]),
    ]
    want = None
    for part in batches:
        land(part, land_)
        T.stream_upsert(T.landed(spark, land_, part.schema), store, check, memory=memory).awaitTermination()
        want = U.upsert(part.limit(0), part) if want is None else U.upsert(want, part)
    key = [*NEWS_KEY, "news_id", "sentiment_score"]
    order = lambda r: tuple((v is not None, v) for v in r)
    got = spark.read.parquet(store).select(*key).collect()
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, want.select(*key).collect()), key=order)


def test_state_holds_only_what_memory_spans(spark, tmp_path):
    land_, check = str(tmp_path / "land"), str(tmp_path / "check")
    schema = articles(spark, []).schema
    totals, seen = [], []
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for start in (0, 100, 200):
        land(articles(spark, [(i, i, "A", f"t{i}", 0.0) for i in range(start, start + 10)] + [(5, 5, "A", "t5", 0.0)]), land_)
        with T.rocksdb_state(spark):
            news = T.forget_repeats(T.landed(spark, land_, schema), "1 second")
            query = T._start(news, lambda batch, _: seen.extend(r.news_id for r in batch.collect()), check)
        query.awaitTermination()
        totals.append(query.lastProgress.stateOperators[0].numRowsTotal)
        assert "rocksdb" in str(query.lastProgress.stateOperators[0].customMetrics).lower()
        time.sleep(1.5)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    # Thirty articles have come, the last ten are known; what was forgotten passes again.
    assert totals[0] == 10 and totals[-1] <= 12 and seen.count(5) >= 2 and seen.count(105) == 1


def test_repeats_within_memory_do_not_pass(spark, tmp_path):
    land_, check = str(tmp_path / "land"), str(tmp_path / "check")
    schema = articles(spark, []).schema
    seen = []
    for _ in range(3):
        land(articles(spark, [(1, 1, "A", "x", 0.0), (1, 1, "A", "x", 0.0), (2, 1, "A", None, 0.0)]), land_)
        with T.rocksdb_state(spark):
            news = T.forget_repeats(T.landed(spark, land_, schema), "1 hour")
            T._start(news, lambda batch, _: seen.extend(r.news_id for r in batch.collect()), check).awaitTermination()
    assert sorted(seen) == [1, 2]


def test_late_file_changes_a_closed_day(spark, tmp_path):
    land_, closed, parts = (str(tmp_path / n) for n in ("land", "closed", "parts"))
    schema = articles(spark, []).schema
    scores = {"score": F.col("sentiment_score")}

    def run():
        for start, store in ((T.stream_closed_days, closed), (T.stream_daily, parts)):
            stream = T.landed(spark, land_, schema, per_trigger=1)
            start(stream, scores, store, f"{store}-check").awaitTermination()
        rows = T.read_closed_days(spark, closed, parts, ["score"]).collect()
        return {(r.news_date.day, r.ticker): (r.score, r.news_count, r.late) for r in rows}

    land(articles(spark, [(1, 1, "A", "a", 1.0), (2, 2, "A", "b", None), (3, 3, None, "c", 2.0), (4, None, "A", "d", 5.0)]), land_)
    land(articles(spark, [(5, 24 * 2 + 1, "A", "e", 3.0)]), land_)
    assert run() == {}
    land(articles(spark, [(6, 24 * 5, "A", "f", 4.0)]), land_)
    land(articles(spark, [(7, 24 * 5, "B", "g", 4.0)]), land_)
    before = {(1, "A"): (1.0, 2, 0), (1, None): (2.0, 1, 0), (3, "A"): (3.0, 1, 0)}
    assert run() == before
    land(articles(spark, [(8, 5, "A", "late", 4.0), (9, 30, "A", "new day", 9.0)]), land_)
    # A day that had no article before it was closed stays out; the first of May has changed.
    assert run() == {**before, (1, "A"): (2.5, 3, 1)}
    assert run() == {**before, (1, "A"): (2.5, 3, 1)}
