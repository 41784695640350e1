"""S13 as a table with a key index: plans, repeats, compaction, a second session."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators.news import NEWS_KEY
from tidewire.sources import store as U

T0 = dt.datetime(2024, 5, 1, 10)
SCHEMA = "news_id long, pub_time timestamp_ntz, ticker string, title string, sentiment_score double"


def batch(spark, rng, first, n=60):
    rows = []
    for i in range(first, first + n):
        when = None if rng.random() < 0.1 else T0 + dt.timedelta(days=rng.choice([0, 1, 40, 80]))
        rows.append((i, when, rng.choice(["A", "B", None]), rng.choice(["x", "y", "", None, f"t{rng.randrange(40)}"]), float(i)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    name = f"news_{abs(hash(str(tmp_path))) % 10**9}"
    path = str(tmp_path / "store")
    U.open_indexed_store(spark, name, path, spark.createDataFrame([], SCHEMA).schema, buckets=4)
    yield name, path
    spark.sql(f"drop table if exists {name}")


def rows_of(df):
    return sorted(map(tuple, df.select("news_id", *NEWS_KEY).collect()), key=repr)


def files_of(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_equals_upsert_and_survives_repeats_and_compaction(spark, store):
    name, path = store
    rng = random.Random(1)
    parts = [batch(spark, rng, 100 * i) for i in range(4)]
    want = parts[0].limit(0)
    for part in parts:
        U.append_to_indexed_store(part, name)
        U.append_to_indexed_store(part, name)
        want = U.upsert(want, part)
    assert rows_of(spark.table(name)) == rows_of(want)
    before = len(files_of(path))
    assert U.compact_store(spark, name, files=100) == []
    months = U.compact_store(spark, name, files=1)
    assert None in months and len(files_of(path)) < before
    assert len(files_of(path)) <= 4 * spark.table(name).select(U.MONTH).distinct().count()
    assert rows_of(spark.table(name)) == rows_of(want)
    for part in parts:
        assert U.rows_to_add(part, name).count() == 0
        U.append_to_indexed_store(part, name)
    assert rows_of(spark.table(name)) == rows_of(want)
    # Another session finds everything in the folder.
    spark.sql(f"drop table {name}")
    again = U.open_indexed_store(spark, name, path, parts[0].schema, buckets=4)
    assert rows_of(again) == rows_of(want) and U.rows_to_add(parts[1], name).count() == 0


def test_what_is_stored_is_not_shuffled(spark, store):
    name, _ = store
    rng = random.Random(2)
    U.append_to_indexed_store(batch(spark, rng, 0, 200), name)
    incoming = batch(spark, rng, 1000).filter("pub_time < '2024-05-20'")
    added = U.rows_to_add(incoming, name)
    added.count()
    plan = added._jdf.queryExecution().executedPlan().toString()
    scan = plan.index(f"FileScan parquet spark_catalog.default.{name}")
    join = plan.rindex("SortMergeJoin", 0, scan)
    stored_side = plan[max(plan.rindex("Exchange", 0, scan), join) : scan]
    # Between the scan and the join there are a filter and a sort, and the batch's exchange is on the other branch.
    assert "Bucketed: true" in plan[scan:] and "Sort [news_key" in stored_side
    lines = plan[join:scan].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    ancestors, level = [], depth(plan[: scan + 1].splitlines()[-1])
    for line in reversed(plan[:scan].splitlines()):
        if depth(line) < level:
            ancestors.append(line)
            level = depth(line)
        if "SortMergeJoin" in line:
            break
    assert ancestors and not any("Exchange" in line for line in ancestors)
    assert "PartitionFilters: [" in plan[scan:] and "2024-05" in plan[scan:]


def test_key_tells_null_from_empty(spark):
    rows = [(T0, None, None), (T0, "", None), (T0, None, ""), (T0, "-", None), (None, "-", "-"), (T0, "a", "b"), (T0, 'a","=b', None)]
    df = spark.createDataFrame(rows, "pub_time timestamp_ntz, ticker string, title string")
    assert df.select(F.count_distinct(U.news_key())).first()[0] == len(rows)


def test_repeated_batch_shuffles_no_articles(spark, store, monkeypatch):
    name, _ = store
    rng = random.Random(3)
    part = batch(spark, rng, 0, 200)
    U.append_to_indexed_store(part, name)
    plans, add = [], U._add
    monkeypatch.setattr(U, "_add", lambda rows, *rest: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), add(rows, *rest)))
    before = rows_of(spark.table(name))
    U.append_to_indexed_store(part, name)
    assert rows_of(spark.table(name)) == before
    # The keys to add, none, are known when their articles are looked up: those stay where they are.
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_rows_equal_in_the_order_too_are_stored_once(spark, store):
    name, _ = store
    rows = [(None, T0, "A", "x", 1.0), (1, T0, "A", "x", 2.0), (2, None, None, None, 3.0), (2, None, None, None, 3.0), (3, T0, "B", "y", 4.0)]
    U.append_to_indexed_store(spark.createDataFrame(rows * 2, SCHEMA), name)
    # A missing number is the smallest, as in an upsert.
    assert rows_of(spark.table(name)) == sorted([rows[0][:4], rows[2][:4], rows[4][:4]], key=repr)
