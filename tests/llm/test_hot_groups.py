"""One group of nine tenths of all rows, and a component with one hub: same results, dealt over tasks."""

import random

import pytest
from pyspark.sql import functions as F
from tidewire.llm import components, exact_blocks, simhash_grid, text
from tidewire.session import materialise

from .conftest import prose


@pytest.fixture(scope="module")
def crowded(spark):
    rng = random.Random(11)
    hot = prose(rng, words=50)
    rows = [(i, hot) for i in range(1800)] + [(5000 + i, prose(rng, words=50)) for i in range(150)]
    rows += [(9000 + i, prose(random.Random(i % 10), words=40)) for i in range(50)]
    rng.shuffle(rows)
    return rows, materialise(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "crowded")


def test_exact_groups(spark, crowded):
    rows, frame = crowded
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, []).append(i)
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_blocks.exact_groups(frame).collect()}
    assert got == {i: (max(by_text[t]), len(by_text[t]), i == max(by_text[t])) for i, t in rows}


def test_near_groups(spark, crowded):
    rows, frame = crowded
    fps = {i: simhash_grid.fingerprint(t.encode()) for i, t in rows}
    got = {r.id: r for r in simhash_grid.near_groups(frame).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        linked = [j for j, fp in fps.items() if (fp ^ fps[i]).bit_count() <= 2]
        assert r.component_id <= min(linked) and all(got[j].component_id == r.component_id for j in linked)


@pytest.mark.parametrize("few", [0, 10**6])
def test_hub_of_a_component(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    edges = [(0, i) for i in range(1, 1500)] + [(2000 + i, 2001 + i) for i in range(40)] + [(1499, 3000)]
    frame = spark.createDataFrame(edges, "u long, v long")
    want = {**{i: 0 for i in range(1500)}, 3000: 0, **{2000 + i: 2000 for i in range(41)}}
    assert {r.node: r.root for r in components.components(frame).collect()} == want


@pytest.mark.parametrize("hot_rows, hot_groups", [(5, 10**6), (5, 2), (10**6, 10**6)])
def test_join_groups_is_a_join_and_spreads(spark, monkeypatch, hot_rows, hot_groups):
    monkeypatch.setattr(text, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(text, "HOT_GROUPS", hot_groups)
    made = [(i, None if i % 11 == 0 else 0 if i % 3 else i, f"s{i}") for i in range(300)]
    rows = materialise(spark.createDataFrame(made, "row long, k int, is_hot string").repartition(8, "row"), "rows")
    groups = rows.groupBy("k").agg(F.count("*").alias("members"), F.max("row").alias("top")).where("k is not null")
    plain = sorted(map(tuple, rows.join(groups.drop("members"), "k").select("row", "k", "is_hot", "top").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = text.join_groups(rows, groups, ["k"], "members", 300)
        assert joined.columns == ["row", "k", "is_hot", "top"] and sorted(map(tuple, joined.collect())) == plain
        sizes = joined.where("k = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The group of two thirds stays where its rows are, unless it counts as small.
    assert len(sizes) > 1 if hot_rows == 5 else len(sizes) == 1


def test_fingerprint_in_parts(monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, words=n).encode() for n in (1, 2, 3, 4, 7, 8, 9, 40)]
    whole = [simhash_grid.fingerprint(t) for t in texts]
    for step in (1, 2, 3, 5):
        monkeypatch.setattr(simhash_grid, "SHINGLES_AT_ONCE", step)
        assert [simhash_grid.fingerprint(t) for t in texts] == whole
