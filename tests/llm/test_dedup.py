"""Exact and near de-duplication against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewire.llm import components, exact_blocks, simhash_grid

from .conftest import written


def test_identities_are_equality_of_texts(docs):
    for block in (16, 1000, exact_blocks.BLOCK_BYTES):
        found = exact_blocks.identities(docs, block_bytes=block).collect()
        texts = {r.row: r.text or "" for r in docs.withColumn("row", F.monotonically_increasing_id()).collect()}
        assert len(found) == len(texts)
        by_name, by_text = defaultdict(set), defaultdict(set)
        for r in found:
            by_name[r.n_bytes, r.name].add(r.row)
            by_text[texts[r.row]].add(r.row)
        assert sorted(map(sorted, by_name.values())) == sorted(map(sorted, by_text.values()))


def test_last_byte_of_every_length_is_compared(spark, tmp_path):
    block = 16
    lengths = [1, *(k * block + more for k in (1, 2, 3, 4) for more in (-1, 0, 1, 2))]
    texts = [("ab" * n)[: n - 1] + last for n in lengths for last in (".", "!", ".")]
    whole = exact_blocks.BLOCK_BYTES
    large = [("ab" * n)[: n - 1] + last for n in (whole, whole + 1, whole + 2, 2 * whole + 1) for last in (".", "!", ".")]
    for made, size in ((texts, block), (large, whole)):
        docs = written(spark, [(i, t, "en", "s") for i, t in enumerate(made)], tmp_path / f"documents{size}.parquet")
        by_name, by_text = defaultdict(set), defaultdict(set)
        for r in exact_blocks.identities(docs, block_bytes=size).collect():
            by_name[r.n_bytes, r.name].add(r.id)
            by_text[made[r.id]].add(r.id)
        assert sorted(map(sorted, by_name.values())) == sorted(map(sorted, by_text.values()))
        if size == whole:
            assert exact_blocks.drop_copies(docs).count() == len(set(made))


def test_largest_id_stays(docs, rows):
    found = exact_blocks.exact_groups(docs).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    assert len(found) == len(rows)
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.keep_id == r.id for r in found if r.kept)
    want = sorted((len(g), max((i for i in g if i is not None), default=None)) for g in groups.values())
    assert sorted((r.group_size, r.keep_id) for r in found if r.kept) == want


def test_a_key_over_many_tasks_has_one_name(spark):
    rows = spark.range(20_000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.col("id").cast("string").cast("binary")).alias("key"))
    named = exact_blocks.name_by_sort(rows.repartition(8), "row").collect()
    names = {r.row: r.name for r in named}
    assert len({names[i] for i in range(0, 20_000, 3)}) == 1
    assert len(set(names.values())) == 1 + sum(i % 3 != 0 for i in range(20_000))


def test_drop_copies_keeps_columns(docs, no_docs, rows):
    left = exact_blocks.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({t or "" for _, t, *_ in rows})
    assert exact_blocks.drop_copies(no_docs).count() == 0
    assert exact_blocks.exact_groups(no_docs).count() == 0


def brute_components(fps, ids, bits=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    low = {}
    for i, key in enumerate(ids):
        root = find(i)
        if key is not None:
            low[root] = min(low.get(root, key), key)
    return [(root, low.get(root)) for root in map(find, range(len(fps)))]


def test_fingerprint_by_definition():
    import xxhash

    text = "One two\tthree four four\n five".encode()
    words = "one two three four four five".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    assert simhash_grid.fingerprint(text) == want
    assert simhash_grid.fingerprint(b" \n") == 0
    assert simhash_grid.fingerprint(b"A b") == xxhash.xxh64_intdigest("a b", 42)


def test_spark_hash_is_the_same(spark):
    import xxhash

    got = spark.sql("select xxhash64('a b c') as h").first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest("a b c", 42)


def test_near_groups_equal_brute_force(docs, no_docs):
    found = simhash_grid.near_groups(docs).collect()
    texts = {r.row: r for r in docs.withColumn("row", F.monotonically_increasing_id()).collect()}
    order = sorted(texts)
    fps = np.array([simhash_grid.fingerprint((texts[r].text or "").encode()) for r in order], np.uint64)
    want = brute_components(fps, [texts[r].doc_id for r in order])
    got = {r.row: (r.fp % (1 << 64), r.component_id) for r in found}
    assert [got[r] for r in order] == [(int(f), low) for f, (_, low) in zip(fps, want, strict=True)]
    assert simhash_grid.near_groups(no_docs).count() == 0
    left = simhash_grid.drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == len({root for root, _ in want})


@pytest.mark.parametrize("paired", [2, 32])
def test_crowded_grid_points_lose_no_link(spark, paired):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = [int(centre ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b))) for a, b in rng.integers(0, 64, (60, 2))]
    far = [int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)]
    chain = [0]
    for bit in range(0, 40, 2):
        chain.append(chain[-1] ^ (3 << bit))
    fps = np.array(sorted({*near, *far, *chain, (1 << 64) - 1}), np.uint64)
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    edges = simhash_grid.near_edges(frame, paired=paired)
    roots = {r.node: r.root for r in components.components(edges).collect()}
    got = defaultdict(set)
    for f in fps.view(np.int64).tolist():
        got[roots.get(f, f)].add(f % (1 << 64))
    want = defaultdict(set)
    for f, (root, _) in zip(fps.tolist(), brute_components(fps, [0] * len(fps)), strict=True):
        want[root].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    for e in edges.collect():
        assert 0 < bin((e.u ^ e.v) % (1 << 64)).count("1") <= 2


def test_long_chain_is_one_component(spark):
    edges = spark.range(1, 500).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    found = components.components(edges)
    assert found.where("root <> 0").count() == 0 and found.count() == 500
    assert components.components(edges.where("false")).count() == 0
