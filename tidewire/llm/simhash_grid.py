"""Near-duplicates by SimHash: a grid join over per-segment bit counts, then an exact check.

A fingerprint of 64 bits is mapped to the bit counts of its segments. The Manhattan distance of two
such vectors is never more than the number of differing bits, so fingerprints that differ in two
bits or fewer lie within distance two of each other, and then some grid point is within one step
of both. Every fingerprint is entered at its own grid point and at the points one step away; those
that meet at a point are candidates, and the differing bits of a candidate pair are counted.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.components import components
from tidewire.llm.text import fold_ascii, join_groups, keep_rows, map_batches, raw_text, split_words
from tidewire.session import materialise

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
# Grid points with more fingerprints than this are not paired up; see ``near_edges``.
PAIRED_MEMBERS = 32
# Every second bit: the low bits of the segments (fixed by the layout).
EVEN_BITS = 0x5555555555555555
# Shingles of a text that are hashed before their bits are added up.
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text as an unsigned 64-bit number; 0 when it has no word."""
    words = split_words(fold_ascii(text))
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, count = np.zeros(64, dtype=np.int64), max(len(words) - shingle_words + 1, 1)
    for start in range(0, count, SHINGLES_AT_ONCE):
        part = words[start : start + SHINGLES_AT_ONCE + shingle_words - 1]
        if len(words) < shingle_words:
            hashes = [digest(join(part), HASH_SEED)]
        else:
            hashes = [digest(join(s), HASH_SEED) for s in zip(*(part[i:] for i in range(shingle_words)))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(row, id, fp) per row of ``docs``, fp as a signed long. NULL text counts as empty."""

    def hashed(cols: dict[str, list]) -> dict[str, list]:
        fps = np.array([fingerprint(t, shingle_words) for t in cols["bytes"]], np.uint64)
        return {"row": cols["row"], "id": cols["id"], "fp": fps.view(np.int64)}

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), raw_text(text_col).alias("bytes")
    )
    return map_batches(rows, hashed, "row long, id long, fp long")


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 32 segments of two bits, each count in its segment's place.

    Both bits of a segment are added without carry out of it: the sum bit, and the carry beside it.
    """
    low = fp.bitwiseAND(F.lit(EVEN_BITS))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid_points(fp: Column) -> Column:
    """The grid point of a fingerprint and all valid points one step away (at most 65)."""
    counts = segment_counts(fp)

    def steps(j: Column) -> Column:
        here = F.call_function("shiftrightunsigned", counts, j * 2).bitwiseAND(F.lit(3).cast("long"))
        # 0 and 1 differ in the low bit of a count, 1 and 2 in both bits.
        low = counts.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j * 2))
        both = counts.bitwiseXOR(F.call_function("shiftleft", F.lit(3).cast("long"), j * 2))
        return F.array(F.when(here < 2, low), F.when(here > 0, both))

    around = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), steps))
    return F.concat(F.array(counts), F.filter(around, lambda x: x.isNotNull()))


def near_edges(fps: DataFrame, max_bits: int = MAX_BITS, paired: int = PAIRED_MEMBERS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of all links.

    ``fps`` has one long column fp without repeats. A link is a pair with at most ``max_bits``
    (0 to 2) differing bits. Points with up to ``paired`` members give each linked pair. Members of
    fuller points are linked without pairs: each is entered under itself and its 64 one-bit
    changes, and all that meet under one of these differ in at most two bits, so each is tied to
    the smallest of them; two fingerprints with a link always meet so. For ``max_bits`` below 2
    the same is done with the fingerprint's halves checked directly (0: no edges at all).
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("the grid step of one on either side covers links of up to two bits")
    # A few bytes per fingerprint become up to 65 rows: deal them over all tasks first.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fps.select("fp").repartition(tasks, "fp")
    entered = dealt.select("fp", F.explode(grid_points(F.col("fp"))).alias("point"))
    points = entered.groupBy("point").agg(
        F.count(F.lit(1)).alias("members"), F.min("fp").alias("u"), F.max("fp").alias("v")
    )
    shared = materialise(points.where("members > 1"), "grid-points")
    twos = shared.where("members = 2").select("u", "v")
    some = materialise(
        entered.join(shared.where(f"members between 3 and {paired}").select("point"), "point").select("point", "fp"), "grid-members"
    )
    a, b = some.select("point", F.col("fp").alias("u")), some.select("point", F.col("fp").alias("v"))
    pairs = twos.unionByName(a.join(b, "point").where("u < v").select("u", "v"))
    linked = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    crowd = entered.join(shared.where(f"members > {paired}").select("point"), "point").select("fp").distinct()
    return linked.unionByName(_crowd_edges(crowd, max_bits)).distinct()


def _crowd_edges(crowd: DataFrame, max_bits: int) -> DataFrame:
    """Links among many fingerprints as stars, with a number of rows linear in the fingerprints."""
    if max_bits == 0:
        return crowd.where("false").select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    flips = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda j: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)),
    )
    changed = crowd.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("near"))
    if max_bits == 1:
        # One bit apart: a one-bit change of the one is the other.
        return changed.join(crowd.select(F.col("fp").alias("near")), "near").where("fp < near").select(F.col("fp").alias("u"), F.col("near").alias("v"))
    hubs = changed.groupBy("near").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return changed.join(hubs, "near").where("fp <> u").select("u", F.col("fp").alias("v")).distinct()


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """(row, id, fp, component_id) per row of ``docs``: the smallest id reachable over links.

    Texts without a word have fingerprint zero and link like any other. NULL ids take part, and a
    component of NULL ids only has a NULL component_id. Copies are one fingerprint, so a large
    group of them costs one row. An empty table gives an empty result.
    """
    found = materialise(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    nodes = materialise(found.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies")), "nodes")
    roots = components(near_edges(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", "copies", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    named = join_groups(rooted, lows, ["root"], "nodes", rooted.count()).select("fp", "root", "component_id", "copies")
    return join_groups(found, named, ["fp"], "copies", found.count()).select("row", "id", "fp", "root", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate group: the smallest id, then the first such row.

    NULL and empty texts are one group, as they have one fingerprint; rows with a NULL id come after
    all others of their group. An empty table gives an empty result; all columns stay as they are.
    """
    groups = materialise(near_groups(docs, id_col, text_col), "near-groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    return keep_rows(docs, first.select(F.col("first.row").alias("row")))
