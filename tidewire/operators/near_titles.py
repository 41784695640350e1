"""Near-duplicate titles, exact and without comparing all pairs.

Within a ticker's day a row goes if an earlier row's lower-case title is at least 90 % similar
(1 - edit distance / longer length). Earlier rows count whether they stay or go, so the result
does not depend on a scan order; with ``greedy`` only rows that stay count, as in a scan from the
earliest to the latest.

Candidates come from a prefix filter. A title of length n can differ from a similar one in at
most t = n div 9 edits, and one edit touches at most Q of its Q-grams. Sort the Q-grams (with
their occurrence numbers) by how rare they are in all titles: two similar titles share one among
the first Q*t + 1. So only titles with a common rare piece meet. Pieces are hashes that include
the block; what meets by a collision is told apart when texts are compared.

A crowd of near copies would still meet pairwise. Therefore every title is first checked against
the earliest title of each of its pieces, found by a plain aggregate; whoever is similar to one
is settled. Only the others are compared with all earlier titles that share a piece and are of
like length.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.session import materialise

Q = 3
# Grams that two long titles are checked by before their distance, and the length from which they are.
CHECK_Q = 6
CHECK_FROM = 64
# Buckets of gram hashes that are counted, and the ratio of neighbouring bands of title lengths.
BUCKETS = 1 << 16
BAND = 1.13
# An odd number with bits all over.
MIX = 0x9E3779B97F4A7C15
BLOCK = ("ticker", "day")


def similar_enough(a: Column, b: Column, share: float = 0.9) -> Column:
    """Edit-distance similarity of at least ``share``; gives up early beyond the allowed distance."""
    longer = F.greatest(F.length(a), F.length(b))
    # The small term keeps 10 % of a round length from falling just short in binary.
    allowed = F.floor(longer * (1 - share) + 1e-9).cast("int")
    close = F.abs(F.length(a) - F.length(b)) <= allowed
    # With a limit only a band of that width is worked out; beyond it the distance is -1.
    distance = F.when(close, F.call_function("levenshtein", a, b, allowed))
    return F.coalesce((distance >= 0) & (distance <= allowed), F.lit(False))


def title_grams(title: str, q: int = Q) -> np.ndarray:
    """A hash for each ``q`` characters in a row, from the characters' numbers; modulo 2**64."""
    codes = np.frombuffer(title.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < q:
        return codes[:0]
    grams = codes[: len(codes) - q + 1]
    for i in range(1, q):
        grams = grams * np.uint64(MIX) + codes[i : len(codes) - q + 1 + i]
    grams = grams * np.uint64(MIX)
    return grams ^ (grams >> np.uint64(32))


def title_pieces(title: str, seen: np.ndarray) -> np.ndarray:
    """The title's rarest Q-grams, each with its occurrence number mixed in, as many as the filter needs."""
    grams, counts = np.unique(title_grams(title), return_counts=True)
    first = np.cumsum(counts) - counts
    times = np.arange(counts.sum()) - np.repeat(first, counts)
    grams = np.repeat(grams, counts)
    order = np.lexsort((times, grams, seen[grams % np.uint64(len(seen))]))[: len(title) // 9 * Q + 1]
    return (grams[order] + np.uint64(MIX) * times[order].astype(np.uint64)).view(np.int64)


def enough_common(a: str, b: str) -> bool:
    """Whether two titles share as many longer grams as similar ones must; True where that says nothing.

    One edit touches at most ``CHECK_Q`` grams of the longer title, the others are in both. Sorting
    grams takes far less than the distance of two long texts, and few that only met pass.
    """
    longer = max(len(a), len(b))
    needed = longer - CHECK_Q + 1 - CHECK_Q * (longer // 10)
    if needed <= 0 or longer < CHECK_FROM:
        return True
    mine, theirs = (np.unique(title_grams(t, CHECK_Q), return_counts=True) for t in (a, b))
    _, i, j = np.intersect1d(mine[0], theirs[0], assume_unique=True, return_indices=True)
    return int(np.minimum(mine[1][i], theirs[1][j]).sum()) >= needed


@F.arrow_udf(T.BooleanType())
def _may_be_near(low: pa.Array, other: pa.Array) -> pa.Array:
    return pa.array([enough_common(a, b) for a, b in zip(low.to_pylist(), other.to_pylist(), strict=True)], pa.bool_())


def _pieces(titles: DataFrame) -> DataFrame:
    """(piece, id, n): hashes of the block and each title's rarest Q-grams.

    How rare a gram is comes from one count over all titles per hash bucket, a table of fixed size
    that goes to the driver and back. Grams never leave the task that cuts a title; exploding,
    grouping and ranking them as rows took most of the time of this operator.
    """
    crowded = titles.groupBy(*BLOCK).agg(F.count("*").alias("c")).filter("c > 1").select(*BLOCK)
    dealt = titles.filter(F.length("low") >= 9).join(crowded, list(BLOCK), "left_semi")
    dealt = materialise(dealt.select("id", F.xxhash64(*BLOCK).alias("block"), F.length("low").alias("n"), "low"), "crowded")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for title in batch.column("low").to_pylist():
                seen += np.bincount((title_grams(title) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["bucket", "times"])

    seen = np.zeros(BUCKETS, dtype=np.int64)
    for row in dealt.select("low").mapInArrow(count, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times")).collect():
        seen[row.bucket] = row.times

    @F.arrow_udf("array<long>")
    def rarest(low: pa.Array) -> pa.Array:
        return pa.array([title_pieces(title, seen) for title in low.to_pylist()], pa.list_(pa.int64()))

    cut = dealt.select("id", "n", "block", F.explode(rarest("low")).alias("gram"))
    return cut.select(F.xxhash64("block", "gram").alias("piece"), "id", "n")


def _near(pairs: DataFrame, titles: DataFrame, share: float) -> DataFrame:
    """The (id, other) pairs whose titles are of one block and similar."""
    text = titles.select("id", "low", F.struct(*BLOCK).alias("block"))
    other = text.select(F.col("id").alias("other"), F.col("low").alias("other_low"), F.col("block").alias("other_block"))
    both = pairs.distinct().join(text, "id").join(other, "other")
    longer, shorter = (f(F.length("low"), F.length("other_low")) for f in (F.greatest, F.least))
    both = both.filter(F.col("block").eqNullSafe(F.col("other_block")) & (longer * 9 <= shorter * 10 + 9))
    # Nested, as the distance would be worked out before the check if it stood beside it.
    alike = F.when(_may_be_near("low", "other_low"), similar_enough(F.col("low"), F.col("other_low"), share))
    return both.filter(alike).select("id", "other")


def _earlier_pairs(open_: DataFrame, partners: DataFrame) -> DataFrame:
    """(id, other) of titles that share a piece, the other earlier and of a length that may be similar.

    Bands of length are part of the key, so a piece that many titles have is dealt by length too.
    """
    band = F.floor(F.log(F.col("n")) / math.log(BAND)).cast("int")
    near_bands = F.explode(F.array(band - 1, band, band + 1)).alias("band")
    mine = open_.select("piece", "id", "n", near_bands)
    theirs = partners.select("piece", F.col("id").alias("other"), F.col("n").alias("other_n"), band.alias("band"))
    longer, shorter = F.greatest("n", "other_n"), F.least("n", "other_n")
    met = mine.join(theirs, ["piece", "band"]).filter((F.col("other") < F.col("id")) & (longer * 9 <= shorter * 10 + 9))
    return met.select("id", "other")


def _leaders(pieces: DataFrame) -> DataFrame:
    """(piece, other): the earliest title of each piece that several have."""
    found = pieces.groupBy("piece").agg(F.min("id").alias("other"), F.count("*").alias("c"))
    return found.filter("c > 1").select("piece", "other")


def _dropped(titles: DataFrame, pieces: DataFrame, share: float) -> DataFrame:
    """Ids of titles that are similar to any earlier one."""
    first_pairs = pieces.join(_leaders(pieces), "piece").filter(F.col("other") < F.col("id")).select("id", "other")
    near_leader = materialise(_near(first_pairs, titles, share).select("id").distinct(), "near-leader")
    open_ = pieces.join(near_leader, "id", "left_anti")
    near_any = _near(_earlier_pairs(open_, pieces), titles, share).select("id").distinct()
    return near_leader.unionByName(near_any)


def _dropped_greedily(titles: DataFrame, pieces: DataFrame, share: float) -> DataFrame:
    """Ids of titles that are similar to an earlier one that stays.

    Rounds of two kinds. First, a title that is the earliest undecided one of each of its pieces
    has no undecided neighbour before it and stays; who is similar to one that stays goes. That
    takes crowds apart without their pairs, and goes on while a round decides a tenth of what is
    open. Then the similar pairs of the rest are written, and in each round who has no earlier
    neighbour left stays. On pairs in random order rounds grow with the logarithm of the titles.
    """
    gone: list[DataFrame] = []
    left = pieces.select("id").distinct().count()
    while left:
        marked = pieces.join(_leaders(pieces), "piece", "left")
        first = marked.groupBy("id").agg(F.min(F.coalesce(F.col("other") == F.col("id"), F.lit(True))).alias("first"))
        stays = materialise(first.filter("first").select("id"), "stays")
        led = marked.filter(F.col("other") < F.col("id")).select("id", "other")
        led = led.join(stays.select(F.col("id").alias("other")), "other", "left_semi")
        goes = materialise(_near(led, titles, share).select("id").distinct(), "goes")
        gone.append(goes)
        pieces = materialise(pieces.join(stays.unionByName(goes), "id", "left_anti"), "pieces")
        before, left = left, pieces.select("id").distinct().count()
        if left > 0.9 * before:
            break
    edges = materialise(_near(_earlier_pairs(pieces, pieces), titles, share), "edges") if left else None
    while edges is not None and not edges.isEmpty():
        stays = edges.select(F.col("other").alias("id")).distinct().join(edges.select("id"), "id", "left_anti")
        stays = stays.withColumnRenamed("id", "other")
        goes = materialise(edges.join(stays, "other", "left_semi").select("id").distinct(), "goes")
        gone.append(goes)
        ended = goes.withColumnRenamed("id", "other")
        settled = stays.unionByName(ended)
        edges = materialise(edges.join(settled, "other", "left_anti").join(goes, "id", "left_anti"), "edges")
    return functools.reduce(DataFrame.unionByName, gone) if gone else titles.select("id").limit(0)


def drop_near_titles(df: DataFrame, share: float = 0.9, tie_break: str = "news_id", greedy: bool = False) -> DataFrame:
    """J7 on a news table with unique ``tie_break``; earlier means smaller (pub_time, tie_break).

    A row without a title is like no other and stays. Of equal titles the earliest stays at most.
    ``greedy`` compares a title only with earlier ones that stay.
    """
    if not 0.9 <= share <= 1:
        raise ValueError("the filter is laid out for similarities from 0.9 to 1")
    placed = df.filter(F.col("title").isNotNull()).select(
        F.to_date("pub_time").alias("day"),
        "ticker",
        F.lower("title").alias("low"),
        F.struct("pub_time", F.col(tie_break).alias("n")).alias("id"),
    )
    # Equal titles first: only the earliest of each goes on, copies shrink before the shuffle.
    # Titles, pieces and settled ids are read several times below, so they are written once.
    titles = materialise(placed.groupBy(*BLOCK, "low").agg(F.min("id").alias("id")), "titles")
    pieces = materialise(_pieces(titles), "pieces")
    shared = pieces.groupBy("piece").agg(F.count("*").alias("c")).filter("c > 1").select("piece")
    pieces = materialise(pieces.join(shared, "piece", "left_semi"), "shared-pieces")
    gone = (_dropped_greedily if greedy else _dropped)(titles, pieces, share)
    kept = titles.select("id").join(gone, "id", "left_anti")
    own = F.struct("pub_time", F.col(tie_break).alias("n"))
    titled = df.filter(F.col("title").isNotNull()).withColumn("id", own)
    stays = titled.join(kept, "id", "left_semi").drop("id")
    return stays.unionByName(df.filter(F.col("title").isNull()))
