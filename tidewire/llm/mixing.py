"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. A document takes as many certain whole copies as its
expected number of copies has, and one more by unequal-probability sampling. Which documents get that
one more is settled by Pareto order sampling: each has the rank (random odds) / (inclusion odds),
and the smallest ranks of a source are taken until its target is met. Inclusion odds are given
relative to each other; a factor that a whole source shares changes no order, so it need not be
known. Random numbers come from a hash of the row, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewire.llm.text import WORD, free_name
from tidewire.session import materialise

# Weights of the sources in code-point order, repeated (fixed by the mix wanted).
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
# Slices of the ranks per source, at least, and rows per slice, about; only the slice in which a
# target is met is put in order.
SLICES, SLICE_ROWS = 4096, 16_384
UNIFORM_DIGITS = 13


def word_count(text_col: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; NULL has none."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from an md5 digest of the parts as text."""
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    whole = F.conv(F.substring(digest, 1, UNIFORM_DIGITS), 16, 10).cast("double")
    return (whole + 0.5) / F.lit(float(16**UNIFORM_DIGITS))


def size_odds(size: Column) -> Column:
    """Inclusion odds that grow with the root of a document's words: of two, the longer is likelier."""
    return F.sqrt(F.greatest(size, F.lit(1)).cast("double"))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_copies: int = MOST_COPIES
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code-point order, NULL last, get the weights in turn. They share ``share`` times all
    sizes by weight; a target stops at ``most_copies`` times its source's size, and what is over is
    shared again by weight among the others until none is above. That is one common level: the
    target is the smaller of weight x level and the stop, with the level set by the sources that do
    not stop. Sources are sorted by the level at which they stop, so the level follows from running
    sums; the table has one row per source, not per document.
    """
    position = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (position + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size") * most_copies)
    everyone = W.partitionBy()
    order = W.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = (
        F.sum("source_size").over(everyone) * F.lit(share) - F.coalesce(F.sum("stop").over(before), F.lit(0))
    ) / F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = rows.withColumn("level_here", rest)
    # The first source, in this order, that is below its stop sets the level of all after it.
    open_level = F.when(F.col("level_here") < F.col("stop") / F.col("weight"), F.col("level_here"))
    rows = rows.withColumn("level", F.first(open_level, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("stop").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("stop").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_copies: int = MOST_COPIES,
    seed: int = 0,
    odds: Callable[[Column], Column] = size_odds,
) -> DataFrame:
    """(row, id, size, source_size, target, copies, taken) per row of ``docs``.

    ``copies`` is a whole number from 0 to ``most_copies``, ``taken`` is copies x size. The expected
    number of copies of a document is target / source_size; its whole part is certain. Among the
    documents of a source the rest is a fixed-size sample: ranks are taken in order until the words
    left of the target are used up, the last document if at least half of it fits. ``odds`` gives a
    document's inclusion odds from its size, positive and relative to others of its source; with
    ``lambda size: lit(1.0)`` all are equally likely.

    The running sum over ranks is not taken over a whole source: words are added up per slice of
    the ranks first, and only the rows of the one slice in which the target is met are put in
    order. Documents without words have size 0 and follow the same rule. Equal ranks (repeated
    rows) are ordered by row. NULL source is a source of its own. An empty table gives an empty
    result.
    """
    rows = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(text_col).alias("size"),
            uniform(F.lit(seed), F.col(id_col)).alias("u"),
        ).withColumn("rank", F.col("u") / (F.lit(1.0) - F.col("u")) / odds(F.col("size"))),
        "sizes",
    )
    # Ranks times their usual odds lie evenly over (0, 1) after x / (1 + x), about.
    total, usual = rows.agg(F.count(F.lit(1)), F.avg(odds(F.col("size")))).first()
    number = max(SLICES, total // SLICE_ROWS)
    level = F.col("rank") * F.lit(usual or 1.0)
    slice_ = F.floor(level / (F.lit(1.0) + level) * F.lit(number)).cast("int")
    slices = materialise(
        rows.groupBy("source", slice_.alias("slice")).agg(F.sum("size").alias("words")),
        "slices",
    )
    targets = source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most_copies)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sure = F.floor(expected).cast("int")
    plan = targets.withColumn("sure", sure)
    plan = plan.withColumn("left_over", F.col("target") - F.col("source_size") * F.col("sure"))
    plan = materialise(plan.withColumnRenamed("source", "of_source"), "source-plan")
    running = F.sum("words").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    cuts = (
        slices.withColumn("before", F.coalesce(running, F.lit(0)))
        .join(plan.select("of_source", "left_over"), F.col("source").eqNullSafe(F.col("of_source")))
        .where((F.col("left_over") > 0) & (F.col("before") < F.col("left_over")) & (F.col("before") + F.col("words") >= F.col("left_over")))
        .groupBy("of_source")
        .agg(F.max_by("slice", "before").alias("cut_slice"), F.max("before").alias("before"))
    )
    plan = plan.join(cuts.withColumnRenamed("of_source", "cut_source"), F.col("of_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    plan = materialise(plan, "source-cuts")
    known = rows.join(plan, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("slice", slice_)
    at_cut = F.col("slice") == F.col("cut_slice")
    ordered = known.where(at_cut)
    upto = F.sum("size").over(W.partitionBy("source").orderBy("rank", "id", "row").rowsBetween(W.unboundedPreceding, W.currentRow))
    # Taken if the target is met no earlier than half-way through the document.
    one_more = F.col("before") + upto - F.col("size") / 2 <= F.col("left_over")
    settled = ordered.withColumn("more", one_more.cast("int"))
    # Without a cut the source's left-over is nothing, or all of it.
    whole = F.when(F.col("left_over") <= 0, F.lit(0)).when(F.col("cut_slice").isNull(), F.lit(1)).otherwise((F.col("slice") < F.col("cut_slice")).cast("int"))
    others = known.where(~F.coalesce(at_cut, F.lit(False))).withColumn("more", whole)
    copies = F.least(F.col("sure") + F.col("more"), F.lit(most_copies))
    return settled.unionByName(others).select(
        "row", "id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns."""
    number = free_name(docs.columns, "__row")
    taken = mix(docs, id_col, text_col, source_col, **options).where("copies > 0")
    taken = taken.select(F.col("row").alias(f"{number}_taken"), F.col("copies").alias(f"{number}_copies"))
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    repeated = numbered.join(taken, F.col(number) == F.col(f"{number}_taken"))
    each = F.sequence(F.lit(1), F.col(f"{number}_copies"))
    return repeated.withColumn(f"{number}_copy", F.explode(each)).select(*(F.col(f"`{c}`") for c in docs.columns))
