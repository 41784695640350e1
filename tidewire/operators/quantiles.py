"""Exact order statistics and ranks over whole columns, without a single-task sort.

Values fall into bins by a fixed, order-preserving function (2**14 steps per power of two).
Counting per bin shrinks before the shuffle; the running sum over bins tells which bin holds a
wanted place. Only rows of those bins are looked at again. Values may crowd in one bin, so each
bin is cut once more into 2**16 equal steps between its own smallest and largest value before
values are put in order. Nothing is collected into one task, and the result is exact whatever
the distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.expressions import finite
from tidewire.schemas import q

STEPS = 2**14
SUB_STEPS = 2**16


def order_bin(v: Column) -> Column:
    """Bin number of a finite double: grows with it or stays, never falls.

    The logarithm, the product and ``floor`` are all monotone in floating point, so a bin holds
    one stretch of values whatever the rounding.
    """
    # 1075 octaves reach below the smallest double; zero is a bin of its own.
    number = F.floor((F.log2(F.abs(v)) + 1075.0) * STEPS) + 1
    return F.when(v == 0, F.lit(0)).when(v > 0, number).otherwise(-number).cast("long")


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, v) rows of the finite values of several columns."""
    doubles = df.select(*[finite(q(c)).alias(c) for c in columns])
    return doubles.unpivot([], [q(c) for c in columns], "feature", "v").filter(
        F.col("v").isNotNull()
    )


def _bin_totals(binned: DataFrame, rows: Column) -> DataFrame:
    """Per (feature, bin): its range, rows in smaller bins, and rows of the feature in all.

    Bins are added up per power of two first; there are a few thousand of these at most, whatever
    the data. The running sum over a feature only goes over them, and inside each over its own
    ``STEPS`` bins, so no task holds all bins of a column.
    """
    counts = (
        binned.withColumn("octave", F.floor(F.col("bin") / STEPS))
        .groupBy("feature", "octave", "bin")
        .agg(rows.alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    per_feature = Window.partitionBy("feature")
    smaller = per_feature.orderBy("octave").rowsBetween(Window.unboundedPreceding, -1)
    octaves = counts.groupBy("feature", "octave").agg(F.sum("rows").alias("_rows"))
    offsets = octaves.select(
        "feature",
        "octave",
        F.coalesce(F.sum("_rows").over(smaller), F.lit(0)).alias("_below"),
        F.sum("_rows").over(per_feature).alias("n"),
    )
    inside = Window.partitionBy("feature", "octave").orderBy("bin")
    here = F.sum("rows").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        counts.withColumn("_here", F.coalesce(here, F.lit(0)))
        .join(offsets, ["feature", "octave"])
        .select(
            "feature", "bin", "rows", "low", "high", (F.col("_below") + F.col("_here")).alias("before"), "n"
        )
    )


def _with_places(values: DataFrame) -> DataFrame:
    """Distinct values of bins, with ``same``, ``before``, ``low``, ``high``: add ``upto``.

    ``upto`` is the number of the feature's rows up to and including the value.
    """
    share = F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low"))
    cut = values.withColumn(
        "sub", F.coalesce(F.floor(share * SUB_STEPS), F.lit(0)).cast("long")
    ).drop("low", "high")
    by_bin = Window.partitionBy("feature", "bin").orderBy("sub")
    totals = cut.groupBy("feature", "bin", "sub").agg(F.sum("same").alias("_rows"))
    totals = totals.select(
        "feature",
        "bin",
        "sub",
        F.coalesce(
            F.sum("_rows").over(by_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_smaller"),
    )
    inside = (
        Window.partitionBy("feature", "bin", "sub")
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = cut.withColumn("_here", F.sum("same").over(inside))
    return (
        placed.join(totals, ["feature", "bin", "sub"])
        .withColumn("upto", F.col("before") + F.col("_smaller") + F.col("_here"))
        .drop("sub", "_smaller", "_here")
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """(feature, p, value): linear interpolation between the two neighbouring values."""
    binned = long_form(df, columns).withColumn("bin", order_bin(F.col("v")))
    spot = "(n - 1) * p"
    places = (
        _bin_totals(binned, F.count("*"))
        .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("place", F.expr(f"explode(array(floor({spot}), ceil({spot})))"))
        .filter("place >= before and place < before + rows")
    )
    # At most two bins per feature and probability: always small enough to broadcast.
    wanted = places.groupBy("feature", "bin", "before", "low", "high", "n").agg(
        F.collect_set(F.struct("p", "place")).alias("spots")
    )
    # Values are counted before the places join them: a bin may hold hundreds of places, and as a
    # part of the key each row would carry and compare them all.
    values = (
        binned.join(F.broadcast(wanted.select("feature", "bin")), ["feature", "bin"], "left_semi")
        .groupBy("feature", "bin", "v")
        .agg(F.count("*").alias("same"))
        .join(F.broadcast(wanted), ["feature", "bin"])
    )
    picked = (
        _with_places(values)
        .withColumn("spot", F.explode("spots"))
        .select("feature", "v", "n", "upto", "same", "spot.*")
        .filter("place < upto and place >= upto - same")
    )
    share = F.first(F.expr(f"{spot} % 1"))
    low, high = F.min("v"), F.max("v")
    return picked.groupBy("feature", "p").agg((low + (high - low) * share).alias("value"))


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = 10000
) -> DataFrame:
    """Opt-in: (feature, p, value) from ``percentile_approx``, one pass."""
    probs = [float(p) for p in probabilities]
    values = F.percentile_approx("v", probs, accuracy)
    return (
        long_form(df, columns)
        .groupBy("feature")
        .agg(F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("p"), values.alias("v")).alias("z"))
        .select("feature", F.inline("z").alias("p", "value"))
    )


def quantile_map(quantiles: DataFrame) -> Column:
    """All quantiles as one scalar map feature -> (p -> value); its size is set by the schema."""
    per_feature = quantiles.groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("p", "value"))).alias("qs")
    )
    return per_feature.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "qs")))
    ).scalar()


def average_ranks(values: DataFrame) -> DataFrame:
    """Ranks of distinct values: (feature, v, same) -> (feature, v, rank, n); ties share the mean.

    ``same`` is how often a value occurs.
    """
    binned = values.withColumn("bin", order_bin(F.col("v")))
    totals = _bin_totals(binned, F.sum("same")).drop("rows")
    placed = _with_places(binned.join(totals, ["feature", "bin"]))
    return placed.select("feature", "v", F.expr("upto - (same - 1) / 2").alias("rank"), "n")
