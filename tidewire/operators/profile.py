"""Column profile: missing values, summary, outliers, skew, scaler advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.expressions import finite
from tidewire.operators.quantiles import exact_quantiles, quantile_map
from tidewire.schemas import numeric_columns, q

QUARTILES = (0.25, 0.5, 0.75)


def _per_column(df: DataFrame, columns: Sequence[str], stats) -> DataFrame:
    """One aggregate over all columns, turned into one row per column.

    ``stats(column)`` gives the aggregates of one column, all aliased.
    """
    structs = [F.struct(F.lit(c).alias("feature"), *stats(q(c))) for c in columns]
    return df.agg(F.array(*structs).alias("_all")).select(F.inline("_all"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A4: columns with missing values and how many."""
    return _per_column(
        df,
        df.columns if columns is None else columns,
        lambda c: [F.count_if(c.isNull()).alias("missing")],
    ).filter("missing > 0")


def column_info(df: DataFrame) -> DataFrame:
    """Type, non-NULL count and row count per column."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = _per_column(
        df,
        df.columns,
        lambda c: [F.count(c).alias("non_null"), F.count(F.lit(1)).alias("row_count")],
    )
    names = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return out.withColumn("data_type", F.element_at(names, F.col("feature")))


def describe(
    df: DataFrame, columns: Sequence[str] | None = None, quartiles: Column | None = None
) -> DataFrame:
    """A5: count, mean, sample deviation, min, exact quartiles, max per numeric column.

    ``quartiles`` is a map that another step has asked for already (see ``profile``).
    """
    columns = numeric_columns(df) if columns is None else list(columns)

    def stats(c: Column) -> list[Column]:
        x = finite(c)
        return [
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        ]

    if quartiles is None:
        quartiles = quantile_map(exact_quantiles(df, columns, QUARTILES))
    return (
        _per_column(df, columns, stats)
        .withColumn("_q", F.try_element_at(quartiles, F.col("feature")))
        .select(
            "feature",
            "count",
            "mean",
            "std",
            "min",
            *[
                F.try_element_at("_q", F.lit(p)).alias(f"p{int(p * 100)}")
                for p in QUARTILES
            ],
            "max",
        )
    )


def outlier_percent(
    df: DataFrame, columns: Sequence[str] | None = None, quartiles: Column | None = None
) -> DataFrame:
    """Share of all rows (also those with a NULL) outside the 1.5-IQR fences, in percent."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if quartiles is None:
        quartiles = quantile_map(exact_quantiles(df, columns, (0.25, 0.75)))
    fences = df.select(*[finite(q(c)).alias(c) for c in columns]).withColumn("_q", quartiles)
    flagged = []
    for c in columns:
        both = F.try_element_at(F.col("_q"), F.lit(c))
        q1, q3 = (F.try_element_at(both, F.lit(p)) for p in (0.25, 0.75))
        reach = (q3 - q1) * 1.5
        flagged.append(((q(c) < q1 - reach) | (q(c) > q3 + reach)).alias(c))
    return _per_column(
        fences.select(*flagged),
        columns,
        lambda out: [
            F.try_divide(F.count_if(out) * F.lit(100.0), F.count(F.lit(1))).alias("outlier_percent")
        ],
    )


def skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected skewness; NULL below three values."""
    columns = numeric_columns(df) if columns is None else list(columns)

    def stats(c: Column) -> list[Column]:
        x = finite(c)
        n = F.count(x).cast("double")
        corrected = F.skewness(x) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
        return [F.when(n >= 3, corrected).alias("skew")]

    return _per_column(df, columns, stats)


def scaler_advice(profile: DataFrame) -> DataFrame:
    """Which scaler the outlier share and the skew speak for."""
    outliers, skew = F.col("outlier_percent"), F.abs("skew")
    return profile.withColumns(
        {
            "outlier_advice": F.when(outliers > 1, "robust")
            .when(outliers == 0, "standard")
            .otherwise("either"),
            "skew_advice": F.when(skew > 1, "robust")
            .when(skew <= 0.5, "standard")
            .otherwise("either"),
        }
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A5-A8 as one table, one row per numeric column; the quartiles are found once."""
    columns = numeric_columns(df) if columns is None else list(columns)
    quartiles = quantile_map(exact_quantiles(df, columns, QUARTILES))
    joined = (
        describe(df, columns, quartiles)
        .join(outlier_percent(df, columns, quartiles), "feature")
        .join(skewness(df, columns), "feature")
    )
    return scaler_advice(joined)
