"""Splits, scaling, look-back sequences, hybrid rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.expressions import finite
from tidewire.operators.features import TARGET
from tidewire.operators.quantiles import exact_quantiles
from tidewire.operators.series import BLOCK, CORE, COUNT, POS, with_blocks, with_positions
from tidewire.schemas import q


def split_by_row(df: DataFrame, train: float = 0.9) -> DataFrame:
    """M1: the first ``int(n * train)`` rows of each series are train, the rest test.

    Rows without ticker or date belong to neither (NULL).
    """
    numbered = with_positions(df)
    cut = F.floor(F.col(COUNT) * F.lit(train))
    return numbered.withColumn(
        "split", F.when(F.col(POS) < cut, "train").when(F.col(POS) >= cut, "test")
    ).drop(POS, COUNT)


def split_bounds(
    df: DataFrame,
    train: float = 0.8,
    val: float = 0.9,
    warmup: int = 0,
    date: str = "trade_date",
) -> DataFrame:
    """M2, M3: one row with the boundary dates, taken by place among the distinct dates.

    The list of distinct dates is bounded by the calendar, not by the data.
    """
    dates = df.select(F.col(date).alias("d")).distinct().agg(
        F.sort_array(F.collect_list("d")).alias("ds")
    )
    n = F.size("ds")
    train_at = F.floor(n * F.lit(train)).cast("int")
    val_at = F.floor(n * F.lit(val)).cast("int")

    def at(i):
        return F.try_element_at("ds", F.greatest(i, F.lit(0)) + 1)

    return dates.select(
        at(train_at).alias("train_end"),
        at(val_at).alias("val_end"),
        at(train_at - warmup).alias("val_start"),
        at(val_at - warmup).alias("test_start"),
    )


def split_by_date(
    df: DataFrame,
    train: float = 0.8,
    val: float = 0.9,
    warmup: int = 0,
    date: str = "trade_date",
) -> DataFrame:
    """M2; with ``warmup`` > 0 M3: val and test begin that many dates earlier.

    A warm-up row belongs to two splits and comes out twice, once per value of ``split``.
    """
    bounds = split_bounds(df, train, val, warmup, date).select(F.struct("*")).scalar()
    b, d = F.col("_bounds"), F.col(date)
    names = F.array_compact(
        F.array(
            F.when(d < b["train_end"], "train"),
            F.when((d >= b["val_start"]) & (d < b["val_end"]), "val"),
            F.when(d >= b["test_start"], "test"),
        )
    )
    return df.withColumn("_bounds", bounds).withColumn("split", F.explode(names)).drop("_bounds")


def fit_scaler(train: DataFrame, columns: Sequence[str], method: str = "robust") -> DataFrame:
    """M4: (feature, center, scale) from the train rows: median and IQR, or mean and deviation.

    A spread of 0 becomes 1. One row per feature.
    """
    if method == "robust":
        qs = exact_quantiles(train, columns, (0.25, 0.5, 0.75))

        def at(p):
            return F.max(F.when(F.col("p") == p, F.col("value")))

        fitted = qs.groupBy("feature").agg(at(0.5).alias("center"), (at(0.75) - at(0.25)).alias("scale"))
    elif method == "standard":
        rows = F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.avg(finite(q(c))).alias("center"),
                    F.stddev_pop(finite(q(c))).alias("scale"),
                )
                for c in columns
            ]
        )
        fitted = train.agg(rows.alias("_all")).select(F.inline("_all"))
    else:
        raise ValueError("method is 'robust' or 'standard'")
    return fitted.withColumn(
        "scale", F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale"))
    )


def apply_scaler(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M4: ``(x - center) / scale``; the parameters travel as one row with a field per column."""
    parts = []
    for i, c in enumerate(columns):
        own = F.col("feature") == c
        parts += [F.max(F.when(own, F.col("center"))).alias(f"c{i}"), F.max(F.when(own, F.col("scale"))).alias(f"s{i}")]
    table = fitted.agg(*parts).select(F.struct("*")).scalar()
    done = {
        c: F.try_divide(q(c) - F.col("_fitted")[f"c{i}"], F.col("_fitted")[f"s{i}"])
        for i, c in enumerate(columns)
    }
    return df.withColumn("_fitted", table).withColumns(done).drop("_fitted")


def sequences(
    df: DataFrame,
    features: Sequence[str],
    lookback: int = 20,
    news: Sequence[str] = (),
    target: str = TARGET,
    group: Sequence[str] = ("ticker",),
    extra: Sequence[str] = (),
    horizon_gap: int = 1,
    vectors: Sequence[str] = (),
) -> DataFrame:
    """Per label row the ``lookback`` feature rows up to ``horizon_gap`` rows before it.

    ``seq`` is array<array<double>>, ``tech`` its last step, ``news_vec`` the news of that last
    step, ``y`` the label row's target. With a gap of 1 the window ends the day before the label's
    own day, with 0 on that day. ``vectors`` names ML vector columns whose values follow the
    features in each step. Series shorter than the look-back give nothing. For several splits put
    ``split`` in ``group``.
    """
    if horizon_gap < 0:
        raise ValueError("the window cannot end after the label's row")
    parts = [F.array(*[q(c).cast("double") for c in features]), *[vector_to_array(q(c)) for c in vectors]]
    step = F.concat(*parts) if vectors else parts[0]
    told = list(dict.fromkeys([*group, "ticker", "trade_date"]))
    inner = [c for c in dict.fromkeys([*told, *extra]) if c not in group]
    held = F.struct(
        POS, CORE, *[q(c) for c in inner], step.alias("_step"), q(target).alias("_y"),
        F.array(*[q(c).cast("double") for c in news]).alias("_news"),
    )
    needed = list(dict.fromkeys([*told, *extra, *features, *vectors, *news, target]))
    numbered = with_positions(df.select(*[q(c) for c in needed]), group).filter(F.col(POS).isNotNull())
    laid = with_blocks(numbered, before=lookback + horizon_gap - 1)
    # One array per block: every row's steps are in the shuffle once, but for the few copies.
    blocks = laid.groupBy(*group, BLOCK).agg(F.array_sort(F.collect_list(held)).alias("_rows"))
    rows = F.col("_rows")

    def window(row: Column, i: Column) -> Column:
        steps = F.slice(rows, i - (lookback + horizon_gap - 2), F.lit(lookback))["_step"]
        last = F.get(rows, i - horizon_gap)
        out = [*[row[c].alias(c) for c in inner], steps.alias("seq"), last["_step"].alias("tech")]
        out += [last["_news"].alias("news_vec")] if news else []
        return F.when(row[CORE] & (i >= lookback + horizon_gap - 1), F.struct(*out, row["_y"].alias("y")))

    windows = blocks.select(*group, F.inline(F.array_compact(F.transform(rows, window))))
    return windows.select(*told, *[q(c) for c in extra], "seq", "tech", *(["news_vec"] if news else []), "y")


def assemble_hybrid(
    latent: DataFrame, seqs: DataFrame, key: Sequence[str] = ("ticker", "trade_date")
) -> DataFrame:
    """Latent vector, last technical step and news vector as one feature array.

    ``latent`` has the key and an array column ``latent``.
    """
    parts = ["latent", "tech", *(["news_vec"] if "news_vec" in seqs.columns else [])]
    joined = latent.join(seqs, list(key))
    return joined.select(*key, F.concat(*parts).alias("features"), "y")
