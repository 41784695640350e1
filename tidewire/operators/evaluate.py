"""Forecast metrics and the trading backtest (A10-A20, M9, X24-X26 as tables).

Input: predictions with ``y`` (actual forward return) and ``y_hat``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.expressions import implied_price, strategy_return, trading_signal
from tidewire.operators.quantiles import average_ranks, exact_quantiles
from tidewire.schemas import q

TRADING_DAYS = 252


def _regression() -> list[Column]:
    error = F.col("y") - F.col("y_hat")
    squares = F.sum(error * error)
    spread = F.var_pop("y") * F.count("y")
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(squares, spread)).alias("r2"),
    ]


def _direction() -> Column:
    same = F.signum("y") == F.signum("y_hat")
    return (F.avg(same.cast("double")) * 100).alias("directional_accuracy")


def _backtest(days: int, ret: str = "ret", signal: str = "signal") -> list[Column]:
    per_year = TRADING_DAYS / days
    mean, spread = F.avg(ret), F.stddev_pop(ret)
    moving = spread != 0
    zero = F.lit(0.0)
    return [
        (F.avg((F.col(signal) != 0).cast("double")) * 100).alias("time_in_market"),
        F.when(moving, mean * per_year).otherwise(zero).alias("annualized_return"),
        F.when(moving, spread * math.sqrt(per_year)).otherwise(zero).alias("annualized_volatility"),
        F.when(moving, F.try_divide(mean * per_year, spread * math.sqrt(per_year)))
        .otherwise(zero)
        .alias("sharpe_ratio"),
    ]


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """A10."""
    return predictions.agg(*_regression())


def directional_accuracy(predictions: DataFrame) -> DataFrame:
    """Percent of rows whose signs agree (0 agrees with 0)."""
    return predictions.agg(_direction())


def information_coefficient(predictions: DataFrame) -> DataFrame:
    """Spearman correlation of ``y_hat`` and ``y``, and its two-sided p-value.

    Equal pairs are counted first; ranks belong to distinct values and come back by two
    equi-joins. The p-value is computed on the one result row.
    """
    pairs = (
        predictions.select(
            (F.col("y") + 0.0).alias("y"), (F.col("y_hat") + 0.0).alias("y_hat")
        )
        .dropna()
        .groupBy("y", "y_hat")
        .agg(F.count("*").alias("same"))
    )

    def ranks(column: str) -> DataFrame:
        counted = pairs.groupBy(F.col(column).alias("v")).agg(F.sum("same").alias("same"))
        ranked = average_ranks(counted.withColumn("feature", F.lit(column)))
        return ranked.select(
            F.col("v").alias(column), F.col("rank").alias(f"{column}_rank"), "n"
        )

    ranked = pairs.join(ranks("y"), "y").join(ranks("y_hat").drop("n"), "y_hat")
    middle = (F.col("n") + 1) / 2
    a, b = F.col("y_rank") - middle, F.col("y_hat_rank") - middle
    c = F.col("same")
    ic = F.try_divide(F.sum(c * a * b), F.sqrt(F.sum(c * a * a) * F.sum(c * b * b)))
    out = ranked.agg(ic.alias("ic"), F.sum("same").alias("n"))
    return out.withColumn("p_value", two_sided_p(F.col("ic"), F.col("n")))


def two_sided_p(r: Column, n: Column) -> Column:
    """p-value of a correlation under Student's t with n-2 degrees of freedom."""

    def p_value(r_value: float | None, count: int | None) -> float | None:
        if r_value is None or count is None or count < 3:
            return None
        if abs(r_value) >= 1:
            return 0.0
        df = count - 2
        return _incomplete_beta(df / 2, 0.5, 1 - r_value * r_value)

    # One row: the result of the aggregate.
    return F.udf(p_value, "double", useArrow=False)(r, n)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        last = total
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(total - last) < 1e-15 * abs(total):
            break
    return front * total / a


def _positions(df: DataFrame, features: Sequence[str] | str, *others: Column) -> DataFrame:
    """(place, x, others) for every row and feature; ``features`` are columns or one array column.

    The plan has one generator however wide the vector is, and aggregates per place shrink before
    the shuffle to one row per place and task.
    """
    vector = q(features) if isinstance(features, str) else F.array(*[q(c).cast("double") for c in features])
    return df.select(*others, F.posexplode(vector).alias("place", "x"))


def feature_correlation(df: DataFrame, features: Sequence[str] | str, y: str = "y") -> DataFrame:
    """(feature, corr), the Pearson correlation of each feature with the target.

    ``features`` are columns, or the name of one array column: then ``feature`` is the place from
    0. Rows where either side is NULL do not count; a feature without any, or one that never
    changes there, has NULL.
    """
    x, target = F.when(F.col("y").isNotNull(), F.col("x")), F.when(F.col("x").isNotNull(), F.col("y"))
    spreads = F.stddev_pop(x) * F.stddev_pop(target)
    corr = F.try_divide(F.covar_pop(x, target), spreads).alias("corr")
    found = _positions(df, features, q(y).alias("y")).groupBy("place").agg(corr)
    if isinstance(features, str):
        return found.withColumnRenamed("place", "feature")
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "place int, feature string")
    return names.join(found, "place", "left").select("feature", "corr")


def dead_features(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    """How many features never change, and how many there are (the longest vector's)."""
    spread = _positions(df, features).groupBy("place").agg((F.var_pop("x") == 0).alias("dead"))
    width = F.max("place") + 1 if isinstance(features, str) else F.lit(len(features))
    return spread.agg(
        F.count_if("dead").cast("int").alias("dead_features"), F.coalesce(width, F.lit(0)).alias("features")
    )


def thresholds(predictions: DataFrame, upper: float = 75, lower: float = 25) -> DataFrame:
    """One row, the exact upper and lower percentile of all predictions."""
    qs = exact_quantiles(predictions, ["y_hat"], (upper / 100, lower / 100))

    def at(p: float, name: str) -> Column:
        return F.max(F.when(F.col("p") == p / 100, F.col("value"))).alias(name)

    return qs.agg(at(upper, "upper_threshold"), at(lower, "lower_threshold"))


def with_signals(
    predictions: DataFrame,
    upper: float = 75,
    lower: float = 25,
    floor: float | None = None,
) -> DataFrame:
    """X24, X25 with A15's thresholds: adds both thresholds, ``signal`` and ``ret``."""
    t = thresholds(predictions, upper, lower).select(F.struct("*")).scalar()
    marked = predictions.withColumn("_t", t).select(*predictions.columns, "_t.*").withColumn(
        "signal",
        trading_signal(F.col("y_hat"), F.col("upper_threshold"), F.col("lower_threshold")),
    )
    return marked.withColumn("ret", strategy_return(F.col("signal"), F.col("y"), floor))


def backtest(signals: DataFrame, days: int = 5) -> DataFrame:
    """A16, A17. Overlapping returns are annualised as if independent, risk-free rate 0."""
    return signals.agg(*_backtest(days))


def percentile_sweep(
    predictions: DataFrame,
    percents: Sequence[int] = (70, 75, 80, 85, 90, 95),
    days: int = 5,
) -> DataFrame:
    """The backtest for several upper percentiles (lower = 100 - upper), all in one pass.

    Each percentile is a pair of columns beside the row, not a copy of it.
    """
    probs = sorted({p / 100 for p in percents} | {(100 - p) / 100 for p in percents})
    qs = exact_quantiles(predictions, ["y_hat"], probs)
    cuts = [F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"c{i}") for i, p in enumerate(probs)]
    table = qs.agg(*cuts).select(F.struct("*")).scalar()

    def cut(p: float) -> Column:
        return F.col("_cuts")[f"c{probs.index(p)}"]

    marked = predictions.select("y", "y_hat", table.alias("_cuts"))
    signals = {f"signal_{p}": trading_signal(F.col("y_hat"), cut(p / 100), cut((100 - p) / 100)) for p in percents}
    marked = marked.withColumns(signals)
    marked = marked.withColumns({f"ret_{p}": strategy_return(F.col(f"signal_{p}"), F.col("y")) for p in percents})
    rows = [F.struct(F.lit(p).alias("pct"), *_backtest(days, f"ret_{p}", f"signal_{p}")) for p in percents]
    return marked.agg(F.array(*rows).alias("_all")).select(F.inline("_all"))


def best_of_sweep(sweep: DataFrame) -> DataFrame:
    """The row with the highest positive Sharpe ratio (the lowest percentile on a tie)."""
    return sweep.filter("sharpe_ratio > 0").orderBy(F.desc("sharpe_ratio"), "pct").limit(1)


def split_report(df: DataFrame, by_ticker: bool = False, date: str = "trade_date") -> DataFrame:
    """First and last date and rows per split (and ticker)."""
    keys = ["split", "ticker"] if by_ticker else ["split"]
    return df.groupBy(*keys).agg(
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count("*").alias("n_rows"),
    )


def sample_report(signals: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` predictions with signal text and percents."""
    text = F.when(F.col("signal") > 0, "LONG").when(F.col("signal") < 0, "SHORT").otherwise("CASH")
    return signals.orderBy(*order).limit(n).select(
        *order,
        text.alias("signal_text"),
        (F.col("y_hat") * 100).alias("predicted_pct"),
        (F.col("y") * 100).alias("actual_pct"),
        (F.col("ret") * 100).alias("profit_pct"),
    )


def evaluation_report(
    predictions: DataFrame,
    upper: float = 75,
    lower: float = 25,
    days: int = 5,
    floor: float | None = None,
) -> DataFrame:
    """M9: A10-A12 and A15-A17 in one row."""
    signals = with_signals(predictions, upper, lower, floor)
    main = signals.agg(
        *_regression(),
        _direction(),
        *_backtest(days),
        F.first("upper_threshold").alias("upper_threshold"),
        F.first("lower_threshold").alias("lower_threshold"),
    )
    ic = information_coefficient(predictions).select(F.struct("ic", "p_value")).scalar()
    return main.withColumn("_ic", ic).select(*main.columns, "_ic.*")


def price_table(predictions: DataFrame) -> DataFrame:
    """Actual and predicted price per row, from the label row's close."""
    return predictions.withColumns(
        {
            "actual_price": implied_price(F.col("close_px"), F.col("y")),
            "predicted_price": implied_price(F.col("close_px"), F.col("y_hat")),
        }
    )
