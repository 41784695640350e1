"""Targets, stationary features and sentiment features."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.expressions import (
    distance,
    finite,
    high_low_range,
    open_close_return,
    ratio,
    sentiment_delta,
    sentiment_impact,
    volume_spike,
)
from tidewire.operators.recurrence import ewma_adjusted
from tidewire.operators.series import (
    COUNT,
    POS,
    diff,
    drop_helpers,
    forward_sum,
    over_series,
    rolling,
    with_positions,
)
from tidewire.schemas import numeric_columns, q, require_columns

TARGET = "target_forward_return"
STATIONARY = (
    "open_close_return",
    "high_low_range",
    "ema_20_dist",
    "sma_50_dist",
    "sma_200_dist",
    "log_volume_change",
    "relative_volume_20",
    "atr_14_pct",
    "obv_change_normalized",
    "macd_pct",
    "macd_hist_pct",
)


def add_forward_target(
    df: DataFrame, days: int = 5, single: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Sum of the next ``days`` daily returns. ``single`` (W6) leaves the first days-1 NULL too."""
    keep_pos = (*keep, POS) if single else keep
    out = over_series(
        df,
        lambda w: {TARGET: forward_sum(F.col("daily_return_pct"), w, days)},
        after=days,
        keep=keep_pos,
    )
    if single:
        out = out.withColumn(TARGET, F.when(F.col(POS) >= days - 1, F.col(TARGET)))
        if POS not in keep:
            out = out.drop(POS)
    return out


def drop_missing_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """P5."""
    return df.dropna(subset=[target])


def drop_incomplete(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Infinities and NaN become NULL, then rows with a NULL in ``columns`` (default all) go."""
    names = set(df.columns if columns is None else columns)
    doubles = {
        f.name
        for f in df.schema.fields
        if f.name in names and f.dataType.simpleString() in ("double", "float")
    }
    cleaned = df.select(
        *[finite(q(c)).alias(c) if c in doubles else q(c) for c in df.columns]
    )
    return cleaned.dropna("any", subset=[c for c in df.columns if c in names])


def fill_zero(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NULL becomes 0 in the given (default: all numeric) columns."""
    names = numeric_columns(df) if columns is None else list(columns)
    return df.fillna(0, subset=names)


def _volume_frames(w) -> dict[str, Column]:
    mean_volume = rolling(F.avg, F.col("volume"), w, 20)
    return {
        "log_volume_change": diff(F.log1p("volume"), w),
        "relative_volume_20": ratio(F.col("volume"), mean_volume),
        "obv_change_normalized": ratio(diff(F.col("obv"), w), mean_volume),
    }


def _row_features(df: DataFrame) -> DataFrame:
    close = F.col("close_px")
    return df.withColumns(
        {
            "open_close_return": open_close_return(F.col("open_px"), close),
            "high_low_range": high_low_range(F.col("high_px"), F.col("low_px"), close),
            "ema_20_dist": distance(close, F.col("ema_20")),
            "sma_50_dist": distance(close, F.col("sma_50")),
            "sma_200_dist": distance(close, F.col("sma_200")),
            "atr_14_pct": ratio(F.col("atr_14"), close),
            "macd_pct": ratio(F.col("macd"), close),
            "macd_hist_pct": ratio(F.col("macd_hist"), close),
        }
    )


_INDICATORS = ("open_px", "close_px", "ema_20", "sma_50", "sma_200", "atr_14", "obv", "macd")


def stationary_features(df: DataFrame, strict: bool = False) -> DataFrame:
    """Scale-free features, then rows where one is missing are dropped.

    ``strict`` drops rows with a NULL in any column, so days without news vanish as well.
    """
    require_columns(df, _INDICATORS)
    out = _row_features(over_series(df, _volume_frames, before=19))
    return drop_incomplete(out, None if strict else STATIONARY)


def labelled_features(df: DataFrame, days: int = 5, strict: bool = False) -> DataFrame:
    """W5, P5, X4 and P6 in one pass over the series.

    Looking back before or after P5's drop is the same here: with valid prices only the last
    ``days`` rows of a series lack a target, and nothing looks back at those.
    """
    require_columns(df, _INDICATORS)

    def frames(w):
        return {
            TARGET: forward_sum(F.col("daily_return_pct"), w, days),
            **_volume_frames(w),
        }

    out = _row_features(over_series(df, frames, before=19, after=days))
    return drop_incomplete(drop_missing_target(out), None if strict else STATIONARY)


def sentiment_features(df: DataFrame, kind: str = "llm", fill: bool = True) -> DataFrame:
    """Memory, impact, surprise; for ``finbert`` also news spike and volatility.

    ``fill`` turns what is left NULL into 0 (P7).
    """
    if kind not in ("llm", "finbert"):
        raise ValueError("kind is 'llm' or 'finbert'")
    score = F.col(f"{kind}_score")
    lead = "llm_" if kind == "llm" else ""
    numbered = with_positions(df)
    if kind == "finbert":
        numbered = over_series(
            numbered,
            lambda w: {
                "news_volume_spike": volume_spike(
                    F.col("news_count"), rolling(F.avg, F.col("news_count"), w, 20, 1)
                ),
                "sentiment_volatility": rolling(F.stddev_samp, score, w, 5, 1),
            },
            before=19,
            keep=(POS, COUNT),
        )
    ewma = f"{kind}_ewma_5"
    out = ewma_adjusted(numbered, f"{kind}_score", 5, ewma)
    out = drop_helpers(out).withColumns(
        {
            f"{lead}sentiment_impact": sentiment_impact(score, F.col("news_count")),
            f"{lead}sentiment_delta": sentiment_delta(score, F.col(ewma)),
        }
    )
    return fill_zero(out) if fill else out


def one_hot(df: DataFrame, levels: Sequence[str], column: str = "ticker") -> DataFrame:
    """One 0/1 int column ``<column>_<value>`` per given value, names sorted; the column is kept.

    The values are part of the schema, so the caller names them. Where they are not known, or
    too many for columns, ``one_hot_vector`` takes them from the data.
    """
    return df.select(
        "*",
        *[
            F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}")
            for v in sorted(levels)
        ],
    )


def one_hot_vector(df: DataFrame, column: str = "ticker", output: str = "ticker_vec") -> DataFrame:
    """X27 for any number of values: a sparse vector column; for NULL it is all zeros."""
    indexer = StringIndexer(
        inputCol=column, outputCol="_index", stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(df)
    if not indexer.labels:
        return df.withColumn(output, array_to_vector(F.array().cast("array<double>")))
    # The place that the indexer keeps for NULL is the one that is left out.
    encoder = OneHotEncoder(inputCols=["_index"], outputCols=[output], dropLast=True)
    indexed = indexer.transform(df)
    return encoder.fit(indexed).transform(indexed).drop("_index")
