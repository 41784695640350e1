"""Declared schemas and the required-column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEWS_RAW = T.StructType(
    [
        T.StructField("pub_time", T.TimestampNTZType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("sentiment_score", T.DoubleType()),
    ]
)

OHLCV = T.StructType(
    [
        T.StructField("trade_date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("open_px", T.DoubleType()),
        T.StructField("high_px", T.DoubleType()),
        T.StructField("low_px", T.DoubleType()),
        T.StructField("close_px", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)

# Column sets a scorer adds to a cleaned article.
CLASSIFIER_SCORES = (
    "finbert_positive",
    "finbert_negative",
    "finbert_neutral",
    "finbert_confidence",
    "finbert_score",
)
ANSWER_SCORES = (
    "llm_positive",
    "llm_negative",
    "llm_neutral",
    "llm_confidence",
    "llm_score",
    "llm_relevance",
    "llm_impact_magnitude",
    "llm_uncertainty",
)

# Inputs of the tree and sequence models.
TECHNICAL_FEATURES = (
    "daily_return_pct",
    "open_close_return",
    "high_low_range",
    "ema_20_dist",
    "macd_hist_pct",
    "rsi_14",
    "atr_14_pct",
    "bbp_20_2",
    "obv_change_normalized",
    "log_volume_change",
)
ANSWER_FEATURES = (
    "llm_score",
    "llm_relevance",
    "llm_impact_magnitude",
    "llm_uncertainty",
    "news_count",
    "llm_ewma_5",
    "llm_sentiment_impact",
    "llm_sentiment_delta",
)
CLASSIFIER_FEATURES = ("finbert_score", "news_count", "finbert_ewma_5", "sentiment_impact")


class MissingColumns(ValueError):
    """Raised before any job starts when an input lacks columns."""


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """Fail early with the sorted names of the missing columns."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return df


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns, in schema order."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def q(name: str):
    """A column by its literal name (names with dots, blanks or dashes are quoted)."""
    return F.col("`" + name.replace("`", "``") + "`")
