"""The end-to-end paths as plans over stored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from tidewire.operators import asof, dataset, features, indicators, news
from tidewire.operators.series import COUNT, POS
from tidewire.schemas import (
    ANSWER_FEATURES,
    ANSWER_SCORES,
    CLASSIFIER_FEATURES,
    CLASSIFIER_SCORES,
    TECHNICAL_FEATURES,
)
from tidewire.session import materialise

SCORES = {"llm": ANSWER_SCORES, "finbert": CLASSIFIER_SCORES}
TICKER_VECTOR = "ticker_vec"
NEWS_FEATURES = {"llm": ANSWER_FEATURES, "finbert": CLASSIFIER_FEATURES}


def news_to_daily(
    files: Sequence[DataFrame], score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Merge, clean, score, roll up. ``score`` is costly, so its result is written once."""
    scored = materialise(score(news.clean_news(news.merge_news(files))), "scored")
    return asof.group_news_by_date(scored)


def feature_table(bars: DataFrame, daily: DataFrame, kind: str = "llm") -> DataFrame:
    """Indicators, target and stationary features of each bar, with the mapped sentiment beside.

    The features do not look at the sentiment, so the join comes last and stays one equi-join.
    """
    market = indicators.add_indicators(bars, keep=(POS, COUNT))
    labelled = features.labelled_features(market)
    mapped = asof.aggregate_mapped(asof.map_to_market_days(daily, bars), f"{kind}_")
    return asof.join_market(labelled, mapped)


def model_table(
    bars: DataFrame,
    daily: DataFrame,
    kind: str = "llm",
    strict: bool = False,
    tickers: Sequence[str] | None = None,
) -> DataFrame:
    """E3 up to the split: feature table, sentiment features, NULL to 0, one-hot tickers.

    With ``tickers`` named, each becomes a 0/1 column ``ticker_<name>``; otherwise the vector
    column ``ticker_vec`` holds all that occur, however many.
    ``strict`` drops days without news, as a drop over all columns after the join does.
    Sentiment memory counts rows that are left, so the table is written before it is numbered.
    """
    joined = feature_table(bars, daily, kind)
    if strict:
        joined = features.drop_incomplete(joined)
    stored = materialise(joined, "features")
    remembered = features.sentiment_features(stored, kind)
    if tickers is not None:
        return features.one_hot(remembered, tickers)
    return features.one_hot_vector(remembered, output=TICKER_VECTOR)


def scaled_splits(
    table: DataFrame,
    kind: str = "llm",
    lookback: int = 20,
    method: str = "robust",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Date split with warm-up, continuous technical features scaled by the train rows."""
    continuous = list(TECHNICAL_FEATURES if columns is None else columns)
    parts = materialise(dataset.split_by_date(table, warmup=lookback), "splits")
    fitted = dataset.fit_scaler(parts.filter("split = 'train'"), continuous, method)
    return dataset.apply_scaler(parts, fitted, continuous)


def hybrid_sequences(scaled: DataFrame, kind: str = "llm", lookback: int = 20) -> DataFrame:
    """Look-back sequences with technical, one-hot and news parts, split by split."""
    vectors = [TICKER_VECTOR] if TICKER_VECTOR in scaled.columns else []
    named = sorted(c for c in scaled.columns if c.startswith("ticker_") and c != TICKER_VECTOR)
    return dataset.sequences(
        scaled,
        [*TECHNICAL_FEATURES, *named],
        lookback,
        vectors=vectors,
        news=NEWS_FEATURES[kind],
        group=("split", "ticker"),
        extra=("close_px",),
    )
