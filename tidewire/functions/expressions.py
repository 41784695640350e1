"""Row-wise market expressions (X1-X3, X5-X7, X16, X24-X26). Division by zero gives NULL."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vendor sentiment labels and their scores.
LABEL_SCORES = {
    "very positive": 1.0,
    "bullish": 1.0,
    "positive": 0.8,
    "neutral/positive": 0.3,
    "neutral": 0.0,
    "mixed": 0.0,
    "hold": 0.0,
    "neutral/negative": -0.3,
    "negative": -1.0,
    "bearish": -1.0,
}


def finite(x: Column) -> Column:
    """NaN and infinities become NULL: NULL is the only missing value here."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def open_close_return(open_px: Column, close_px: Column) -> Column:
    """X1."""
    return ratio(close_px - open_px, open_px)


def high_low_range(high_px: Column, low_px: Column, close_px: Column) -> Column:
    """X1."""
    return ratio(high_px - low_px, close_px)


def distance(close_px: Column, average: Column) -> Column:
    """Relative distance of the close from a moving average."""
    return ratio(close_px - average, average)


def sentiment_impact(score: Column, news_count: Column) -> Column:
    """X5."""
    return score * F.log1p(news_count)


def sentiment_delta(score: Column, ewma: Column) -> Column:
    """X6."""
    return score - ewma


def volume_spike(news_count: Column, mean_count: Column) -> Column:
    """X7."""
    return news_count / (mean_count + 1)


def label_score(label: Column) -> Column:
    """Score of a vendor label, any case; an unknown label gives NULL."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(LABEL_SCORES.items())])
    return F.try_element_at(table, F.lower(label))


def trading_signal(y_hat: Column, upper: Column, lower: Column) -> Column:
    """+1 above the upper threshold and positive, -1 below the lower and negative, else 0."""
    return (
        F.when((y_hat > upper) & (y_hat > 0), 1)
        .when((y_hat < lower) & (y_hat < 0), -1)
        .otherwise(0)
    )


def strategy_return(signal: Column, y: Column, floor: float | None = None) -> Column:
    """Signal times actual return, optionally not below ``floor`` (a stop-loss)."""
    raw = signal * y
    return raw if floor is None else F.greatest(raw, F.lit(float(floor)))


def implied_price(close_px: Column, forward_return: Column) -> Column:
    """The price a forward return leads to."""
    return close_px * (1 + forward_return)
