"""Daily roll-up of news and its forward mapping to trading days."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.schemas import numeric_columns, q

# Never averaged: keys, texts, labels, the vendor's own score.
NOT_AVERAGED = (
    "news_id",
    "pub_time",
    "title",
    "summary",
    "news_text",
    "finbert_label",
    "sentiment_score",
    "llm_label",
)


def group_news_by_date(
    news: DataFrame,
    exclude: Iterable[str] = NOT_AVERAGED,
    cutoff_time: str | None = None,
) -> DataFrame:
    """A1: per (news_date, ticker) the mean of every numeric column, and the number of rows.

    ``cutoff_time`` ("HH:mm:ss") counts articles from that time on to the next day.
    """
    day = F.to_date("pub_time")
    if cutoff_time is not None:
        late = F.date_format("pub_time", "HH:mm:ss") >= cutoff_time
        day = F.when(late, F.date_add(day, 1)).otherwise(day)
    means = [F.avg(q(c)).alias(c) for c in numeric_columns(news, exclude)]
    return news.groupBy(day.alias("news_date"), "ticker").agg(
        *means, F.count("*").alias("news_count")
    )


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: Sequence[str] = ("ticker",),
    output: str = "market_date",
) -> DataFrame:
    """For each left row the earliest right date at or after its own, in the same group.

    Rows without one get NULL. Only the distinct (group, date) pairs of the left side are
    matched: inside a year, at most 366 of them, a running last-seen value over descending dates
    finds the match; a date after its year's last right date takes the first right date of a
    later year. The left rows then join their date, an equi-join that run-time statistics can
    split. So no task holds a group's rows, and no range join is needed.
    """
    by = list(by)
    right_dates = right.select(*by, F.col(right_on).alias("_date")).distinct()
    left_dates = left.select(*by, F.col(left_on).alias("_date")).distinct()
    points = (
        left_dates.withColumn("_right", F.lit(None).cast("date"))
        .unionByName(right_dates.withColumn("_right", F.col("_date")))
        .groupBy(*by, "_date")
        .agg(F.max("_right").alias("_right"))
        .withColumn("_period", F.year("_date"))
    )
    newest_first = Window.partitionBy(*by, "_period").orderBy(F.col("_date").desc())
    in_year = F.last("_right", ignorenulls=True).over(
        newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    first_of_year = points.groupBy(*by, "_period").agg(F.min("_right").alias("_first"))
    later = Window.partitionBy(*by).orderBy(F.col("_period").desc())
    next_year = first_of_year.select(
        *by,
        "_period",
        F.last("_first", ignorenulls=True)
        .over(later.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_next"),
    )
    matched = (
        points.withColumn("_in_year", in_year)
        .join(next_year, [*by, "_period"], "left")
        .select(
            *[q(c).alias(f"_{c}") for c in by], "_date", F.coalesce("_in_year", "_next").alias(output)
        )
    )
    same = [q(c) == F.col(f"_{c}") for c in by] + [q(left_on) == F.col("_date")]
    return left.join(matched, same, "left").select(*[q(c) for c in left.columns], q(output))


def map_to_market_days(daily: DataFrame, market: DataFrame) -> DataFrame:
    """J1 for the daily roll-up; news after a ticker's last trading day is dropped."""
    return asof_forward(daily, market, "news_date", "trade_date").filter(
        F.col("market_date").isNotNull()
    )


def aggregate_mapped(
    mapped: DataFrame, prefix: str | Sequence[str] = "", weighted: bool = False
) -> DataFrame:
    """A2: per (market_date, ticker) the plain mean of the daily means and the sum of counts.

    ``weighted`` weighs each day by its number of articles instead.
    """
    prefixes = (prefix,) if isinstance(prefix, str) else tuple(prefix)
    scores = [
        c for c in numeric_columns(mapped, ["news_count"]) if c.startswith(prefixes)
    ]

    def mean(c: str):
        if not weighted:
            return F.avg(q(c))
        there = F.when(q(c).isNotNull(), F.col("news_count"))
        return F.try_divide(F.sum(q(c) * F.col("news_count")), F.sum(there))

    return mapped.groupBy("market_date", "ticker").agg(
        *[mean(c).alias(c) for c in scores], F.sum("news_count").alias("news_count")
    )


def join_market(market: DataFrame, mapped: DataFrame) -> DataFrame:
    """Every market day; without news the count is 0 and the scores stay NULL.

    No broadcast hint: the roll-up grows with the data, so its run-time size decides.
    """
    right = mapped.withColumnRenamed("market_date", "trade_date")
    return market.join(right, ["trade_date", "ticker"], "left").withColumn(
        "news_count", F.coalesce("news_count", F.lit(0))
    )


def merge_market_and_sentiment(
    market: DataFrame,
    daily: DataFrame,
    prefix: str | Sequence[str] = "",
    weighted: bool = False,
) -> DataFrame:
    """A3: J1, A2, J2."""
    return join_market(
        market, aggregate_mapped(map_to_market_days(daily, market), prefix, weighted)
    )
