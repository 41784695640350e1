"""Incremental forms of three batch steps (T1-T3) with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewire.operators.news import NEWS_KEY
from tidewire.plans.scoring import Scorer, score_texts
from tidewire.sources.store import append_to_store


def landed(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1000) -> DataFrame:
    """A landing folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVED = "_arrived"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB: on disk, with changes checkpointed."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def forget_repeats(news: DataFrame, memory: str, tie_break: Sequence[str] = ("news_id",), arrived: Column | None = None) -> DataFrame:
    """Drop articles that were seen before, as far as the state of the last ``memory`` knows.

    The watermark follows the time of arrival, by default the time of the batch, which never goes
    back: so no article is ever too late, whatever its age, and state older than ``memory`` goes.
    A repeat after that passes. An article is its key and ``tie_break``; NULLs are equal.
    """
    timed = news.withColumn(ARRIVED, F.current_timestamp() if arrived is None else arrived.cast("timestamp"))
    identity = list(dict.fromkeys([*NEWS_KEY, *tie_break]))
    return timed.withWatermark(ARRIVED, memory).dropDuplicatesWithinWatermark(identity).drop(ARRIVED)


def stream_upsert(
    news: DataFrame,
    store: str,
    checkpoint: str,
    tie_break: Sequence[str] = ("news_id",),
    memory: str | None = None,
) -> StreamingQuery:
    """Land new articles in the store; rows already stored win.

    Feeds are collected from new to old, so an article may be of any age. Repeats inside a batch
    and against the store are settled by the store itself, from the months the batch touches. A
    batch that is run again after a failure adds nothing twice. With ``memory`` given, for example
    "7 days", articles fetched again within that time are known from state and never reach the
    store's check; the rest goes through it, so the result is the same.
    """

    def merge(batch: DataFrame, _: int) -> None:
        held = batch.persist()  # read twice below; lost pieces are computed again
        append_to_store(held, store, tie_break)
        held.unpersist()

    if memory is None:
        return _start(news, merge, checkpoint)
    with rocksdb_state(news.sparkSession):
        return _start(forget_repeats(news, memory, tie_break), merge, checkpoint)


def stream_scores(
    news: DataFrame,
    column: str,
    load: Callable[[], Scorer],
    output: str,
    output_type: str,
    store: str,
    checkpoint: str,
    batch_size: int = 32,
) -> StreamingQuery:
    """Score only what is new; the checkpoint remembers what is done across restarts.

    Each batch goes to its own folder, replaced as a whole if the batch is run again.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        scored = score_texts(batch, column, load, output, output_type, batch_size)
        scored.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return _start(news, score, checkpoint)


def _sums(scores: dict[str, Column]) -> list[Column]:
    parts = []
    for name, score in scores.items():
        parts += [F.sum(score).alias(f"{name}_sum"), F.count(score).alias(f"{name}_rows")]
    return [*parts, F.count("*").alias("news_count")]


def daily_parts(news: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """Sums that add up to A1: per (news_date, ticker) each score's sum and count, and all rows."""
    return news.groupBy(F.to_date("pub_time").alias("news_date"), "ticker").agg(*_sums(scores))


def stream_daily(
    news: DataFrame, scores: dict[str, Column], store: str, checkpoint: str
) -> StreamingQuery:
    """Roll up each batch into a folder of its own, replaced as a whole if it is run again.

    A day is never closed: late articles add to it, and the newest day is there at once.
    ``read_daily`` gives the means.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        daily_parts(batch, scores).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return _start(news, write, checkpoint)


def read_daily(spark: SparkSession, store: str, scores: Sequence[str]) -> DataFrame:
    """T3's table so far, as A1 over all articles: one row per day and ticker."""
    means = [
        F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_rows")).alias(name) for name in scores
    ]
    parts = spark.read.parquet(store)
    return parts.groupBy("news_date", "ticker").agg(*means, F.sum("news_count").alias("news_count"))


def stream_closed_days(
    news: DataFrame, scores: dict[str, Column], store: str, checkpoint: str, lateness: str = "2 days"
) -> StreamingQuery:
    """T3 in event time: a day's sums once, when articles ``lateness`` newer than its end are there.

    A tumbling window of one day per ticker in append mode; state holds the open days only.
    Articles of a day that is closed, and articles without a time, change nothing here;
    ``stream_daily`` over the same folder has them, and ``read_closed_days`` puts both together.
    """
    timed = news.withColumn("_event", F.col("pub_time").cast("timestamp")).withWatermark("_event", lateness)
    days = timed.groupBy(F.window("_event", "1 day").alias("_day"), "ticker").agg(*_sums(scores))
    closed = days.withColumn("news_date", F.to_date("_day.start")).drop("_day")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    with rocksdb_state(news.sparkSession):
        return _start(closed, write, checkpoint)


def read_closed_days(spark: SparkSession, closed: str, parts: str, scores: Sequence[str]) -> DataFrame:
    """The closed days with their late articles: (news_date, ticker, means, news_count, late).

    ``closed`` is the store of ``stream_closed_days``, ``parts`` that of ``stream_daily``. Means and
    count are over all articles of the day that have come; ``late`` is how many came after it was
    closed, so rows with ``late`` > 0 have changed since.
    """
    final = spark.read.parquet(closed).select("news_date", "ticker", F.col("news_count").alias("_then"))
    now = read_daily(spark, parts, scores)
    # Null-safe: a missing ticker is a group like any other.
    joined = now.alias("n").join(final.alias("c"), F.expr("n.news_date = c.news_date and n.ticker <=> c.ticker"))
    return joined.select(
        "n.news_date", "n.ticker", *scores, "news_count", (F.col("news_count") - F.col("_then")).alias("late")
    )


def _start(df: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
