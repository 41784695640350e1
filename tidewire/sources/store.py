"""The growing news store: upsert, key index and compaction, back-fill plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.operators.news import NEWS_KEY, keep_first
from tidewire.schemas import q
from tidewire.session import discard_materialised, materialise, written_so_far

MONTH = "pub_month"
KEY = "news_key"
_TIE = "_tie"


def upsert(
    existing: DataFrame, incoming: DataFrame, tie_break: Sequence[str] = ("news_id",)
) -> DataFrame:
    """Existing and incoming rows, one per (pub_time, ticker, title); an existing row wins."""
    both = existing.withColumn("_prio", F.lit(0)).unionByName(
        incoming.withColumn("_prio", F.lit(1)), allowMissingColumns=True
    )
    return keep_first(both, NEWS_KEY, ["_prio", *tie_break]).drop("_prio")


def new_rows(
    existing: DataFrame, incoming: DataFrame, tie_break: Sequence[str] = ("news_id",)
) -> DataFrame:
    """The incoming rows an upsert would add."""
    first = keep_first(incoming, NEWS_KEY, tie_break)
    # Null-safe, as two missing titles count as equal.
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in NEWS_KEY]
    return first.alias("n").join(existing.alias("e"), same, "left_anti")


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTH, F.date_format("pub_time", "yyyy-MM"))


def read_store(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The store's rows, or None before the first write."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or "") or "UNABLE_TO_INFER" in (
            error.getCondition() or ""
        ):
            return None
        raise


def append_to_store(
    incoming: DataFrame, path: str, tie_break: Sequence[str] = ("news_id",)
) -> None:
    """S13 on files: append the new rows, never rewrite the stored ones.

    Only the months the batch touches are read (partition pruning; their list is bounded by the
    calendar). Running the same batch again adds nothing, so a retry is safe.
    """
    spark = incoming.sparkSession
    batch = with_month(incoming)
    months = [r[0] for r in batch.select(MONTH).distinct().collect()]
    existing = read_store(spark, path)
    if existing is None:
        fresh = keep_first(batch, NEWS_KEY, tie_break)
    else:
        within = F.col(MONTH).isin([m for m in months if m is not None])
        if None in months:
            within = within | F.col(MONTH).isNull()
        touched = existing.filter(within).select(*NEWS_KEY)
        fresh = new_rows(touched, batch, tie_break)
    fresh.hint("rebalance", F.col(MONTH)).write.mode("append").partitionBy(MONTH).parquet(path)


# --- the store as a table with a key index ---


def news_key() -> Column:
    """One text per (pub_time, ticker, title): their digest, with NULL told from empty."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in NEWS_KEY]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def open_indexed_store(spark: SparkSession, name: str, path: str, schema: StructType, buckets: int = 64) -> DataFrame:
    """S13 at size: the table ``name`` over ``path``, by month and inside by ``buckets`` of the key.

    The folder holds everything; a session that does not know the table yet takes up the months
    that are there. ``schema`` is that of the articles. The number of buckets is fixed when the
    folder is first written; choose it so that a month's bucket stays below a few hundred MB.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"create table {name} ({columns}, `{KEY}` string, `{MONTH}` string) using parquet"
            f" partitioned by (`{MONTH}`) clustered by (`{KEY}`) sorted by (`{KEY}`) into {buckets} buckets location '{path}'"
        )
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            spark.sql(f"alter table {name} recover partitions")
    return spark.table(name)


def _buckets(spark: SparkSession, name: str) -> int:
    return int(spark.sql(f"describe extended {name}").filter("col_name = 'Num Buckets'").first().data_type)


def _indexed(batch: DataFrame, tie_break: Sequence[str]) -> DataFrame:
    return with_month(batch).withColumns({KEY: news_key(), _TIE: F.struct(*[q(c) for c in tie_break])})


def _new_keys(batch: DataFrame, name: str) -> DataFrame:
    """Of the batch's keys those the store does not have, each with its smallest ``tie_break``.

    Only the months of the batch are read, and of them only the key. What is stored is in buckets
    of the key already, so the batch's keys alone are shuffled to meet it.
    """
    spark = batch.sparkSession
    months = [r[0] for r in batch.select(MONTH).distinct().collect()]
    within = F.col(MONTH).isin([m for m in months if m is not None])
    if None in months:
        within = within | F.col(MONTH).isNull()
    stored = spark.table(name).filter(within).select(KEY)
    # Copies of a hot key shrink before they are shuffled. The month follows from the key; with it as
    # a group the keys are not dealt by key alone yet, and it is they that go to the store's buckets.
    first = batch.groupBy(KEY, MONTH).agg(F.min(_TIE).alias(_TIE)).drop(MONTH)
    # A merge join of the buckets: the stored side is never gathered, however few months are left.
    return first.join(stored.hint("merge"), KEY, "left_anti")


def _rows_of(batch: DataFrame, keys: DataFrame) -> DataFrame:
    """The batch's row per new key; of rows equal in ``tie_break`` too, any one."""
    rest = [c for c in batch.columns if c not in (KEY, _TIE)]
    met = batch.join(keys, [KEY, _TIE])
    one = met.groupBy(KEY, _TIE).agg(F.first(F.struct(*[q(c) for c in rest])).alias("_row"))
    return one.select(*[F.col("_row").getField(c).alias(c) for c in rest], KEY)


def rows_to_add(incoming: DataFrame, name: str, tie_break: Sequence[str] = ("news_id",)) -> DataFrame:
    """The incoming rows whose key the store does not have, with key and month.

    Keys meet the store without their articles; then only the articles to add are looked up, so
    ``incoming`` is read more than once and must give the same rows each time.
    """
    batch = _indexed(incoming, tie_break)
    return _rows_of(batch, _new_keys(batch, name))


def append_to_indexed_store(incoming: DataFrame, name: str, tie_break: Sequence[str] = ("news_id",)) -> None:
    """S13 on the indexed table: add the new rows in their buckets; a retry adds nothing twice.

    The new keys are written first: where they are few, or none, no article is shuffled to find
    its rows.
    """
    spark = incoming.sparkSession
    table = spark.table(name)
    batch = _indexed(incoming, tie_break)
    mark = written_so_far()
    keys = materialise(_new_keys(batch, name), "new-keys")
    _add(_rows_of(batch, keys).select(*table.columns), name, "append")
    discard_materialised(spark, mark)


def _add(rows: DataFrame, name: str, mode: str) -> None:
    buckets = _buckets(rows.sparkSession, name)
    dealt = rows.repartition(buckets, KEY)
    writer = dealt.write.mode(mode).partitionBy(MONTH).bucketBy(buckets, KEY).sortBy(KEY).format("parquet")
    if mode == "append":
        writer.saveAsTable(name)
    else:
        dealt.write.option("partitionOverwriteMode", "dynamic").insertInto(name, overwrite=True)


def compact_store(spark: SparkSession, name: str, files: int = 8) -> list[str | None]:
    """Rewrite the months whose buckets have more than ``files`` files on average; returns them.

    Each batch leaves a file per month and bucket it touches. A month is read whole, written to
    the shared folder, and put back as one file per bucket, replacing its folder; other months are
    not touched. Run it when no batch is being added.
    """
    table = spark.table(name)
    buckets = _buckets(spark, name)
    # One row per file: bounded by what is to be compacted.
    found = table.groupBy(MONTH).agg(F.count_distinct(F.col("_metadata.file_path")).alias("files"))
    crowded = [r[MONTH] for r in found.filter(F.col("files") > files * buckets).collect()]
    if crowded:
        within = F.col(MONTH).isin([m for m in crowded if m is not None])
        if None in crowded:
            within = within | F.col(MONTH).isNull()
        mark = written_so_far()
        held = materialise(table.filter(within), "compacted")
        _add(held, name, "overwrite")
        discard_materialised(spark, mark)
        spark.catalog.refreshTable(name)
    return crowded


def backfill_days(
    stored: DataFrame,
    start: str,
    end: str,
    max_empty: int = 7,
    column: str = "pub_time",
    tickers: DataFrame | None = None,
) -> DataFrame:
    """Per ticker the days still to fetch, as a walk from ``end`` back to ``start`` finds them.

    ``tickers`` (a column ticker) names what to collect, stored before or not; by default only
    what is stored. A ticker without a stored row is walked until the empty days run out.
    The walk ends after more than ``max_empty`` empty days in a row; stored days are not listed.
    A window per ticker holds one row per day of the period, whatever the store's size.
    """
    seen = stored.select("ticker", F.to_date(column).alias("day"), F.lit(1).alias("has")).distinct()
    span = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    wanted = stored.select("ticker") if tickers is None else tickers.select("ticker")
    days = wanted.distinct().select("ticker", span.alias("day"))
    newest_first = Window.partitionBy("ticker").orderBy(F.col("day").desc())
    upto = newest_first.rowsBetween(Window.unboundedPreceding, 0)
    newer = newest_first.rowsBetween(Window.unboundedPreceding, -1)
    flagged = days.join(seen, ["ticker", "day"], "left").withColumn("has", F.coalesce("has", F.lit(0)))
    islands = flagged.withColumn("_island", F.sum("has").over(upto))
    in_island = Window.partitionBy("ticker", "_island").orderBy(F.col("day").desc())
    runs = islands.withColumn(
        "_run", F.sum(1 - F.col("has")).over(in_island.rowsBetween(Window.unboundedPreceding, 0))
    )
    walked = runs.withColumn("_longest", F.coalesce(F.max("_run").over(newer), F.lit(0)))
    return walked.filter((F.col("_longest") <= max_empty) & (F.col("has") == 0)).select(
        "ticker", "day"
    )
