"""Tables in files and databases (S1-S5, S12). The caller names paths, URLs and credentials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.schemas import NEWS_RAW, OHLCV, q

CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"'}


def empty_to_null(df: DataFrame) -> DataFrame:
    """Empty strings become NULL, NaN and infinities too: one way to be missing."""
    from tidewire.functions.expressions import finite

    out = []
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType = NEWS_RAW,
    multi_line: bool = False,
) -> DataFrame:
    """One read over all paths with a declared schema, quotes as in RFC 4180.

    Files are split over tasks. Line breaks inside quotes need ``multi_line=True``, which reads
    each file in one task: keep such files small, or collect them without line breaks.
    """
    reader = spark.read.schema(schema).options(**CSV_OPTIONS).option("multiLine", multi_line)
    return empty_to_null(reader.csv([paths] if isinstance(paths, str) else list(paths)))


def read_ohlcv_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return read_csv(spark, paths, OHLCV, multi_line=False)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; ``mode="append"`` adds part files that each carry the header once."""
    _keep_input_safe(df, path, mode)
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_table(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ("ticker",)
) -> None:
    """The default store, Parquet partitioned by ticker.

    Rows are first spread by the partition columns; an uncommonly large ticker is split over
    several files, small ones share a task.
    """
    _keep_input_safe(df, path, mode)
    spread = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    spread.write.mode(mode).partitionBy(*partition_by).parquet(path)


def _keep_input_safe(df: DataFrame, path: str, mode: str) -> None:
    """Refuse to overwrite a folder that the plan reads, lies in, or has read files below."""
    if mode != "overwrite":
        return
    target = _steps(path)
    for root in scan_roots(df):
        own = _steps(root)
        shared = min(len(own), len(target))
        if own[:shared] == target[:shared]:
            raise ValueError(f"refusing to overwrite {path}: it is an input of the same plan")


def _steps(path: str) -> list[str]:
    """The names a path consists of, without scheme and host."""
    scheme, colon, rest = path.partition(":")
    plain = rest if colon and "/" not in scheme else path
    if plain.startswith("//"):
        plain = plain[2:].partition("/")[2]
    return [step for step in plain.split("/") if step]


def scan_roots(df: DataFrame) -> list[str]:
    """Paths that the plan's file scans were given: as many as the reader named, not its files."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    roots = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            continue
        relation = leaf.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation":
            paths = relation.location().rootPaths()
            roots += [paths.apply(k).toString() for k in range(paths.size())]
    return roots


# How a table that exists already is treated, and the writer's word for it.
TABLE_MODES = {"append": "append", "replace": "overwrite", "fail": "error"}


def save_to_db(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Load a table into a database; ``options`` carry driver, user and the like."""
    if mode not in TABLE_MODES:
        raise ValueError(f"mode is one of {sorted(TABLE_MODES)}")
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(TABLE_MODES[mode]).save()


def save_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """S4 for a table in files, with the same rules for a table that exists already."""
    if mode not in TABLE_MODES:
        raise ValueError(f"mode is one of {sorted(TABLE_MODES)}")
    write_table(df, path, TABLE_MODES[mode])


def read_options(
    url: str, table: str, partition_column: str | None = None, lower=None, upper=None, partitions: int | None = None, **options: str
) -> dict[str, str]:
    """Options of a database read; with a column and its bounds the read is dealt over tasks.

    The bounds only set where parts begin: rows beyond them, and rows with NULL, are read too. A
    numeric, date or timestamp column will do, such as ``trade_date``.
    """
    made = {"url": url, "dbtable": table, **options}
    dealt = (partition_column, lower, upper, partitions)
    if all(x is None for x in dealt):
        return made
    if any(x is None for x in dealt):
        raise ValueError("a dealt read needs partition_column, lower, upper and partitions")
    if partitions < 1 or upper <= lower:
        raise ValueError("bounds have to grow, and there has to be a part")
    bounds = {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper)}
    return {**made, **bounds, "numPartitions": str(partitions)}


def read_from_db(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """S5's database form; filters on the result are pushed into the query.

    ``options`` are those of ``read_options``: without a partition column one task reads it all.
    """
    return spark.read.format("jdbc").options(**read_options(url, table, **options)).load()


def retrieve_by_ticker(market: DataFrame, ticker: str) -> DataFrame:
    """One ticker's rows in date order; the filter prunes partitions or goes to the database."""
    return market.filter(F.col("ticker") == ticker).orderBy("trade_date")


# Landed column names and ours.
OHLCV_NAMES = {
    "Date": "trade_date",
    "Open": "open_px",
    "High": "high_px",
    "Low": "low_px",
    "Close": "close_px",
    "Volume": "volume",
}


def flatten_ohlcv(df: DataFrame, ticker: str | None = None, separator: str = "|") -> DataFrame:
    """Two-level names ("Close|MSFT") lose the second level; ``ticker`` becomes a column."""
    kept = [c for c in df.columns if c.split(separator)[0] in OHLCV_NAMES or c == "ticker"]
    flat = df.select(
        *[q(c).alias(OHLCV_NAMES.get(c.split(separator)[0], "ticker")) for c in kept]
    )
    if ticker is not None:
        flat = flat.withColumn("ticker", F.lit(ticker))
    return flat.select(
        "trade_date", "ticker", "open_px", "high_px", "low_px", "close_px", "volume"
    )
