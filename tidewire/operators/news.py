"""News tables: slices, merge, clean, de-duplicate, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import calendar_date, news_text, passes_english_filter, tidy
from tidewire.schemas import q, require_columns

NEWS_KEY = ("pub_time", "ticker", "title")


def between_days(df: DataFrame, start: str, end: str, column: str = "pub_time") -> DataFrame:
    """From the start of ``start`` to the end of ``end``, as a plain range on the column."""
    last = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    first = F.lit(start).cast("date").cast("timestamp_ntz")
    return df.filter((F.col(column) >= first) & (F.col(column) < last))


def date_slice(df: DataFrame, start: str, end: str, column: str = "trade_date") -> DataFrame:
    """Both ends included."""
    return df.filter(
        F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )


def add_column(df: DataFrame, name: str, value) -> DataFrame:
    """A constant as second column, or overwritten in place if the column exists."""
    if name in df.columns:
        return df.withColumn(name, F.lit(value))
    head, *tail = df.columns
    return df.select(q(head), F.lit(value).alias(name), *[q(c) for c in tail])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Without the named columns; names that are not there are an error, not a silent no-op."""
    require_columns(df, list(names))
    return df.drop(*names)


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Sorted at the sink, NULLs first."""
    return df.orderBy(*[q(c) for c in columns])


def date_difference(left: DataFrame, right: DataFrame, column: str, other: str) -> DataFrame:
    """The distinct dates of ``left.column`` that are not among the days of ``right.other``."""
    days = right.select(F.to_date(q(other)).alias(column)).distinct()
    return left.select(q(column)).distinct().join(days, column, "left_anti")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order`` (which must be a total order).

    Done as an aggregate, not a window: copies of a hot key shrink before the shuffle and never
    meet in one task.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*[q(c) for c in rest]), F.struct(*[q(c) for c in order]))
    grouped = df.groupBy(*[q(c) for c in key]).agg(best.alias("_best"))
    return grouped.select(
        *[q(c) if c in key else F.col("_best").getField(c).alias(c) for c in df.columns]
    )


def union_news(parts: Sequence[DataFrame]) -> DataFrame:
    """U1's concat: by column name, a column that is absent is NULL, ``file_rank`` = place in list."""
    tagged = [p.withColumn("file_rank", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def merge_news(parts: Sequence[DataFrame], tie_break: Sequence[str] = ("news_id",)) -> DataFrame:
    """Concat, first file wins per (pub_time, ticker, title). Sort and format at the sink."""
    return keep_first(union_news(parts), NEWS_KEY, ["file_rank", *tie_break]).drop("file_rank")


def merge_market(parts: Sequence[DataFrame]) -> DataFrame:
    """Concat of market tables without de-duplication. Sort at the sink."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def english_news(df: DataFrame) -> DataFrame:
    """Articles inside the character set, with tidied title and summary."""
    kept = df.filter(passes_english_filter(F.col("title"), F.col("summary")))
    return kept.withColumns({"title": tidy(F.col("title")), "summary": tidy(F.col("summary"))})


def dedupe_by_day(df: DataFrame, tie_break: Sequence[str] = ("news_id",)) -> DataFrame:
    """U4: first article per ticker, calendar day and lower-case title."""
    tagged = df.withColumns(
        {"_day": calendar_date(F.col("pub_time")), "_lower": F.lower("title")}
    )
    return keep_first(tagged, ["ticker", "_day", "_lower"], ["pub_time", *tie_break]).drop(
        "_day", "_lower"
    )


def clean_news(
    df: DataFrame, tie_break: Sequence[str] = ("news_id",), drop_score: bool = True
) -> DataFrame:
    """The cleaning step as a whole."""
    require_columns(df, ["pub_time", "ticker", "title", "summary"])
    kept = dedupe_by_day(english_news(df), tie_break)
    out = kept.withColumn("news_text", news_text(F.col("title"), F.col("summary")))
    return out.drop("sentiment_score") if drop_score else out


def missing_days(
    df: DataFrame,
    column: str,
    start: str,
    end: str,
    by: Sequence[str] = (),
    groups: DataFrame | None = None,
) -> DataFrame:
    """Calendar days of [start, end] without a row, per ``by`` group if given.

    ``groups`` (the ``by`` columns) names the groups, seen or not; by default those in ``df``.
    The day list is as long as the period, whatever the size of ``df``.
    """
    seen = df.select(*by, F.to_date(F.col(column)).alias("day")).distinct()
    span = F.explode(
        F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    ).alias("day")
    if by:
        wanted = (df if groups is None else groups).select(*by).distinct().select(*by, span)
    else:
        wanted = df.sparkSession.range(1).select(span)
    return wanted.join(seen, [*by, "day"], "left_anti")


def pending(df: DataFrame, done: DataFrame, key: Sequence[str], mark: str) -> DataFrame:
    """Rows without a result yet; ``done`` rows whose ``mark`` is NULL count as not done."""
    finished = done.filter(q(mark).isNotNull()).select(*[q(k) for k in key])
    return df.join(finished, list(key), "left_anti")


def with_results(df: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Earlier output as the base: every row of ``df`` with its results, or NULLs."""
    return df.join(done, list(key), "left")


def by_key(df: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """Columns of two frames side by side, aligned by a row key, never by position."""
    return df.join(other, list(key), "inner")


def with_title_in(df: DataFrame, kept: DataFrame, title: Column) -> DataFrame:
    """Rows whose title is among ``kept.title``."""
    return df.withColumn("_t", title).join(
        kept.select(F.col("title").alias("_t")), "_t", "left_semi"
    ).drop("_t")


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """P10: the first ``n`` rows in a stated order (a top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """P11."""
    return df.select(*columns).distinct()


def one_ticker(df: DataFrame, ticker: str) -> DataFrame:
    """An equality filter that reaches the scan."""
    return df.filter(F.col("ticker") == ticker)
