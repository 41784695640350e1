"""Ordered work on time series without one task per ticker.

A ticker may hold a large part of all rows, and there may be only a handful of tickers. So a
window is never partitioned by the ticker alone:

1. ``with_positions`` numbers the rows of each ticker. Rows are counted per (ticker, calendar
   period); the running sum of these few counts gives each period's offset, and inside a period
   ``row_number`` does the rest.
2. ``with_blocks`` cuts the numbered series into blocks of equal length and copies the rows a
   frame needs from the neighbours into each block (``before`` rows back, ``after`` rows ahead).
   A window over (ticker, block) then sees all rows of its frame and no task sees more than
   ``rows + before + after`` rows of one ticker.

All frames of a query share one window specification, hence one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
POS, COUNT, BLOCK, CORE = "_pos", "_n", "_blk", "_core"
NO_PLACE = "!"
HELPERS = (POS, COUNT, BLOCK, CORE, "_period")


def with_positions(
    df: DataFrame,
    key: Sequence[str] = ("ticker",),
    order: Sequence[str] = ("trade_date",),
    period: str = "year({})",
    complete: Sequence[str] = (),
) -> DataFrame:
    """Add ``_pos`` (0-based place in the ticker's series) and ``_n`` (the series' length).

    Rows that lack a ticker, a date or one of the ``complete`` columns are kept, but have no place
    (both NULL): they are in no frame, and everything computed over the series is NULL for them.
    ``period`` maps the first order column to a coarser one whose text sorts in the same order,
    here the year: at most 366 rows of a daily series. For intraday series pass a day:
    ``"to_date({})"``.
    """
    keys = ", ".join(key)
    whole = " and ".join(f"`{c}` is not null" for c in (*key, *order, *complete))
    # Rows without a place are spread over many parts, however many there are.
    parted = f"concat('{NO_PLACE}', {_part(df)})"
    named = f"case when {whole} then cast({period.format(order[0])} as string) else {parted} end"
    staged = df.withColumn("_period", F.expr(named))
    has_place = f"not startswith(_period, '{NO_PLACE}')"
    counts = staged.filter(has_place).groupBy(*key, "_period").agg(F.count("*").alias("_rows"))
    offsets = counts.selectExpr(
        *key,
        "_period",
        f"coalesce(sum(_rows) over (partition by {keys} order by _period"
        " rows between unbounded preceding and 1 preceding), 0) as _offset",
        f"sum(_rows) over (partition by {keys}) as {COUNT}",
    )
    inside = f"row_number() over (partition by {keys}, _period order by {', '.join(order)})"
    return (
        staged.selectExpr("*", f"{inside} as _rn")
        .join(offsets, [*key, "_period"], "left")
        .selectExpr(
            *[f"`{c}`" for c in df.columns],
            f"case when {has_place} then _offset + _rn - 1 end as {POS}",
            COUNT,
        )
    )


def _part(df: DataFrame, parts: int = 1024) -> str:
    """A number below ``parts`` from a row's plain columns."""
    plain = [f"`{f.name}`" for f in df.schema.fields if not f.dataType.simpleString().startswith("map")]
    return f"pmod(xxhash64({', '.join(plain)}), {parts})"


def with_blocks(
    df: DataFrame, before: int = 0, after: int = 0, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``_blk`` and ``_core``; copy neighbour rows so that frames of the given reach fit.

    Rows with ``_core`` false are copies: compute over them, then drop them.
    """
    # Rows without a place go to blocks of their own, below zero.
    own = f"coalesce({POS} div {rows}, -1 - {_part(df)})"
    if before == 0 and after == 0:
        return df.selectExpr("*", f"{own} as {BLOCK}", f"true as {CORE}")
    first = f"greatest({POS} - {after}, 0) div {rows}"
    last = f"least({POS} + {before}, {COUNT} - 1) div {rows}"
    blocks = f"case when {POS} is null then array({own}) else sequence({first}, {last}) end"
    spread = df.selectExpr("*", f"explode({blocks}) as {BLOCK}")
    return spread.selectExpr("*", f"{POS} is null or {BLOCK} = {POS} div {rows} as {CORE}")


def block_window(key: Sequence[str] = ("ticker",)) -> WindowSpec:
    return Window.partitionBy(*key, BLOCK).orderBy(POS)


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORE))


def drop_helpers(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.drop(*[c for c in HELPERS if c not in keep])


def over_series(
    df: DataFrame,
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    key: Sequence[str] = ("ticker",),
    order: Sequence[str] = ("trade_date",),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Add window columns whose frames reach ``before`` rows back and ``after`` rows ahead.

    Rows already numbered (``_pos`` and ``_n`` present) are not numbered again.
    """
    numbered = df if POS in df.columns else with_positions(df, key, order)
    laid = with_blocks(numbered, before, after)
    made = columns(block_window(key))
    laid = laid.withColumns({n: F.when(F.col(POS).isNotNull(), c) for n, c in made.items()})
    return drop_helpers(core_rows(laid), keep)


# Frame expressions. ``w`` is a block window; a frame that is not full gives NULL.


def lagged(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(x, n).over(w)


def diff(x: Column, w: WindowSpec) -> Column:
    """W1."""
    return x - lagged(x, w)


def pct_change(x: Column, w: WindowSpec) -> Column:
    """W2."""
    return F.try_divide(x, lagged(x, w)) - 1


def _full(agg: Callable[[Column], Column], x: Column, frame: WindowSpec, n: int) -> Column:
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def rolling(
    agg: Callable[[Column], Column],
    x: Column,
    w: WindowSpec,
    n: int,
    min_periods: int | None = None,
) -> Column:
    """The last ``n`` rows; NULL until ``min_periods`` (default n) values."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if min_periods is None else min_periods), agg(x).over(frame))


def forward_sum(x: Column, w: WindowSpec, n: int = 5) -> Column:
    """Sum of the next ``n`` rows, NULL unless all are there."""
    return _full(F.sum, x, w.rowsBetween(1, n), n)
