"""Linear recurrences ``e[t] = f * e[t-1] + x[t]`` over blocked series, without Python.

Inside a block the recurrence is a scaled running sum that starts from zero. Its value in the
last row of a full block is the block's end value. What flows into a block is a fold over the
end values of the blocks before it; a block shrinks its inflow by ``f ** rows``, so the fold
stops once that product is below the smallest double, and nothing representable is left out.
End values are one row per 1024, the fold's frame is bounded, and the final value is

    e = local + f ** (place + 1) * inflow.

A recurrence may be fed by others (the MACD signal by two EMAs); the feeders' inflow then also
reaches it, through the closed form of two chained geometric decays. So one round is enough.

The formulas are SQL text: one parse per formula instead of a call per operator.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.series import BLOCK, BLOCK_ROWS, CORE, POS, with_blocks

TO_HERE = "rows between unbounded preceding and current row"


@dataclass(frozen=True)
class Scan:
    """One recurrence. ``fed_by`` lists (other scan's name, gain) pairs; factor 1 is a running sum."""

    name: str
    factor: float
    fed_by: tuple[tuple[str, float], ...] = ()

    @property
    def local(self) -> str:
        return f"_local_{self.name}"


def number(x: float) -> str:
    """A double literal."""
    return f"({float(x)!r}D)"


def block_rows(factors: Sequence[float]) -> int:
    """Longest block (at most 1024 rows) whose scale factors stay well inside a double."""
    shrinking = [f for f in factors if f < 1.0]
    if not shrinking:
        return BLOCK_ROWS
    return min(BLOCK_ROWS, max(8, int(250 / -math.log10(min(shrinking)))))


def running(x: str, factor: float, rows: int, key: Sequence[str] = ("ticker",)) -> str:
    """The recurrence inside a block, started from zero. ``x`` must not be NULL."""
    over = f"over (partition by {', '.join(key)}, {BLOCK} order by {POS} {TO_HERE})"
    if factor == 1.0:
        return f"sum({x}) {over}"
    f, place = number(factor), f"cast({POS} % {rows} as double)"
    return f"sum(({x}) * pow({f}, -{place})) {over} * pow({f}, {place})"


def _reach(scan: Scan, source: Scan, gain: float) -> tuple[float, float, float]:
    """(c, f, g): after n rows ``c * (f**n - g**n)`` of the source's inflow is in the scan."""
    f, g = source.factor, scan.factor
    return gain * f / (f - g), f, g


def complete(
    df: DataFrame,
    scans: Sequence[Scan],
    key: Sequence[str] = ("ticker",),
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Turn the block-local columns ``_local_<name>`` into the full recurrences ``<name>``.

    ``df`` holds core rows only.
    """
    keys = list(key)
    by_name = {s.name: s for s in scans}
    shrinking = [s for s in scans if s.factor < 1.0]
    sums = [s for s in scans if s.factor == 1.0]
    ends = df.filter(f"{POS} % {rows} = {rows - 1}")
    by_block = f"partition by {', '.join(keys)} order by {BLOCK}"
    inflow = [f"{BLOCK} + 1 as {BLOCK}"]
    if shrinking:
        slowest = max(s.factor for s in shrinking)
        depth = 1 + math.ceil(320 / (-math.log10(slowest) * rows))
        end = ", ".join(f"'{s.name}', {s.local}" for s in shrinking)
        zero = ", ".join(f"'{s.name}', 0D" for s in shrinking)
        steps = []
        for s in shrinking:
            step = f"acc.{s.name} * {number(s.factor**rows)} + e.{s.name}"
            for other, gain in s.fed_by:
                c, f, g = _reach(s, by_name[other], gain)
                step += f" + acc.{other} * {number(c * (f**rows - g**rows))}"
            steps.append(f"'{s.name}', {step}")
        inflow.append(
            f"aggregate(collect_list(named_struct({end})) over ({by_block}"
            f" rows between {depth} preceding and current row), named_struct({zero}),"
            f" (acc, e) -> named_struct({', '.join(steps)})) as _in"
        )
    inflow += [f"sum({s.local}) over ({by_block} {TO_HERE}) as _sum_{s.name}" for s in sums]
    carried = df.join(ends.selectExpr(*keys, *inflow), [*keys, BLOCK], "left")

    n = f"cast({POS} % {rows} + 1 as double)"
    done = []
    for s in shrinking:
        value = f"{s.local} + coalesce(_in.{s.name}, 0D) * pow({number(s.factor)}, {n})"
        for other, gain in s.fed_by:
            c, f, g = _reach(s, by_name[other], gain)
            grown = f"(pow({number(f)}, {n}) - pow({number(g)}, {n}))"
            value += f" + coalesce(_in.{other}, 0D) * {number(c)} * {grown}"
        done.append(f"{value} as {s.name}")
    done += [f"{s.local} + coalesce(_sum_{s.name}, 0) as {s.name}" for s in sums]
    local = {s.local for s in scans}
    rest = [f"`{c}`" for c in df.columns if c not in local]
    return carried.selectExpr(*rest, *done)


def seeded(x: str, n: int, alpha: float, start: int) -> str:
    """Input of a moving average whose first value is the plain mean of ``n`` values.

    The series begins at place ``start``, the first value sits at ``start + n - 1``. Each of the
    first ``n`` values enters with the weight that will have decayed to ``1/n`` by then, so no
    extra frame is needed for the mean.
    """
    at = start + n - 1
    early = f"({x}) * pow({number(1 - alpha)}, cast({POS} - {at} as double)) / {n}"
    return (
        f"case when {POS} > {at} then ({x}) * {number(alpha)}"
        f" when {POS} >= {start} then {early} else 0D end"
    )


def ewma_adjusted(
    df: DataFrame, column: str, span: int, name: str, key: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Weighted mean with weights ``(1-a)**age``, ``a = 2/(span+1)``, NULL values skipped.

    ``df`` must carry positions. A NULL row repeats the mean so far, as its weights only age.
    """
    factor = 1 - 2 / (span + 1)
    rows = block_rows([factor])
    x = f"`{column}`"
    weight = f"case when {x} is null then 0D else 1D end"
    laid = with_blocks(df, rows=rows)
    local = laid.selectExpr(
        "*",
        f"{running(f'coalesce({x}, 0D)', factor, rows, key)} as _local__num",
        f"{running(weight, factor, rows, key)} as _local__den",
    )
    full = complete(local, [Scan("_num", factor), Scan("_den", factor)], key, rows)
    value = f"case when {POS} is not null then try_divide(_num, _den) end"
    return full.withColumn(name, F.expr(value)).drop(
        "_num", "_den", BLOCK, CORE
    )
