"""Technical indicators over daily bars (W1-W4, W14-W21), one pass for any subset.

Bars have one row per (ticker, trade_date). A bar that lacks a price or the volume counts as no
bar: it is in no frame, recurrences go on from the bar before it to the next, and its own
indicators are NULL. Definitions that depend on the indicator library of the original are fixed here: EMAs start from the plain mean
of their first values; Wilder averages (RSI, ATR) likewise, with a = 1/n; the true range starts
at the second bar; Bollinger bands use the population deviation; OBV starts at +volume.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.recurrence import TO_HERE, Scan, block_rows, complete, running, seeded
from tidewire.operators.series import (
    BLOCK,
    COUNT,
    POS,
    core_rows,
    over_series,
    with_blocks,
    with_positions,
)
from tidewire.schemas import require_columns

# Rows a group's frames reach back.
REACH = {
    "change": 1,
    "ema": 19,
    "sma": 199,
    "rsi": 14,
    "macd": 25,
    "bbands": 19,
    "atr": 14,
    "obv": 1,
    "stoch": 17,
}
BAR_COLUMNS = ("open_px", "high_px", "low_px", "close_px", "volume")
FAST, SLOW, SIGNAL = 12, 26, 9
OUTPUTS = {
    "change": ("daily_change_usd", "daily_return_pct"),
    "ema": ("ema_20",),
    "sma": ("sma_50", "sma_200"),
    "rsi": ("rsi_14",),
    "macd": ("macd", "macd_hist", "macd_signal"),
    "bbands": ("bbl_20_2", "bbm_20_2", "bbu_20_2", "bbb_20_2", "bbp_20_2"),
    "atr": ("atr_14",),
    "obv": ("obv",),
    "stoch": ("stoch_k", "stoch_d"),
}


def _ema(n: int) -> float:
    return 2 / (n + 1)


def add_indicators(
    bars: DataFrame, groups: Iterable[str] = tuple(REACH), keep: Iterable[str] = ()
) -> DataFrame:
    """Add the indicator columns of the given groups (see ``OUTPUTS``).

    ``keep`` may name the position helpers, so that a next step need not number rows again.
    """
    groups = set(groups)
    require_columns(bars, ["ticker", "trade_date", *BAR_COLUMNS])
    scans: list[Scan] = []
    if "ema" in groups:
        scans.append(Scan("_ema20", 1 - _ema(20)))
    if "rsi" in groups:
        scans += [Scan("_gain", 13 / 14), Scan("_loss", 13 / 14)]
    if "atr" in groups:
        scans.append(Scan("_atr", 13 / 14))
    if "macd" in groups:
        scans += [
            Scan("_fast", 1 - _ema(FAST)),
            Scan("_slow", 1 - _ema(SLOW)),
            Scan(
                "_signal",
                1 - _ema(SIGNAL),
                (("_fast", _ema(SIGNAL)), ("_slow", -_ema(SIGNAL))),
            ),
        ]
    if "obv" in groups:
        scans.append(Scan("_obv", 1.0))

    rows = block_rows([s.factor for s in scans])
    numbered = with_positions(bars, complete=BAR_COLUMNS)
    laid = with_blocks(numbered, before=max(REACH[g] for g in groups), rows=rows)

    # Frames over the raw columns. Numbered bars have no NULLs: a frame is full from its n-th row on.
    by = f"partition by ticker, {BLOCK} order by {POS}"
    step = [f"lag(close_px) over ({by}) as _prev"]
    if "sma" in groups:
        step.append(f"sum(close_px) over ({by} {TO_HERE}) as _prefix")
    if "bbands" in groups:
        last = f"({by} rows between 19 preceding and current row)"
        step += [
            f"avg(close_px) over {last} as _mean20",
            f"stddev_pop(close_px) over {last} as _sigma20",
        ]
    if "stoch" in groups:
        last = f"({by} rows between 13 preceding and current row)"
        step += [f"min(low_px) over {last} as _lowest", f"max(high_px) over {last} as _highest"]
    laid = laid.selectExpr("*", *step)

    # Inputs of the recurrences, and frames over the first ones.
    change = "(close_px - _prev)"
    step = []
    if "sma" in groups:
        step += [f"{_long_mean(n, by)} as sma_{n}" for n in (50, 200)]
    if "stoch" in groups:
        raw = "try_divide((close_px - _lowest) * 100, _highest - _lowest)"
        step.append(f"case when {POS} >= 13 then {raw} end as _raw_k")
    if "ema" in groups:
        step.append(f"{seeded('close_px', 20, _ema(20), 0)} as _in_ema20")
    if "rsi" in groups:
        step.append(f"{seeded(f'greatest({change}, 0D)', 14, 1 / 14, 1)} as _in_gain")
        step.append(f"{seeded(f'greatest(-{change}, 0D)', 14, 1 / 14, 1)} as _in_loss")
    if "atr" in groups:
        true_range = "greatest(high_px - low_px, abs(high_px - _prev), abs(low_px - _prev))"
        step.append(f"{seeded(true_range, 14, 1 / 14, 1)} as _in_atr")
    if "macd" in groups:
        step.append(f"{seeded('close_px', FAST, _ema(FAST), 0)} as _in_fast")
        step.append(f"{seeded('close_px', SLOW, _ema(SLOW), 0)} as _in_slow")
    if "obv" in groups:
        signed = f"cast(signum({change}) as bigint) * volume"
        step.append(f"case when _prev is null then volume else {signed} end as _in_obv")
    if step:
        laid = laid.selectExpr("*", *step)
    if "stoch" in groups:
        laid = laid.selectExpr("*", f"{_mean3('_raw_k', by)} as stoch_k")
        laid = laid.selectExpr("*", f"{_mean3('stoch_k', by)} as stoch_d")

    # From here on nothing looks back beyond the block: the copied rows can go.
    done = core_rows(laid)
    if scans:
        plain = [s for s in scans if not s.fed_by]
        done = done.selectExpr(
            "*", *[f"{running(f'_in{s.name}', s.factor, rows)} as {s.local}" for s in plain]
        )
        if "macd" in groups:
            line = "_local__fast - _local__slow"
            fed = seeded(line, SIGNAL, _ema(SIGNAL), SLOW - 1)
            done = done.selectExpr(
                "*", f"{running(fed, 1 - _ema(SIGNAL), rows)} as _local__signal"
            )
        done = complete(done, scans, rows=rows)

    first_signal = SLOW + SIGNAL - 2
    half = "2 * _sigma20"
    formulas = {
        "daily_change_usd": (change, 0),
        "daily_return_pct": ("try_divide(close_px, _prev) - 1", 0),
        "ema_20": ("_ema20", 19),
        "sma_50": ("sma_50", 49),
        "sma_200": ("sma_200", 199),
        "rsi_14": ("try_divide(_gain * 100, _gain + _loss)", 14),
        "macd": ("_fast - _slow", SLOW - 1),
        "macd_hist": ("_fast - _slow - _signal", first_signal),
        "macd_signal": ("_signal", first_signal),
        "bbl_20_2": (f"_mean20 - {half}", 19),
        "bbm_20_2": ("_mean20", 19),
        "bbu_20_2": (f"_mean20 + {half}", 19),
        "bbb_20_2": (f"try_divide(200 * {half}, _mean20)", 19),
        "bbp_20_2": (f"try_divide(close_px - (_mean20 - {half}), 2 * {half})", 19),
        "atr_14": ("_atr", 14),
        "obv": ("cast(_obv as double)", 0),
        "stoch_k": ("stoch_k", 0),
        "stoch_d": ("stoch_d", 0),
    }
    wanted = [
        f"case when {POS} >= {formulas[c][1]} then {formulas[c][0]} end as {c}"
        for g in OUTPUTS
        if g in groups
        for c in OUTPUTS[g]
    ]
    return done.selectExpr(*[f"`{c}`" for c in bars.columns], *wanted, *keep)


def _long_mean(n: int, by: str) -> str:
    """Mean of the last ``n`` closes as a difference of prefix sums: its cost does not grow with n."""
    return f"(_prefix - coalesce(lag(_prefix, {n}) over ({by}), 0D)) / {n}"


def _mean3(x: str, by: str) -> str:
    last = f"({by} rows between 2 preceding and current row)"
    return f"case when count({x}) over {last} = 3 then avg({x}) over {last} end"


def add_one_day_targets(bars: DataFrame, keep_null: bool = False) -> DataFrame:
    """Next day's return and its sign (0 where the next day is unknown, or NULL)."""
    out = over_series(
        bars,
        lambda w: {"target_forward_return": F.lead("daily_return_pct", 1).over(w)},
        after=1,
    )
    up = (F.col("target_forward_return") > 0).cast("int")
    return out.withColumn("target_direction", up if keep_null else F.coalesce(up, F.lit(0)))


def market_table(ohlcv: DataFrame, start, end) -> DataFrame:
    """Indicators and one-day targets over the whole history, then the date cut.

    The cut comes last, so that the long averages are warm on its first day.
    """
    enriched = add_one_day_targets(add_indicators(ohlcv, keep=(POS, COUNT)))
    return enriched.filter(F.col("trade_date").between(F.lit(start), F.lit(end)))
