"""Price series: indicators, targets, features, splits, scaling, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.adapters import BARS, NEWS, SCORED, TICKERS, bars, r, rounded, table
from contract.news_checks import AGG, DAILY, MAPPED, daily
from contract.registry import check, sql
from tidewire.operators import asof as J
from tidewire.operators import dataset as D
from tidewire.operators import features as Z
from tidewire.operators import indicators as I
from tidewire.plans import tables as P
from tidewire.operators.quantiles import approximate_quantiles
from tidewire.operators.recurrence import ewma_adjusted
from tidewire.operators.series import (
    COUNT,
    POS,
    diff,
    drop_helpers,
    over_series,
    pct_change,
    rolling,
    with_positions,
)
from tidewire.schemas import ANSWER_FEATURES, TECHNICAL_FEATURES
from tidewire.session import materialise

W = "window w as (partition by ticker order by trade_date)"


def frame(n: int) -> str:
    return f"(partition by ticker order by trade_date rows between {n - 1} preceding and current row)"


def full(agg: str, x: str, n: int) -> str:
    return f"case when count({x}) over {frame(n)} = {n} then {agg}({x}) over {frame(n)} end"


# Price-sized irrational results are compared at 4 decimals: a double has no more to offer there.
PRICE = 4


def key_and(df, *names, digits=6):
    return rounded(df.select("ticker", "trade_date", *names), digits)


def indicator(spark, sf_dir, *groups):
    return I.add_indicators(bars(spark, sf_dir), groups)


def gapped_indicator(spark, sf_dir, *groups):
    """Indicators over bars of which some lack a price or the volume."""
    day = F.dayofmonth("trade_date")
    holes = bars(spark, sf_dir).withColumns(
        {
            "close_px": F.when(day != 13, F.col("close_px")),
            "high_px": F.when(day != 17, F.col("high_px")),
            "volume": F.when(day != 21, F.col("volume")),
        }
    )
    return I.add_indicators(holes, groups)


# The same bars; an oracle works on the whole ones, the others have no indicators.
GAPPED = BARS.replace("bars as (", "all_bars as (") + """,
bars as (select * from all_bars where day(trade_date) not in (13, 17, 21))"""


def gapped(select: str, names, *ctes: str, recursive: bool = False) -> str:
    nulls = ", ".join(f"null::double as {n}" for n in names)
    both = f"""select * from ({select}) union all by name
      select ticker, trade_date, {nulls} from all_bars where day(trade_date) in (13, 17, 21)"""
    return sql(both, GAPPED, *ctes, recursive=recursive)


def numbered_returns(spark, sf_dir):
    return I.add_indicators(bars(spark, sf_dir), ["change"], keep=(POS, COUNT))


# Oracle building blocks.
NUMBERED = """numbered as (
  select *, row_number() over (partition by ticker order by trade_date) as i,
    close_px - lag(close_px) over (partition by ticker order by trade_date) as change,
    lag(close_px) over (partition by ticker order by trade_date) as prev_close from bars)"""


def average_cte(name: str, source: str, n: int, a: str) -> str:
    """A seeded recursive average of column x over (ticker, i) with i from 1."""
    return f"""{name} as (
  select ticker, cast({n} as bigint) as i, avg(x) as e from {source} where i <= {n}
  group by ticker having count(*) >= {n}
  union all
  select s.ticker, s.i, {a} * s.x + (1 - {a}) * p.e
  from {name} p join {source} s on s.ticker = p.ticker and s.i = p.i + 1)"""


CLOSES = "closes as (select ticker, i, close_px as x from numbered)"
GAINS = "gains as (select ticker, i - 1 as i, greatest(change, 0.0) as x from numbered where i > 1)"
LOSSES = "losses as (select ticker, i - 1 as i, greatest(-change, 0.0) as x from numbered where i > 1)"
RANGES = """ranges as (
  select ticker, i - 1 as i,
    greatest(high_px - low_px, abs(high_px - prev_close), abs(low_px - prev_close)) as x
  from numbered where i > 1)"""
EMA20 = average_cte("ema20", "closes", 20, "(2.0::double / 21)")
GAIN14 = average_cte("gain14", "gains", 14, "(1.0::double / 14)")
LOSS14 = average_cte("loss14", "losses", 14, "(1.0::double / 14)")
ATR14 = average_cte("atr14", "ranges", 14, "(1.0::double / 14)")
EMA12 = average_cte("ema12", "closes", 12, "(2.0::double / 13)")
EMA26 = average_cte("ema26", "closes", 26, "(2.0::double / 27)")
LINE = """line as (
  select a.ticker, a.i - 25 as i, a.e - b.e as x from ema12 a join ema26 b using (ticker, i))"""
SIGNAL = average_cte("signal9", "line", 9, "(2.0::double / 10)")


# --- differences, returns, one-day targets ---


@check("w1_diff", sql(
    f"select ticker, trade_date, {r('change', 'daily_change_usd')} from numbered", BARS, NUMBERED))
def _(spark, sf_dir):
    return key_and(indicator(spark, sf_dir, "change"), "daily_change_usd")


@check("w2_pct_change", sql(
    f"select ticker, trade_date, {r('close_px / prev_close - 1', 'daily_return_pct')} from numbered",
    BARS, NUMBERED))
def _(spark, sf_dir):
    out = over_series(
        bars(spark, sf_dir), lambda w: {"daily_return_pct": pct_change(F.col("close_px"), w)}, before=1
    )
    return key_and(out, "daily_return_pct")


RETURNS = """returns as (
  select *, close_px / prev_close - 1 as daily_return_pct from numbered)"""


@check("w3_forward_return", sql(
    f"select ticker, trade_date, {r('lead(daily_return_pct) over w', 'target_forward_return')} "
    f"from returns {W}", BARS, NUMBERED, RETURNS))
def _(spark, sf_dir):
    out = I.add_one_day_targets(numbered_returns(spark, sf_dir))
    return key_and(out, "target_forward_return")


@check("w4_direction", sql(
    f"""select ticker, trade_date,
       cast(coalesce(lead(daily_return_pct) over w > 0, false) as integer) as target_direction
       from returns {W}""", BARS, NUMBERED, RETURNS))
def _(spark, sf_dir):
    out = I.add_one_day_targets(numbered_returns(spark, sf_dir))
    return out.select("ticker", "trade_date", "target_direction")


_NEXT5 = "(partition by ticker order by trade_date rows between 1 following and 5 following)"
TARGETS = f"""targets as (
  select *, case when count(daily_return_pct) over {_NEXT5} = 5
    then sum(daily_return_pct) over {_NEXT5} end as target_forward_return from returns)"""


@check("w5_forward_5_multi", sql(
    f"select ticker, trade_date, {r('target_forward_return', 'target_forward_return')} from targets",
    BARS, NUMBERED, RETURNS, TARGETS))
def _(spark, sf_dir):
    return key_and(Z.add_forward_target(numbered_returns(spark, sf_dir)), Z.TARGET)


@check("w6_forward_5_single", sql(
    f"""select ticker, trade_date,
        {r('case when i >= 5 then target_forward_return end', 'target_forward_return')}
        from targets""", BARS, NUMBERED, RETURNS, TARGETS))
def _(spark, sf_dir):
    return key_and(Z.add_forward_target(numbered_returns(spark, sf_dir), single=True), Z.TARGET)


@check("p5_drop_null_target", sql(
    f"""select ticker, trade_date, {r('target_forward_return', 'target_forward_return')} from targets
        where target_forward_return is not null""", BARS, NUMBERED, RETURNS, TARGETS))
def _(spark, sf_dir):
    labelled = Z.add_forward_target(numbered_returns(spark, sf_dir))
    return key_and(Z.drop_missing_target(labelled), Z.TARGET)


# --- rolling frames ---


@check("w7_rolling_mean_20", sql(
    f"select ticker, trade_date, {r(full('avg', 'volume', 20), 'mean_20')} from bars", BARS))
def _(spark, sf_dir):
    out = over_series(
        bars(spark, sf_dir), lambda w: {"mean_20": rolling(F.avg, F.col("volume"), w, 20)}, before=19
    )
    return key_and(out, "mean_20")


@check("w8_rolling_mean_20_min1", sql(
    f"select ticker, trade_date, {r(f'avg(volume) over {frame(20)}', 'mean_20')} from bars", BARS))
def _(spark, sf_dir):
    out = over_series(
        bars(spark, sf_dir), lambda w: {"mean_20": rolling(F.avg, F.col("volume"), w, 20, 1)}, before=19
    )
    return key_and(out, "mean_20")


@check("w9_rolling_std_5_min1", sql(
    f"select ticker, trade_date, {r(f'stddev_samp(close_px) over {frame(5)}', 'std_5', PRICE)} from bars", BARS))
def _(spark, sf_dir):
    out = over_series(
        bars(spark, sf_dir),
        lambda w: {"std_5": rolling(F.stddev_samp, F.col("close_px"), w, 5, 1)},
        before=4,
    )
    return key_and(out, "std_5", digits=PRICE)


_F = "(2.0::double / 3)"
_WEIGHTED = f"""weighted as (
  select ticker, i, close_px as num, 1.0::double as den from numbered where i = 1
  union all
  select s.ticker, s.i, {_F} * p.num + s.close_px, {_F} * p.den + 1
  from weighted p join numbered s on s.ticker = p.ticker and s.i = p.i + 1)"""


@check("w10_ewma_5", sql(
    f"select ticker, trade_date, {r('num / den', 'ewma_5', PRICE)} from weighted join numbered using (ticker, i)",
    BARS, NUMBERED, _WEIGHTED, recursive=True))
def _(spark, sf_dir):
    out = ewma_adjusted(with_positions(bars(spark, sf_dir)), "close_px", 5, "ewma_5")
    return key_and(out, "ewma_5", digits=PRICE)


@check("w11_log_volume_change", sql(
    f"select ticker, trade_date, {r('ln(1 + volume) - ln(1 + lag(volume) over w)', 'log_volume_change')} "
    f"from bars {W}", BARS))
def _(spark, sf_dir):
    out = over_series(
        bars(spark, sf_dir), lambda w: {"log_volume_change": diff(F.log1p("volume"), w)}, before=1
    )
    return key_and(out, "log_volume_change")


@check("w12_relative_volume", sql(
    f"select ticker, trade_date, {r('volume / (' + full('avg', 'volume', 20) + ')', 'relative_volume_20')} "
    "from bars", BARS))
def _(spark, sf_dir):
    out = over_series(
        bars(spark, sf_dir),
        lambda w: {"relative_volume_20": F.try_divide(F.col("volume"), rolling(F.avg, F.col("volume"), w, 20))},
        before=19,
    )
    return key_and(out, "relative_volume_20")


OBV = """obv as (
  select ticker, trade_date, sum(coalesce(sign(change), 1) * volume) over (
    partition by ticker order by trade_date rows unbounded preceding) as obv from numbered)"""


@check("w13_obv_change", sql(
    f"""select ticker, trade_date, {r('sign(change) * volume / (' + full('avg', 'volume', 20) + ')',
        'obv_change_normalized')} from numbered""", BARS, NUMBERED))
def _(spark, sf_dir):
    out = over_series(
        indicator(spark, sf_dir, "obv"),
        lambda w: {
            "obv_change_normalized": F.try_divide(
                diff(F.col("obv"), w), rolling(F.avg, F.col("volume"), w, 20)
            )
        },
        before=19,
    )
    return key_and(out, "obv_change_normalized")


@check("w14_sma_50_200", gapped(
    f"""select ticker, trade_date, {r(full('avg', 'close_px', 50), 'sma_50')},
        {r(full('avg', 'close_px', 200), 'sma_200')} from bars""", ["sma_50", "sma_200"]))
def _(spark, sf_dir):
    return key_and(gapped_indicator(spark, sf_dir, "sma"), "sma_50", "sma_200")


# --- recurrences ---


@check("w15_ema_20", gapped(
    f"""select n.ticker, n.trade_date, {r('e.e', 'ema_20', PRICE)} from numbered n
        left join ema20 e using (ticker, i)""", ["ema_20"], NUMBERED, CLOSES, EMA20, recursive=True))
def _(spark, sf_dir):
    return key_and(gapped_indicator(spark, sf_dir, "ema"), "ema_20", digits=PRICE)


@check("w16_rsi_14", gapped(
    f"""select n.ticker, n.trade_date,
        {r('case when g.e + l.e <> 0 then 100 * g.e / (g.e + l.e) end', 'rsi_14')}
        from numbered n left join gain14 g on g.ticker = n.ticker and g.i = n.i - 1
        left join loss14 l on l.ticker = n.ticker and l.i = n.i - 1""",
    ["rsi_14"], NUMBERED, GAINS, LOSSES, GAIN14, LOSS14, recursive=True))
def _(spark, sf_dir):
    return key_and(gapped_indicator(spark, sf_dir, "rsi"), "rsi_14")


@check("w17_macd", gapped(
    f"""select n.ticker, n.trade_date, {r('m.x', 'macd', PRICE)},
        {r('m.x - s.e', 'macd_hist', PRICE)}, {r('s.e', 'macd_signal', PRICE)} from numbered n
        left join line m on m.ticker = n.ticker and m.i = n.i - 25
        left join signal9 s on s.ticker = n.ticker and s.i = n.i - 25""",
    ["macd", "macd_hist", "macd_signal"], NUMBERED, CLOSES, EMA12, EMA26, LINE, SIGNAL, recursive=True))
def _(spark, sf_dir):
    return key_and(gapped_indicator(spark, sf_dir, "macd"), "macd", "macd_hist", "macd_signal", digits=PRICE)


BANDS = f"""bands as (
  select ticker, trade_date, close_px, {full('avg', 'close_px', 20)} as m,
    {full('stddev_pop', 'close_px', 20)} as s from bars)"""


@check("w18_bollinger", gapped(
    f"""select ticker, trade_date, {r('m - 2 * s', 'bbl_20_2', PRICE)}, {r('m', 'bbm_20_2', PRICE)},
        {r('m + 2 * s', 'bbu_20_2', PRICE)}, {r('100 * 4 * s / m', 'bbb_20_2', PRICE)},
        {r('(close_px - (m - 2 * s)) / nullif(4 * s, 0)', 'bbp_20_2', PRICE)} from bands""", I.OUTPUTS["bbands"], BANDS))
def _(spark, sf_dir):
    return key_and(gapped_indicator(spark, sf_dir, "bbands"), *I.OUTPUTS["bbands"], digits=PRICE)


@check("w19_atr_14", gapped(
    f"""select n.ticker, n.trade_date, {r('a.e', 'atr_14', PRICE)} from numbered n
        left join atr14 a on a.ticker = n.ticker and a.i = n.i - 1""",
    ["atr_14"], NUMBERED, RANGES, ATR14, recursive=True))
def _(spark, sf_dir):
    return key_and(gapped_indicator(spark, sf_dir, "atr"), "atr_14", digits=PRICE)


@check("w20_obv", gapped(
    f"select ticker, trade_date, {r('obv', 'obv')} from obv", ["obv"], NUMBERED, OBV))
def _(spark, sf_dir):
    return key_and(gapped_indicator(spark, sf_dir, "obv"), "obv")


STOCH = f"""raw_k as (
  select ticker, trade_date, 100 * (close_px - ll) / nullif(hh - ll, 0) as k0 from (
    select ticker, trade_date, close_px, {full('min', 'low_px', 14)} as ll,
      {full('max', 'high_px', 14)} as hh from bars)),
smooth_k as (select ticker, trade_date, {full('avg', 'k0', 3)} as k1 from raw_k),
stoch as (select ticker, trade_date, k1 as stoch_k, {full('avg', 'k1', 3)} as stoch_d from smooth_k)"""


@check("w21_stochastic", gapped(
    f"select ticker, trade_date, {r('stoch_k', 'stoch_k')}, {r('stoch_d', 'stoch_d')} from stoch",
    ["stoch_k", "stoch_d"], STOCH))
def _(spark, sf_dir):
    return key_and(gapped_indicator(spark, sf_dir, "stoch"), "stoch_k", "stoch_d")


MARKET = f"""market as (
  select n.ticker, n.trade_date, n.i, open_px, high_px, low_px, n.close_px, volume,
    change as daily_change_usd, n.close_px / prev_close - 1 as daily_return_pct, e.e as ema_20,
    {full('avg', 'n.close_px', 50)} as sma_50, {full('avg', 'n.close_px', 200)} as sma_200,
    case when g.e + l.e <> 0 then 100 * g.e / (g.e + l.e) end as rsi_14, m.x as macd,
    m.x - s.e as macd_hist, s.e as macd_signal, b.m as bbm_20_2,
    (n.close_px - (b.m - 2 * b.s)) / nullif(4 * b.s, 0) as bbp_20_2, a.e as atr_14, o.obv,
    k.stoch_k, k.stoch_d
  from numbered n left join ema20 e using (ticker, i)
  left join gain14 g on g.ticker = n.ticker and g.i = n.i - 1
  left join loss14 l on l.ticker = n.ticker and l.i = n.i - 1
  left join line m on m.ticker = n.ticker and m.i = n.i - 25
  left join signal9 s on s.ticker = n.ticker and s.i = n.i - 25
  left join atr14 a on a.ticker = n.ticker and a.i = n.i - 1
  left join bands b on b.ticker = n.ticker and b.trade_date = n.trade_date
  left join obv o on o.ticker = n.ticker and o.trade_date = n.trade_date
  left join stoch k on k.ticker = n.ticker and k.trade_date = n.trade_date)""".replace(
    "partition by ticker order by trade_date", "partition by n.ticker order by n.trade_date"
)
MARKET_CTES = (
    BARS, NUMBERED, CLOSES, GAINS, LOSSES, RANGES, EMA20, GAIN14, LOSS14, ATR14, EMA12, EMA26, LINE,
    SIGNAL, BANDS, OBV, STOCH, MARKET,
)
_E2_COLUMNS = (
    "daily_change_usd", "daily_return_pct", "ema_20", "sma_50", "sma_200", "rsi_14", "macd",
    "macd_hist", "macd_signal", "bbm_20_2", "bbp_20_2", "atr_14", "obv", "stoch_k", "stoch_d",
)


def _digits(column: str) -> int:
    return PRICE if column in ("ema_20", "macd", "macd_hist", "macd_signal", "atr_14") else 6


@check("e2_market_table", sql(
    f"""select ticker, trade_date, {', '.join(r(c, c, _digits(c)) for c in _E2_COLUMNS)},
        {r('nxt', 'target_forward_return')},
        cast(coalesce(nxt > 0, false) as integer) as target_direction
        from (select *, lead(daily_return_pct) over (partition by ticker order by trade_date) as nxt
              from market)
        where trade_date between date '1996-01-01' and date '1998-12-31'""",
    *MARKET_CTES, recursive=True))
def _(spark, sf_dir):
    out = I.market_table(bars(spark, sf_dir), "1996-01-01", "1998-12-31")
    coarse = out.withColumns(
        {c: F.round(c, PRICE) for c in _E2_COLUMNS if _digits(c) == PRICE}
    )
    return key_and(coarse, *_E2_COLUMNS, Z.TARGET, "target_direction")


# --- stationary features ---


@check("x1_intraday", sql(
    f"""select ticker, trade_date, {r('(close_px - open_px) / open_px', 'open_close_return')},
        {r('(high_px - low_px) / close_px', 'high_low_range')} from bars""", BARS))
def _(spark, sf_dir):
    from tidewire.functions.expressions import high_low_range, open_close_return

    return key_and(
        bars(spark, sf_dir).withColumns(
            {
                "open_close_return": open_close_return(F.col("open_px"), F.col("close_px")),
                "high_low_range": high_low_range(F.col("high_px"), F.col("low_px"), F.col("close_px")),
            }
        ),
        "open_close_return", "high_low_range",
    )


@check("x2_average_distance", sql(
    f"""select ticker, trade_date, {r('(close_px - ema_20) / ema_20', 'ema_20_dist')},
        {r('(close_px - sma_50) / sma_50', 'sma_50_dist')},
        {r('(close_px - sma_200) / sma_200', 'sma_200_dist')} from market""",
    *MARKET_CTES, recursive=True))
def _(spark, sf_dir):
    from tidewire.functions.expressions import distance

    out = indicator(spark, sf_dir, "ema", "sma")
    names = ("ema_20", "sma_50", "sma_200")
    return rounded(
        out.select(
            "ticker", "trade_date",
            *[distance(F.col("close_px"), F.col(n)).alias(f"{n}_dist") for n in names],
        )
    )


@check("x3_ratio_to_close", sql(
    f"""select ticker, trade_date, {r('atr_14 / close_px', 'atr_14_pct')},
        {r('macd / close_px', 'macd_pct')}, {r('macd_hist / close_px', 'macd_hist_pct')} from market""",
    *MARKET_CTES, recursive=True))
def _(spark, sf_dir):
    from tidewire.functions.expressions import ratio

    out = indicator(spark, sf_dir, "atr", "macd")
    pairs = {"atr_14": "atr_14_pct", "macd": "macd_pct", "macd_hist": "macd_hist_pct"}
    return rounded(
        out.select("ticker", "trade_date",
                   *[ratio(F.col(a), F.col("close_px")).alias(b) for a, b in pairs.items()])
    )


STATIONARY = f"""labelled as (
  select *, case when count(daily_return_pct) over {_NEXT5} = 5
    then sum(daily_return_pct) over {_NEXT5} end as target_forward_return from market),
stationary0 as (
  select *, (close_px - open_px) / open_px as open_close_return,
    (high_px - low_px) / close_px as high_low_range, (close_px - ema_20) / ema_20 as ema_20_dist,
    (close_px - sma_50) / sma_50 as sma_50_dist, (close_px - sma_200) / sma_200 as sma_200_dist,
    ln(1 + volume) - ln(1 + lag(volume) over w) as log_volume_change,
    volume / ({full('avg', 'volume', 20)}) as relative_volume_20, atr_14 / close_px as atr_14_pct,
    (obv - lag(obv) over w) / ({full('avg', 'volume', 20)}) as obv_change_normalized,
    macd / close_px as macd_pct, macd_hist / close_px as macd_hist_pct
  from labelled where target_forward_return is not null {W}),
stationary as (
  select * from stationary0 where {' and '.join(f'{c} is not null' for c in Z.STATIONARY)})"""


def labelled_features(spark, sf_dir, strict=False):
    market = I.add_indicators(bars(spark, sf_dir), keep=(POS, COUNT))
    return Z.labelled_features(market, strict=strict)


@check("x4_stationary_features", sql(
    f"""select ticker, trade_date, {', '.join(r(c, c) for c in Z.STATIONARY)},
        {r('target_forward_return', 'target_forward_return')} from stationary""",
    *MARKET_CTES, STATIONARY, recursive=True))
def _(spark, sf_dir):
    return key_and(labelled_features(spark, sf_dir), *Z.STATIONARY, Z.TARGET)


@check("p6_drop_incomplete", sql(
    f"""select ticker, trade_date, {', '.join(r(c, c) for c in Z.STATIONARY)} from stationary0
        where columns(*) is not null""".replace(
        "columns(*) is not null",
        " and ".join(f"{c} is not null" for c in (*Z.STATIONARY, *_E2_COLUMNS)),
    ), *MARKET_CTES, STATIONARY, recursive=True))
def _(spark, sf_dir):
    return key_and(labelled_features(spark, sf_dir, strict=True), *Z.STATIONARY)


# --- sentiment features over the joined table ---


def joined(spark, sf_dir):
    both = J.merge_market_and_sentiment(bars(spark, sf_dir), daily(spark, sf_dir), "llm_")
    return materialise(both, "market-sentiment")


SENTIMENT_BASE = """sentiment_base as (
  select b.ticker, b.trade_date, a.llm_score, coalesce(a.news_count, 0) as news_count,
    row_number() over (partition by b.ticker order by b.trade_date) as i
  from bars b left join agg a on b.ticker = a.ticker and b.trade_date = a.market_date),
memory as (
  select ticker, i, coalesce(llm_score, 0.0)::double as num,
    case when llm_score is null then 0.0::double else 1.0 end as den
  from sentiment_base where i = 1
  union all
  select s.ticker, s.i, (2.0::double / 3) * p.num + coalesce(s.llm_score, 0.0),
    (2.0::double / 3) * p.den + case when s.llm_score is null then 0.0 else 1.0 end
  from memory p join sentiment_base s on s.ticker = p.ticker and s.i = p.i + 1),
sentiment as (
  select s.*, num / nullif(den, 0) as ewma from sentiment_base s join memory using (ticker, i))"""
SENTIMENT_CTES = (BARS, NEWS, SCORED, DAILY, MAPPED, AGG, SENTIMENT_BASE)


@check("x5_sentiment_impact", sql(
    f"""select ticker, trade_date,
        {r('coalesce(llm_score * ln(1 + news_count), 0)', 'llm_sentiment_impact')} from sentiment""",
    *SENTIMENT_CTES, recursive=True))
def _(spark, sf_dir):
    return key_and(Z.sentiment_features(joined(spark, sf_dir)), "llm_sentiment_impact")


@check("x6_sentiment_delta", sql(
    f"""select ticker, trade_date, {r('coalesce(ewma, 0)', 'llm_ewma_5')},
        {r('coalesce(llm_score - ewma, 0)', 'llm_sentiment_delta')} from sentiment""",
    *SENTIMENT_CTES, recursive=True))
def _(spark, sf_dir):
    return key_and(Z.sentiment_features(joined(spark, sf_dir)), "llm_ewma_5", "llm_sentiment_delta")


@check("x7_news_volume_spike", sql(
    f"""select ticker, trade_date,
        {r(f'news_count / (avg(news_count) over {frame(20)} + 1)', 'news_volume_spike')},
        {r(f'coalesce(stddev_samp(llm_score) over {frame(5)}, 0)', 'sentiment_volatility')},
        {r('coalesce(ewma, 0)', 'finbert_ewma_5')} from sentiment""",
    *SENTIMENT_CTES, recursive=True))
def _(spark, sf_dir):
    table_ = joined(spark, sf_dir).withColumnRenamed("llm_score", "finbert_score")
    return key_and(
        Z.sentiment_features(table_, "finbert"),
        "news_volume_spike", "sentiment_volatility", "finbert_ewma_5",
    )


@check("x27_one_hot", sql(
    """select ticker, trade_date, (ticker = '1-URGENT')::int as "ticker_1-URGENT",
       (ticker = '2-HIGH')::int as "ticker_2-HIGH", (ticker = '3-MEDIUM')::int as "ticker_3-MEDIUM",
       (ticker = '4-NOT SPECIFIED')::int as "ticker_4-NOT SPECIFIED",
       (ticker = '5-LOW')::int as "ticker_5-LOW" from bars""", BARS))
def _(spark, sf_dir):
    return Z.one_hot(bars(spark, sf_dir).select("ticker", "trade_date"), TICKERS)


# --- splits and scaling ---


@check("m1_row_split", sql(
    """select ticker, trade_date, case when i <= floor(n * 0.9::double) then 'train' else 'test' end as split
       from (select *, count(*) over (partition by ticker) as n from numbered)""", BARS, NUMBERED))
def _(spark, sf_dir):
    return D.split_by_row(bars(spark, sf_dir)).select("ticker", "trade_date", "split")


def _bounds(warmup: int) -> str:
    return f"""dates as (
  select trade_date, row_number() over (order by trade_date) - 1 as k, count(*) over () as n
  from (select distinct trade_date from bars)),
bounds as (
  select max(case when k = floor(n * 0.8::double) then trade_date end) as train_end,
    max(case when k = floor(n * 0.9::double) then trade_date end) as val_end,
    max(case when k = greatest(floor(n * 0.8::double) - {warmup}, 0) then trade_date end) as val_start,
    max(case when k = greatest(floor(n * 0.9::double) - {warmup}, 0) then trade_date end) as test_start
  from dates),
split_bars as (
  select b.*, 'train' as split from bars b, bounds where trade_date < train_end
  union all select b.*, 'val' from bars b, bounds where trade_date >= val_start and trade_date < val_end
  union all select b.*, 'test' from bars b, bounds where trade_date >= test_start)"""


@check("m2_date_split", sql("select ticker, trade_date, split from split_bars", BARS, _bounds(0)))
def _(spark, sf_dir):
    return D.split_by_date(bars(spark, sf_dir)).select("ticker", "trade_date", "split")


@check("m3_date_split_warmup", sql(
    "select ticker, trade_date, split from split_bars", BARS, _bounds(20)))
def _(spark, sf_dir):
    return D.split_by_date(bars(spark, sf_dir), warmup=20).select("ticker", "trade_date", "split")


_SCALED = ("open_px", "close_px", "volume")


@check("m4_robust_scaler", sql(
    "select ticker, trade_date, split, " + ", ".join(
        r(f"({c} - (select quantile_cont({c}::double, 0.5) from split_bars where split = 'train'))"
          f" / (select quantile_cont({c}::double, 0.75) - quantile_cont({c}::double, 0.25)"
          f" from split_bars where split = 'train')", c)
        for c in _SCALED) + " from split_bars", BARS, _bounds(0)))
def _(spark, sf_dir):
    parts = materialise(D.split_by_date(bars(spark, sf_dir)), "splits")
    fitted = D.fit_scaler(parts.filter("split = 'train'"), _SCALED)
    out = D.apply_scaler(parts, fitted, _SCALED)
    return rounded(out.select("ticker", "trade_date", "split", *_SCALED))


@check("m4_standard_scaler", sql(
    "select ticker, trade_date, split, " + ", ".join(
        r(f"({c} - (select avg({c}) from split_bars where split = 'train'))"
          f" / (select stddev_pop({c}) from split_bars where split = 'train')", c)
        for c in _SCALED) + " from split_bars", BARS, _bounds(0)))
def _(spark, sf_dir):
    parts = materialise(D.split_by_date(bars(spark, sf_dir)), "splits")
    fitted = D.fit_scaler(parts.filter("split = 'train'"), _SCALED, "standard")
    out = D.apply_scaler(parts, fitted, _SCALED)
    return rounded(out.select("ticker", "trade_date", "split", *_SCALED))


# --- sequences ---

_SEQ_FEATURES = ("open_px", "close_px", "volume")


def _sequence_sql(lookback: int, group: str, gap: int = 1) -> str:
    w = (
        f"(partition by {group} order by trade_date rows between {lookback - 1 + gap} preceding "
        f"and {gap} preceding)"
    )
    return f"""seq as (
  select {group}, trade_date, close_px as y, count(*) over {w} as n_steps,
    first_value(open_px) over {w} as first_open, last_value(open_px) over {w} as last_open,
    last_value(close_px) over {w} as last_close, sum(volume) over {w} as sum_volume,
    last_value(high_px) over {w} as last_high
  from {{source}})"""


def _reduced(seqs, *group):
    total = F.aggregate("seq", F.lit(0.0), lambda acc, step: acc + step[2])
    return rounded(
        seqs.select(
            *group, "trade_date", F.size("seq").alias("n_steps"), "y",
            F.col("seq")[0][0].alias("first_open"), F.col("tech")[0].alias("last_open"),
            F.col("tech")[1].alias("last_close"), total.alias("sum_volume"),
            *([F.col("news_vec")[0].alias("last_high")] if "news_vec" in seqs.columns else []),
        )
    )


def _sequence_select(group: str, news: bool) -> str:
    return f"""select {group}, trade_date, n_steps, {r('y', 'y')}, {r('first_open', 'first_open')},
      {r('last_open', 'last_open')}, {r('last_close', 'last_close')}, {r('sum_volume', 'sum_volume')}
      {', ' + r('last_high', 'last_high') if news else ''}
      from seq where n_steps = {{lookback}}"""


@check("w22_sequences_single", sql(
    _sequence_select("ticker", False).format(lookback=10), BARS,
    _sequence_sql(10, "ticker").format(source="bars")))
def _(spark, sf_dir):
    seqs = D.sequences(bars(spark, sf_dir), _SEQ_FEATURES, 10, target="close_px")
    return _reduced(seqs, "ticker")


@check("w22_sequences_no_gap", sql(
    _sequence_select("ticker", False).format(lookback=10), BARS,
    _sequence_sql(10, "ticker", gap=0).format(source="bars")))
def _(spark, sf_dir):
    seqs = D.sequences(bars(spark, sf_dir), _SEQ_FEATURES, 10, target="close_px", horizon_gap=0)
    return _reduced(seqs, "ticker")


@check("w23_sequences_multi", sql(
    _sequence_select("split, ticker", False).format(lookback=20), BARS, _bounds(20),
    _sequence_sql(20, "split, ticker").format(source="split_bars")))
def _(spark, sf_dir):
    parts = D.split_by_date(bars(spark, sf_dir), warmup=20)
    seqs = D.sequences(parts, _SEQ_FEATURES, 20, target="close_px", group=("split", "ticker"))
    return _reduced(seqs, "split", "ticker")


@check("w24_sequences_news", sql(
    _sequence_select("split, ticker", True).format(lookback=20), BARS, _bounds(20),
    _sequence_sql(20, "split, ticker").format(source="split_bars")))
def _(spark, sf_dir):
    parts = D.split_by_date(bars(spark, sf_dir), warmup=20)
    seqs = D.sequences(
        parts, _SEQ_FEATURES, 20, news=["high_px"], target="close_px", group=("split", "ticker")
    )
    return _reduced(seqs, "split", "ticker")


@check("w25_last_step", sql(
    f"""select ticker, trade_date, {r('last_open', 'last_open')}, {r('last_close', 'last_close')}
        from seq where n_steps = 10""", BARS, _sequence_sql(10, "ticker").format(source="bars")))
def _(spark, sf_dir):
    seqs = D.sequences(bars(spark, sf_dir), _SEQ_FEATURES, 10, target="close_px")
    return rounded(
        seqs.select("ticker", "trade_date", F.col("tech")[0].alias("last_open"), F.col("tech")[1].alias("last_close"))
    )


@check("j5_hybrid_rows", sql(
    f"""select ticker, trade_date, 6 as n_features, {r('first_open - last_open', 'f1')},
        {r('sum_volume', 'f2')}, {r('last_open', 'f3')}, {r('last_high', 'f6')}, {r('y', 'y')}
        from seq where n_steps = 10""", BARS, _sequence_sql(10, "ticker").format(source="bars")))
def _(spark, sf_dir):
    seqs = D.sequences(bars(spark, sf_dir), _SEQ_FEATURES, 10, news=["high_px"], target="close_px")
    total = F.aggregate("seq", F.lit(0.0), lambda acc, step: acc + step[2])
    latent = seqs.select(
        "ticker", "trade_date",
        F.array(F.col("seq")[0][0] - F.col("tech")[0], total).alias("latent"),
    )
    out = D.assemble_hybrid(latent, seqs)
    f = F.col("features")
    return rounded(
        out.select("ticker", "trade_date", F.size(f).alias("n_features"), f[0].alias("f1"),
                   f[1].alias("f2"), f[2].alias("f3"), f[5].alias("f6"), "y")
    )


# --- the whole path ---

E3 = """feature_rows as (
  select s.*, a.llm_score, a.llm_relevance, coalesce(a.news_count, 0) as news_count,
    row_number() over (partition by s.ticker order by s.trade_date) as k
  from stationary s left join agg a on s.ticker = a.ticker and s.trade_date = a.market_date),
recall as (
  select ticker, k, coalesce(llm_score, 0.0)::double as num,
    case when llm_score is null then 0.0::double else 1.0 end as den
  from feature_rows where k = 1
  union all
  select s.ticker, s.k, (2.0::double / 3) * p.num + coalesce(s.llm_score, 0.0),
    (2.0::double / 3) * p.den + case when s.llm_score is null then 0.0 else 1.0 end
  from recall p join feature_rows s on s.ticker = p.ticker and s.k = p.k + 1),
model_rows as (
  select f.*, num / nullif(den, 0) as ewma from feature_rows f join recall using (ticker, k))"""
_E3_COLUMNS = (*TECHNICAL_FEATURES, *ANSWER_FEATURES, Z.TARGET)
_E3_SQL = {
    "llm_score": "coalesce(llm_score, 0)",
    "llm_relevance": "coalesce(llm_relevance, 0)",
    "llm_ewma_5": "coalesce(ewma, 0)",
    "llm_sentiment_impact": "coalesce(llm_score * ln(1 + news_count), 0)",
    "llm_sentiment_delta": "coalesce(llm_score - ewma, 0)",
}
_E3_SHOWN = [c for c in _E3_COLUMNS if c not in ("llm_impact_magnitude", "llm_uncertainty", "news_count")]


def e3(spark, sf_dir):
    return P.model_table(bars(spark, sf_dir), daily(spark, sf_dir), tickers=TICKERS)


@check("e3_model_table", sql(
    f"""select ticker, trade_date, news_count, {', '.join(r(_E3_SQL.get(c, c), c) for c in _E3_SHOWN)},
        (ticker = '2-HIGH')::int as "ticker_2-HIGH" from model_rows""",
    *MARKET_CTES, STATIONARY, NEWS, SCORED, DAILY, MAPPED, AGG, E3, recursive=True))
def _(spark, sf_dir):
    return key_and(e3(spark, sf_dir), "news_count", *_E3_SHOWN, "`ticker_2-HIGH`")


@check("e3_hybrid_sequences", sql(
    f"""select split, ticker, trade_date, 20 as steps, 15 as features, 8 as news_features,
        {r('target_forward_return', 'y')}
        from (select *, row_number() over (partition by split, ticker order by trade_date) as place
              from split_bars) where place > 20""",
    *MARKET_CTES, STATIONARY, NEWS, SCORED, DAILY, MAPPED, AGG, E3,
    _bounds(20).replace("from bars", "from model_rows"), recursive=True))
def _(spark, sf_dir):
    scaled = P.scaled_splits(e3(spark, sf_dir))
    seqs = P.hybrid_sequences(scaled)
    return rounded(
        seqs.select(
            "split", "ticker", "trade_date", F.size("seq").alias("steps"),
            F.size("tech").alias("features"), F.size("news_vec").alias("news_features"), "y",
        )
    )
