"""Forecast metrics, backtest, column profile, model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.adapters import BARS, NEWS, PREDICTIONS, bars, news, predictions, r, rounded, table
from contract.registry import check, sql
from contract.series_checks import _bounds
from tidewire.functions.expressions import strategy_return, trading_signal
from tidewire.operators import dataset as D
from tidewire.operators import evaluate as E
from tidewire.operators import profile as P
from tidewire.session import materialise

_METRICS = """avg(abs(y - y_hat)) as mae, sqrt(avg((y - y_hat) * (y - y_hat))) as rmse,
  1 - sum((y - y_hat) * (y - y_hat)) / (var_pop(y) * count(y)) as r2"""


def stored_predictions(spark, sf_dir):
    """As a model job leaves them: a table that the report reads several times."""
    return materialise(predictions(spark, sf_dir), "predictions")


METRICS = f"metrics as (select {_METRICS} from predictions)"


@check("a10_regression_metrics", sql(
    f"select {r('mae', 'mae')}, {r('rmse', 'rmse')}, {r('r2', 'r2')} from metrics", PREDICTIONS, METRICS))
def _(spark, sf_dir):
    return rounded(E.regression_metrics(predictions(spark, sf_dir)))


@check("a11_directional_accuracy", sql(
    f"""select {r('avg((sign(y) = sign(y_hat))::int::double) * 100', 'directional_accuracy')}
        from predictions""", PREDICTIONS))
def _(spark, sf_dir):
    return rounded(E.directional_accuracy(predictions(spark, sf_dir)))


RANKS = """ranked as (
  select rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0::double as ry,
    rank() over (order by y_hat) + (count(*) over (partition by y_hat) - 1) / 2.0::double as rp
  from predictions)"""


@check("a12_information_coefficient", sql(
    f"select {r('corr(ry, rp)', 'ic')}, count(*) as n from ranked", PREDICTIONS, RANKS))
def _(spark, sf_dir):
    return rounded(E.information_coefficient(stored_predictions(spark, sf_dir)).select("ic", "n"))


# The p-value as a ratio of integrals: with x = sin(a) the density of a correlation of n pairs
# without dependence is cos(a)^(n - 3). Simpson's rule over a = u / sqrt(n), where it is not tiny.
P_VALUE = """measured as (select abs(corr(ry, rp)) as ic, count(*) as n from ranked),
steps as (
  select ic, n, i, case when i in (0, 20000) then 1 when i % 2 = 1 then 4 else 2 end as weight,
    least(pi() / 2, 40 / sqrt(n)) as reach
  from measured, range(0, 20001) t(i)),
areas as (
  select sum(weight * exp((n - 3) * ln(greatest(cos(reach * i / 20000), 1e-300)))) * any_value(reach) as whole,
    sum(case when asin(ic) < reach then weight * exp((n - 3) * ln(greatest(cos(
      asin(ic) + (reach - asin(ic)) * i / 20000), 1e-300))) end) * any_value(reach - asin(ic)) as tail
  from steps)"""


@check("a12_information_coefficient_p", sql(
    f"select {r('coalesce(tail / whole, 0)', 'p_value')} from areas", PREDICTIONS, RANKS, P_VALUE))
def _(spark, sf_dir):
    return rounded(E.information_coefficient(stored_predictions(spark, sf_dir)).select("p_value"))


def _vectors(spark, sf_dir, size: int):
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("double").alias("y"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(size)],
    )


@check("a13_feature_correlation", " union all ".join(
    f"select 'f{i}' as feature, {r(f'corr(embedding[{i + 1}]::double, label)', 'corr')} from embeddings"
    for i in range(5)))
def _(spark, sf_dir):
    return rounded(E.feature_correlation(_vectors(spark, sf_dir, 5), [f"f{i}" for i in range(5)]))


@check("a14_dead_features", """with spread as (
    select i, var_pop(embedding[i]::double) = 0 as dead
    from (select embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by i)
  select count(*) filter (where dead) + 1 as dead_features, count(*) + 1 as features from spread""")
def _(spark, sf_dir):
    """Every position of the vector, and a constant beside."""
    size = len(table(spark, sf_dir, "embeddings").first()["embedding"])
    with_constant = _vectors(spark, sf_dir, size).withColumn("constant", F.lit(0.5))
    out = E.dead_features(with_constant, [*[f"f{i}" for i in range(size)], "constant"])
    return out.select(F.col("dead_features").cast("long"), F.col("features").cast("long"))


@check("a13_vector_correlation", f"""with cells as (
    select label, unnest(embedding)::double as x, unnest(range(len(embedding)))::int as feature from embeddings)
  select feature, {r('corr(x, label)', 'corr')} from cells group by feature""")
def _(spark, sf_dir):
    """Every place of the vector, from the array column itself."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rounded(E.feature_correlation(vectors, "embedding", "label"))


@check("a14_vector_dead", """with cells as (
    select unnest(list_append(embedding, 0.5))::double as x, unnest(range(len(embedding) + 1)) as place from embeddings),
  spread as (select place, var_pop(x) = 0 as dead from cells group by place)
  select (count(*) filter (where dead))::int as dead_features, count(*)::int as features from spread""")
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.array_append(F.col("embedding").cast("array<double>"), F.lit(0.5)).alias("embedding")
    )
    return E.dead_features(vectors, "embedding")


THRESHOLDS = """thresholds as (
  select quantile_cont(y_hat, 0.75) as hi, quantile_cont(y_hat, 0.25) as lo from predictions)"""
SIGNALS = f"""{THRESHOLDS},
signals0 as (
  select p.*, hi, lo, case when y_hat > hi and y_hat > 0 then 1 when y_hat < lo and y_hat < 0 then -1
    else 0 end as signal from predictions p, thresholds),
signals as (select *, signal * y as ret, greatest(signal * y, -0.03) as floored from signals0)"""


@check("a15_thresholds", sql(
    f"select {r('hi', 'upper_threshold')}, {r('lo', 'lower_threshold')} from thresholds",
    PREDICTIONS, THRESHOLDS))
def _(spark, sf_dir):
    return rounded(E.thresholds(stored_predictions(spark, sf_dir)))


def _signals(spark, sf_dir, floor=None):
    return E.with_signals(stored_predictions(spark, sf_dir), floor=floor)


@check("x24_trading_signal", sql("select row_id, signal from signals", PREDICTIONS, SIGNALS))
def _(spark, sf_dir):
    return _signals(spark, sf_dir).select("row_id", "signal")


@check("x25_strategy_return", sql(
    f"select row_id, {r('ret', 'ret')}, {r('floored', 'floored')} from signals", PREDICTIONS, SIGNALS))
def _(spark, sf_dir):
    plain = _signals(spark, sf_dir)
    floored = strategy_return(F.col("signal"), F.col("y"), -0.03)
    return rounded(plain.select("row_id", "ret", floored.alias("floored")))


@check("x26_price_table", sql(
    f"""select row_id, {r('close_px * (1 + y)', 'actual_price')},
        {r('close_px * (1 + y_hat)', 'predicted_price')} from predictions""", PREDICTIONS))
def _(spark, sf_dir):
    out = E.price_table(predictions(spark, sf_dir))
    return rounded(out.select("row_id", "actual_price", "predicted_price"))


@check("a16_exposure", sql(
    f"select {r('avg((signal <> 0)::int::double) * 100', 'time_in_market')} from signals",
    PREDICTIONS, SIGNALS))
def _(spark, sf_dir):
    return rounded(E.backtest(_signals(spark, sf_dir)).select("time_in_market"))


def _backtest_sql(ret: str = "ret") -> str:
    return f"""{r(f'avg({ret}) * (252 / 5.0::double)', 'annualized_return')},
      {r(f'stddev_pop({ret}) * sqrt(252 / 5.0::double)', 'annualized_volatility')},
      {r(f'coalesce(avg({ret}) * (252 / 5.0::double) / nullif(stddev_pop({ret}) * sqrt(252 / 5.0::double), 0), 0)',
         'sharpe_ratio', 4)}"""


def _coarse_sharpe(df):
    return rounded(df.withColumn("sharpe_ratio", F.round("sharpe_ratio", 4)))


@check("a17_annualized", sql(f"select {_backtest_sql()} from signals", PREDICTIONS, SIGNALS))
def _(spark, sf_dir):
    return _coarse_sharpe(E.backtest(_signals(spark, sf_dir)).drop("time_in_market"))


SWEEP = """cuts as (
""" + " union all ".join(
    f"select {p} as pct, quantile_cont(y_hat, {p / 100}) as hi, quantile_cont(y_hat, {(100 - p) / 100}) as lo"
    " from predictions" for p in (70, 75, 80, 85, 90, 95)
) + """),
sweep as (
  select pct, y, case when y_hat > hi and y_hat > 0 then 1 when y_hat < lo and y_hat < 0 then -1
    else 0 end as signal, signal * y as ret from predictions, cuts)"""


@check("a18_percentile_sweep", sql(
    f"""select pct, {r('avg((signal <> 0)::int::double) * 100', 'time_in_market')}, {_backtest_sql()}
        from sweep group by pct""", PREDICTIONS, SWEEP))
def _(spark, sf_dir):
    return _coarse_sharpe(E.percentile_sweep(stored_predictions(spark, sf_dir)))


@check("a19_split_report", sql(
    """select split, ticker, min(trade_date) as first_date, max(trade_date) as last_date,
       count(*) as n_rows from split_bars group by all""", BARS, _bounds(0)))
def _(spark, sf_dir):
    return E.split_report(D.split_by_date(bars(spark, sf_dir)), by_ticker=True)


@check("a20_sample_report", sql(
    f"""select row_id, case signal when 1 then 'LONG' when -1 then 'SHORT' else 'CASH' end as signal_text,
        {r('y_hat * 100', 'predicted_pct')}, {r('y * 100', 'actual_pct')}, {r('ret * 100', 'profit_pct')}
        from signals order by row_id limit 5""", PREDICTIONS, SIGNALS))
def _(spark, sf_dir):
    return rounded(E.sample_report(_signals(spark, sf_dir), ["row_id"]))


@check("m9_evaluation_report", sql(
    f"""select {r('mae', 'mae')}, {r('rmse', 'rmse')}, {r('r2', 'r2')},
        (select {r('avg((sign(y) = sign(y_hat))::int::double) * 100', 'd')} from predictions) as directional_accuracy,
        (select {r('corr(ry, rp)', 'ic')} from ranked) as ic, s.*
        from metrics, (select {r('avg((signal <> 0)::int::double) * 100', 'time_in_market')}, {_backtest_sql('floored')},
          {r('max(hi)', 'upper_threshold')}, {r('max(lo)', 'lower_threshold')} from signals) s""",
    PREDICTIONS, METRICS, RANKS, SIGNALS))
def _(spark, sf_dir):
    report = E.evaluation_report(stored_predictions(spark, sf_dir), floor=-0.03)
    return _coarse_sharpe(report.drop("p_value"))


# --- profile ---

LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@check("a4_null_counts", sql(
    """select feature, missing from (
         select 'summary' as feature, count(*) filter (summary is null) as missing from news union all
         select 'sentiment_score', count(*) filter (sentiment_score is null) from news union all
         select 'title', count(*) filter (title is null) from news) where missing > 0""", NEWS))
def _(spark, sf_dir):
    return P.null_counts(news(spark, sf_dir))


@check("a5_describe", " union all ".join(
    f"""select '{c}' as feature, count({c}) as count, {r(f'avg({c})', 'mean')},
        {r(f'stddev_samp({c})', 'std')}, {r(f'min({c})', 'min')},
        {r(f'quantile_cont({c}::double, 0.25)', 'p25')}, {r(f'quantile_cont({c}::double, 0.5)', 'p50')},
        {r(f'quantile_cont({c}::double, 0.75)', 'p75')}, {r(f'max({c})', 'max')} from lineitem"""
    for c in LINE_COLUMNS))
def _(spark, sf_dir):
    return rounded(P.describe(table(spark, sf_dir, "lineitem"), LINE_COLUMNS))


def _outlier_sql(table_: str, c: str) -> str:
    q1 = f"(select quantile_cont({c}::double, 0.25) from {table_})"
    q3 = f"(select quantile_cont({c}::double, 0.75) from {table_})"
    share = (
        f"count(*) filter ({c} < {q1} - 1.5 * ({q3} - {q1}) or {c} > {q3} + 1.5 * ({q3} - {q1}))"
        " * 100.0 / count(*)"
    )
    return f"select '{c}' as feature, {r(share, 'outlier_percent')} from {table_}"


@check("a6_outlier_percent", " union all ".join(_outlier_sql("lineitem", c) for c in LINE_COLUMNS))
def _(spark, sf_dir):
    return rounded(P.outlier_percent(table(spark, sf_dir, "lineitem"), LINE_COLUMNS))


@check("a7_skewness", " union all ".join(
    f"select '{c}' as feature, {r(f'skewness({c})', 'skew')} from lineitem" for c in LINE_COLUMNS))
def _(spark, sf_dir):
    return rounded(P.skewness(table(spark, sf_dir, "lineitem"), LINE_COLUMNS))


_EVENT_PROFILE = f"""shape as (
  select outlier_percent, (select skewness(value) from events) as skew from ({_outlier_sql('events', 'value')}))"""


@check("a8_scaler_advice", sql(
    f"""select 'value' as feature, outlier_percent, {r('skew', 'skew')},
        case when outlier_percent > 1 then 'robust' when outlier_percent = 0 then 'standard'
          else 'either' end as outlier_advice,
        case when abs(skew) > 1 then 'robust' when abs(skew) <= 0.5 then 'standard'
          else 'either' end as skew_advice from shape""", _EVENT_PROFILE))
def _(spark, sf_dir):
    out = P.profile(table(spark, sf_dir, "events"), ["value"])
    return rounded(out.select("feature", "outlier_percent", "skew", "outlier_advice", "skew_advice"))


@check("a9_column_info", sql(
    """select 'news_id' as feature, count(news_id) as non_null, count(*) as row_count, 'bigint' as data_type from news
       union all select 'pub_time', count(pub_time), count(*), 'timestamp_ntz' from news
       union all select 'ticker', count(ticker), count(*), 'string' from news
       union all select 'title', count(title), count(*), 'string' from news
       union all select 'summary', count(summary), count(*), 'string' from news
       union all select 'sentiment_score', count(sentiment_score), count(*), 'double' from news""", NEWS))
def _(spark, sf_dir):
    return P.column_info(news(spark, sf_dir))
