import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.operators import asof as J
from tidewire.operators import dataset as D
from tidewire.operators import features as Z
from tidewire.operators import indicators as I
from tidewire.operators.recurrence import ewma_adjusted
from tidewire.operators.series import BLOCK_ROWS, over_series, rolling, with_blocks, with_positions

DAY0 = dt.date(2001, 1, 1)


def make_bars(lengths, seed=3, flat=None):
    """Bars with gaps; ``flat`` = (first, last) place of a stretch of equal closes."""
    rng = random.Random(seed)
    rows = []
    for ticker, n in lengths.items():
        day, close = DAY0, 100.0
        for i in range(n):
            day += dt.timedelta(days=rng.choice([1, 1, 1, 1, 3, 200 if rng.random() < 0.01 else 1]))
            if not (flat and flat[0] <= i < flat[1]):
                close = max(1.0, close * (1 + rng.uniform(-0.05, 0.05)))
            open_ = close * (1 + rng.uniform(-0.01, 0.01))
            rows.append((day, ticker, open_, max(open_, close) * 1.01, min(open_, close) * 0.99, close, rng.randrange(1, 10**6)))
    return pd.DataFrame(rows, columns=["trade_date", "ticker", "open_px", "high_px", "low_px", "close_px", "volume"])


BARS_SCHEMA = "trade_date date, ticker string, open_px double, high_px double, low_px double, close_px double, volume long"


def seeded_average(x, n, alpha):
    """Naive fold: NULL, then the mean of the first n values, then the recurrence."""
    out = [math.nan] * len(x)
    for i in range(n - 1, len(x)):
        out[i] = sum(x[:n]) / n if i == n - 1 else alpha * x[i] + (1 - alpha) * out[i - 1]
    return np.array(out)


def naive(g):
    c, h, l, v = (g[k].to_numpy(float) for k in ("close_px", "high_px", "low_px", "volume"))
    change = np.diff(c, prepend=np.nan)
    out = {"daily_change_usd": change, "daily_return_pct": pd.Series(c).pct_change().to_numpy()}
    out["ema_20"] = seeded_average(c, 20, 2 / 21)
    for n in (50, 200):
        out[f"sma_{n}"] = pd.Series(c).rolling(n).mean().to_numpy()
    nan = [math.nan]
    gain = np.concatenate([nan, seeded_average(np.maximum(change[1:], 0), 14, 1 / 14)])
    loss = np.concatenate([nan, seeded_average(np.maximum(-change[1:], 0), 14, 1 / 14)])
    out["rsi_14"] = 100 * gain / (gain + loss)
    line = seeded_average(c, 12, 2 / 13) - seeded_average(c, 26, 2 / 27)
    signal = np.concatenate([[math.nan] * min(25, len(c)), seeded_average(line[25:], 9, 0.2)])
    out["macd"], out["macd_signal"], out["macd_hist"] = line, signal, line - signal
    prev = np.roll(c, 1)
    tr = np.maximum(h - l, np.maximum(abs(h - prev), abs(l - prev)))[1:]
    out["atr_14"] = np.concatenate([nan, seeded_average(tr, 14, 1 / 14)])
    out["obv"] = np.cumsum(np.where(np.isnan(change), 1, np.sign(change)) * v)
    mid, sd = pd.Series(c).rolling(20).mean(), pd.Series(c).rolling(20).std(ddof=0)
    out["bbm_20_2"], out["bbu_20_2"] = mid.to_numpy(), (mid + 2 * sd).to_numpy()
    ll, hh = pd.Series(l).rolling(14).min(), pd.Series(h).rolling(14).max()
    k = (100 * (pd.Series(c) - ll) / (hh - ll)).rolling(3).mean()
    out["stoch_k"], out["stoch_d"] = k.to_numpy(), k.rolling(3).mean().to_numpy()
    return out


def check_against_naive(spark, bars):
    got = I.add_indicators(spark.createDataFrame(bars, BARS_SCHEMA)).toPandas()
    assert len(got) == len(bars)
    for ticker, g in bars.groupby("ticker"):
        mine = got[got.ticker == ticker].sort_values("trade_date")
        for name, want in naive(g).items():
            have = mine[name].to_numpy(float)
            assert (np.isnan(have) == np.isnan(want)).all(), name
            np.testing.assert_allclose(have, want, rtol=1e-8, atol=1e-7, err_msg=f"{ticker} {name}")


def test_indicators_equal_naive_fold_across_blocks(spark):
    check_against_naive(spark, make_bars({"HOT": 3 * BLOCK_ROWS + 77, "B": BLOCK_ROWS, "C": BLOCK_ROWS + 1, "D": 30, "E": 1}))


def test_rsi_survives_a_long_flat_stretch(spark):
    # Gains and losses shrink together, so the index must stay where it was for all flat rows.
    check_against_naive(spark, make_bars({"F": 4 * BLOCK_ROWS}, flat=(500, 500 + 2 * BLOCK_ROWS)))


def test_positions_and_halo(spark):
    bars = make_bars({"A": 50, "B": 7})
    numbered = with_positions(spark.createDataFrame(bars, BARS_SCHEMA).repartition(5))
    pdf = numbered.toPandas().sort_values(["ticker", "trade_date"])
    assert pdf[pdf.ticker == "A"]["_pos"].tolist() == list(range(50))
    assert set(pdf[pdf.ticker == "B"]["_n"]) == {7}
    laid = with_blocks(numbered, before=3, after=2, rows=8).toPandas()
    assert laid["_core"].sum() == 57
    assert laid.groupby(["ticker", "_blk"]).size().max() <= 8 + 3 + 2


def test_ewma_with_gaps_equals_pandas(spark):
    rng = random.Random(5)
    rows = [(t, DAY0 + dt.timedelta(days=i), None if rng.random() < 0.4 else rng.uniform(-1, 1)) for t, n in (("A", 1500), ("B", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker string, trade_date date, s double")
    got = ewma_adjusted(with_positions(df), "s", 5, "e").toPandas().sort_values(["ticker", "trade_date"])
    want = pd.DataFrame(rows, columns=["ticker", "trade_date", "s"])
    want["e"] = want.groupby("ticker")["s"].transform(lambda x: x.ewm(span=5, min_periods=1).mean())
    np.testing.assert_allclose(got["e"].to_numpy(float), want.sort_values(["ticker", "trade_date"])["e"].to_numpy(float), atol=1e-12)


def test_rolling_min_periods(spark):
    df = spark.createDataFrame([("A", DAY0 + dt.timedelta(days=i), x) for i, x in enumerate([1.0, None, 4.0, 6.0])], "ticker string, trade_date date, x double")
    out = over_series(df, lambda w: {"m": rolling(F.avg, F.col("x"), w, 2), "m1": rolling(F.avg, F.col("x"), w, 2, 1), "s": rolling(F.stddev_samp, F.col("x"), w, 2, 1)}, before=1)
    rows = out.orderBy("trade_date").collect()
    assert [r.m for r in rows] == [None, None, None, 5.0]
    assert [r.m1 for r in rows] == [1.0, 1.0, 4.0, 5.0]
    assert [r.s for r in rows][:3] == [None, None, None]


def test_targets_single_and_multi(spark):
    bars = spark.createDataFrame(make_bars({"A": 40}), BARS_SCHEMA)
    returns = I.add_indicators(bars, ["change"])
    multi = Z.add_forward_target(returns).orderBy("trade_date").toPandas()[Z.TARGET]
    single = Z.add_forward_target(returns, single=True).orderBy("trade_date").toPandas()[Z.TARGET]
    assert multi.isna().sum() == 5 and single.isna().sum() == 9
    both = multi.notna() & single.notna()
    assert np.allclose(multi[both], single[both])
    last = I.add_one_day_targets(returns).orderBy("trade_date").toPandas()
    assert last["target_direction"].iloc[-1] == 0
    kept = I.add_one_day_targets(returns, keep_null=True).orderBy("trade_date").toPandas()
    assert math.isnan(kept["target_direction"].iloc[-1])


def test_labelled_features_equal_the_separate_steps(spark):
    market = I.add_indicators(spark.createDataFrame(make_bars({"A": 300, "B": 260}), BARS_SCHEMA))
    steps = Z.stationary_features(Z.drop_missing_target(Z.add_forward_target(market)))
    once = Z.labelled_features(market).select(steps.columns)
    a, b = (d.toPandas().sort_values(["ticker", "trade_date"]).reset_index(drop=True) for d in (steps, once))
    pd.testing.assert_frame_equal(a, b)


def test_division_by_zero_gives_null_and_drop(spark):
    df = spark.createDataFrame([(1.0, float("inf"), "a"), (float("nan"), 1.0, "b"), (1.0, 2.0, None), (1.0, 2.0, "d")], "x double, y double, z string")
    assert [r.z for r in Z.drop_incomplete(df).collect()] == ["d"]
    assert Z.drop_incomplete(df, ["x", "y"]).count() == 2
    assert Z.fill_zero(df.select(F.lit(None).cast("double").alias("x"))).first().x == 0.0


def test_one_hot(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "ticker string")
    out = Z.one_hot(df, ["b", "a"])
    assert out.columns == ["ticker", "ticker_a", "ticker_b"]
    assert Z.one_hot_vector(df).filter("ticker = 'b'").first().ticker_vec.toArray().tolist() == [0.0, 1.0]


def test_asof_forward(spark):
    d = dt.date
    market = spark.createDataFrame([("A", d(2020, 1, 6)), ("A", d(2020, 1, 7)), ("A", d(2023, 6, 1)), ("B", d(2020, 1, 7))], "ticker string, trade_date date")
    daily = spark.createDataFrame(
        [("A", d(2020, 1, 4)), ("A", d(2020, 1, 5)), ("A", d(2020, 1, 6)), ("A", d(2020, 1, 8)), ("A", d(2021, 3, 1)), ("A", d(2023, 6, 2)), ("B", d(2019, 12, 31)), ("C", d(2020, 1, 1))],
        "ticker string, news_date date",
    ).withColumns({"llm_score": F.rand(1), "news_count": F.lit(2).cast("long")})
    got = {(r.ticker, r.news_date): r.market_date for r in J.asof_forward(daily, market, "news_date", "trade_date").collect()}
    assert got == {
        ("A", d(2020, 1, 4)): d(2020, 1, 6), ("A", d(2020, 1, 5)): d(2020, 1, 6), ("A", d(2020, 1, 6)): d(2020, 1, 6),
        ("A", d(2020, 1, 8)): d(2023, 6, 1), ("A", d(2021, 3, 1)): d(2023, 6, 1), ("A", d(2023, 6, 2)): None,
        ("B", d(2019, 12, 31)): d(2020, 1, 7), ("C", d(2020, 1, 1)): None,
    }
    full = J.merge_market_and_sentiment(market, daily, "llm_").collect()
    assert len(full) == 4
    counts = {(r.ticker, r.trade_date): r.news_count for r in full}
    assert counts[("A", d(2020, 1, 6))] == 6 and counts[("A", d(2020, 1, 7))] == 0


def test_weighted_and_cutoff(spark):
    mapped = spark.createDataFrame([(DAY0, "A", 1.0, 3), (DAY0, "A", 0.0, 1), (DAY0, "A", None, 5)], "market_date date, ticker string, llm_score double, news_count long")
    assert J.aggregate_mapped(mapped, "llm_").first().llm_score == 0.5
    assert J.aggregate_mapped(mapped, "llm_", weighted=True).first().llm_score == 0.75
    news = spark.createDataFrame([(dt.datetime(2024, 1, 1, 15, 59), "A", 1.0), (dt.datetime(2024, 1, 1, 16, 0), "A", 0.0)], "pub_time timestamp_ntz, ticker string, llm_score double")
    assert J.group_news_by_date(news).first().news_count == 2
    late = {str(r.news_date): r.llm_score for r in J.group_news_by_date(news, cutoff_time="16:00:00").collect()}
    assert late == {"2024-01-01": 1.0, "2024-01-02": 0.0}


def test_splits(spark):
    bars = spark.createDataFrame(make_bars({"A": 101, "B": 37}), BARS_SCHEMA)
    by_row = D.split_by_row(bars).groupBy("ticker", "split").count().collect()
    assert {(r.ticker, r.split): r["count"] for r in by_row} == {("A", "train"): 90, ("A", "test"): 11, ("B", "train"): 33, ("B", "test"): 4}
    plain = D.split_by_date(bars).toPandas()
    assert len(plain) == 138
    ends = plain.groupby("split")["trade_date"].agg(["min", "max"])
    assert ends.loc["train", "max"] < ends.loc["val", "min"] and ends.loc["val", "max"] < ends.loc["test", "min"]
    dates = sorted(set(plain["trade_date"]))
    warm = D.split_by_date(bars, warmup=5).toPandas()
    assert min(warm[warm.split == "val"]["trade_date"]) == dates[int(len(dates) * 0.8) - 5]
    assert min(warm[warm.split == "test"]["trade_date"]) == dates[int(len(dates) * 0.9) - 5]


def test_scaler(spark):
    df = spark.createDataFrame([(float(x), 7.0) for x in (1, 2, 3, 4, 10)], "x double, same double")
    out = D.apply_scaler(df, D.fit_scaler(df, ["x", "same"]), ["x", "same"]).toPandas()
    assert out["x"].tolist() == [-1.0, -0.5, 0.0, 0.5, 3.5] and set(out["same"]) == {0.0}
    standard = D.apply_scaler(df, D.fit_scaler(df, ["x"], "standard"), ["x"]).toPandas()["x"]
    assert abs(standard.mean()) < 1e-12 and abs(standard.std(ddof=0) - 1) < 1e-12


def test_sequences(spark):
    bars = make_bars({"A": 25, "B": 10})
    df = spark.createDataFrame(bars, BARS_SCHEMA)
    out = D.sequences(df, ["open_px", "close_px"], 10, news=["volume"], target="close_px").toPandas()
    assert len(out) == 15 and set(out["ticker"]) == {"A"}
    first = out.sort_values("trade_date").iloc[0]
    a = bars[bars.ticker == "A"].reset_index(drop=True)
    assert first["y"] == a["close_px"][10] and first["trade_date"] == a["trade_date"][10]
    assert [list(s) for s in first["seq"]] == a.loc[:9, ["open_px", "close_px"]].values.tolist()
    assert list(first["tech"]) == a.loc[9, ["open_px", "close_px"]].tolist()
    assert list(first["news_vec"]) == [float(a["volume"][9])]


@pytest.mark.parametrize("kind", ["llm", "finbert"])
def test_sentiment_features(spark, kind):
    rows = [("A", DAY0 + dt.timedelta(days=i), [0.5, None, -0.5][i % 3], i % 4) for i in range(30)]
    df = spark.createDataFrame(rows, f"ticker string, trade_date date, {kind}_score double, news_count long")
    out = Z.sentiment_features(df, kind).toPandas().sort_values("trade_date")
    assert not out.isna().any().any()
    lead = "llm_" if kind == "llm" else ""
    assert {f"{kind}_ewma_5", f"{lead}sentiment_impact", f"{lead}sentiment_delta"} <= set(out.columns)
    assert ("news_volume_spike" in out.columns) == (kind == "finbert")
