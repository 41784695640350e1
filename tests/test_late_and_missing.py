"""Late articles, rows with holes, many tickers, early stopping: nothing is lost on the way."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import indicators as I
from tidewire.operators.near_titles import drop_near_titles
from tidewire.operators.series import over_series, rolling
from tidewire.plans import tables, trees
from tidewire.session import discard_materialised, materialise, written_so_far
from tidewire.sources import files as S
from tidewire.sources import store as U
from tidewire.streaming import ingest as T

NEWS = "news_id long, pub_time timestamp_ntz, ticker string, title string, score double"


def article(i, day, score=1.0, title=None):
    return i, dt.datetime.combine(day, dt.time(12)) if day else None, "A", title or f"t{i}", score


def land(spark, rows, path):
    spark.createDataFrame(rows, NEWS).coalesce(1).write.mode("append").parquet(path)


def test_back_filled_articles_reach_the_store(spark, tmp_path):
    landing, store, check = (str(tmp_path / n) for n in ("landing", "store", "check"))
    days = [dt.date(2024, 6, 30), dt.date(2024, 6, 29), dt.date(2024, 3, 1), dt.date(2023, 9, 1), None]
    for i, day in enumerate(days):
        land(spark, [article(i, day)], landing)
        schema = spark.read.parquet(landing).schema
        T.stream_upsert(T.landed(spark, landing, schema), store, check).awaitTermination()
    assert spark.read.parquet(store).count() == len(days)


def test_late_articles_change_their_day(spark, tmp_path):
    landing, store, check = (str(tmp_path / n) for n in ("landing", "store", "check"))
    batches = [[article(i, dt.date(2024, 6, i), 1.0) for i in range(1, 8)], [article(9, dt.date(2024, 6, 2), 100.0)], [article(10, dt.date(2023, 1, 1), None)]]
    for batch in batches:
        land(spark, batch, landing)
        schema = spark.read.parquet(landing).schema
        T.stream_daily(T.landed(spark, landing, schema), {"score": F.col("score")}, store, check).awaitTermination()
    got = {r.news_date: (r.score, r.news_count) for r in T.read_daily(spark, store, ["score"]).collect()}
    assert len(got) == 8
    assert got[dt.date(2024, 6, 2)] == (50.5, 2) and got[dt.date(2024, 6, 7)] == (1.0, 1)
    assert got[dt.date(2023, 1, 1)] == (None, 1)


def test_store_takes_rows_without_a_time_once(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = spark.createDataFrame([article(1, None), article(2, dt.date(2024, 1, 1))], NEWS)
    for _ in range(3):
        U.append_to_store(batch, path)
    assert spark.read.parquet(path).count() == 2


def test_rows_without_a_title_stay(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, day, "A", None), (2, day, "A", None), (3, day, "A", "a title of some length"), (4, day, "A", "a title of some lengths")]
    frame = spark.createDataFrame(rows, "news_id long, pub_time timestamp_ntz, ticker string, title string")
    assert sorted(r.news_id for r in drop_near_titles(frame).collect()) == [1, 2, 3]


BARS = "ticker string, trade_date date, open_px double, high_px double, low_px double, close_px double, volume long"


def flat_bars(n, hole=None):
    start = dt.date(2020, 1, 1)
    return [("A", start + dt.timedelta(days=i), 10.0, 10.0, 10.0, None if i == hole else 10.0, 5) for i in range(n)]


def test_a_missing_price_changes_no_other_bar(spark):
    out = I.add_indicators(spark.createDataFrame(flat_bars(260, hole=120), BARS)).orderBy("trade_date").collect()
    assert len(out) == 260
    hole, rest = out[120], out[:120] + out[121:]
    names = [c for group in I.OUTPUTS.values() for c in group]
    assert all(hole[c] is None for c in names)
    for name in ("sma_50", "sma_200", "ema_20", "bbm_20_2"):
        assert {round(r[name], 9) for r in rest if r[name] is not None} == {10.0}
    assert [r.obv for r in rest] == [5.0] * 259
    assert sum(r.ema_20 is not None for r in rest) == 240


def test_rows_without_ticker_or_date_stay(spark):
    rows = [("A", dt.date(2024, 1, i), 1.0) for i in range(1, 6)] + [(None, dt.date(2024, 1, 1), 9.0), ("A", None, 9.0), (None, None, 9.0)]
    frame = spark.createDataFrame(rows, "ticker string, trade_date date, x double")
    out = over_series(frame, lambda w: {"mean": rolling(F.avg, F.col("x"), w, 2, 1)}, before=1).collect()
    assert len(out) == len(rows)
    assert all((r["mean"] is None) == (r.ticker is None or r.trade_date is None) for r in out)
    assert {r["mean"] for r in out if r.ticker and r.trade_date} == {1.0}


def test_twelve_hundred_tickers(spark):
    n = 1200
    bars = spark.range(n * 30).selectExpr(
        f"concat('T', id % {n}) as ticker", f"date_add(date'2024-01-01', cast(id div {n} as int)) as trade_date",
        "10.0 + id % 7 as open_px", "20.0 + id % 5 as high_px", "5.0D as low_px", "cast(10.0 + id % 11 as double) as close_px", "id + 1 as volume",
    ).selectExpr("ticker", "trade_date", "double(open_px) as open_px", "double(high_px) as high_px", "low_px", "close_px", "volume")
    scores = ", ".join(f"0.5D as {c}" for c in tables.SCORES["llm"])
    daily = spark.sql(f"select 'T1' as ticker, date'2024-01-05' as news_date, 1L as news_count, {scores}")
    small = tables.features.one_hot_vector(bars.select("ticker", "trade_date"), output="v")
    assert small.first().v.size == n
    made = tables.model_table(bars, daily)
    assert tables.TICKER_VECTOR in made.columns and not any(c.startswith("ticker_T") for c in made.columns)


@pytest.mark.parametrize("name", ["multi", "single"])
def test_trees_learn_on_targets_of_return_size(spark, name):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        x = rng.uniform(-1, 1)
        b = rng.uniform(-1, 1)
        rows.append((x, b, 0.02 * (x > 0) + 0.02 * b * x + 0.01 * b + rng.gauss(0, 0.002), "train" if i < 400 else "val" if i < 500 else "test"))
    frame = materialise(spark.createDataFrame(rows, "a double, b double, y_next double, split string"), "rows")
    settings = trees.preset(name, trees=12, rate=0.1, patience=3)
    model = trees.fit_trees(frame, ["a", "b"], settings, "y_next")
    kept = model.best
    assert kept > 1
    # Equal seeds give equal first trees.
    longer = trees.fit_trees(frame.filter("split = 'train'"), ["a", "b"], trees.preset(name, trees=kept + 3, rate=0.1, patience=3), "y_next")
    assert longer.trees[:kept] == model.trees[:kept]
    error = trees.predict(model, frame.filter("split = 'test'"), ["a", "b"], "y_next").selectExpr("avg(pow(y - y_hat, 2)) as model", "var_pop(y) as mean").first()
    assert error.model < 0.7 * error.mean


def test_overwriting_an_input_is_refused_by_whole_path(spark, tmp_path):
    data = spark.range(3).selectExpr("id", "'A' as ticker")
    for name in ("out", "not-out"):
        data.write.parquet(str(tmp_path / name))
    read = spark.read.parquet(str(tmp_path / "not-out"))
    S.write_table(read, str(tmp_path / "out"))
    for path in ("not-out", "not-out/below", ""):
        with pytest.raises(ValueError):
            S.write_table(read, str(tmp_path / path))


def test_materialised_copies_can_go(spark):
    mark = written_so_far()
    frame = materialise(spark.range(5), "copy")
    assert frame.count() == 5
    assert discard_materialised(spark, mark) == 1 and written_so_far() == mark
    with pytest.raises(Exception):
        frame.count()
