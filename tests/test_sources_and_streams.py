import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators.news import NEWS_KEY
from tidewire.plans import trees as M
from tidewire.schemas import NEWS_RAW
from tidewire.sources import files as S
from tidewire.sources import store as U
from tidewire.sources import vendors as V
from tidewire.streaming import ingest as T

T0 = dt.datetime(2024, 5, 1, 10, 0)


def write_lines(path, objects):
    path.write_text("\n".join(json.dumps(o) for o in objects))
    return str(path)


def one_by_title(df):
    return {r.title: (r.pub_time, r.summary, r.sentiment_score) for r in df.collect()}


def test_csv_quotes_lines_and_missing(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    head = "pub_time,ticker,title,summary,sentiment_score\n"
    a.write_text(head + '2024-05-01 10:00:00,A,"He said ""no"", twice","two\nlines",0.5\n', encoding="utf-8")
    b.write_text(head + '2024-05-02 00:00:00,B,“x”,,nan\n2024-05-02 00:00:01,B,y,"",\n', encoding="utf-8")
    rows = one_by_title(S.read_csv(spark, [str(a), str(b)], multi_line=True))
    assert rows == {
        'He said "no", twice': (T0, "two\nlines", 0.5),
        "“x”": (dt.datetime(2024, 5, 2), None, None),
        "y": (dt.datetime(2024, 5, 2, 0, 0, 1), None, None),
    }


def test_csv_append_and_input_guard(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(T0, "A", "t", None, 1.0)], NEWS_RAW)
    S.write_csv(df, path)
    S.write_csv(df, path, "append")
    back = S.read_csv(spark, path)
    assert back.count() == 2
    with pytest.raises(ValueError, match="input of the same plan"):
        S.write_csv(back, path)
    S.write_table(df, str(tmp_path / "table"))
    with pytest.raises(ValueError):
        S.write_table(spark.read.parquet(str(tmp_path / "table")), str(tmp_path / "table"))


def test_table_modes(spark, tmp_path):
    with pytest.raises(ValueError, match="mode is one of"):
        S.save_to_db(spark.range(1), "jdbc:none", "t", mode="upsert")
    assert S.TABLE_MODES == {"append": "append", "replace": "overwrite", "fail": "error"}


def test_database_reads_are_dealt_over_tasks():
    plain = S.read_options("jdbc:x", "bars", driver="d")
    assert plain == {"url": "jdbc:x", "dbtable": "bars", "driver": "d"}
    dealt = S.read_options("jdbc:x", "bars", "trade_date", dt.date(2020, 1, 1), dt.date(2024, 1, 1), 16, fetchsize="1000")
    assert dealt == {
        "url": "jdbc:x", "dbtable": "bars", "fetchsize": "1000", "partitionColumn": "trade_date",
        "lowerBound": "2020-01-01", "upperBound": "2024-01-01", "numPartitions": "16",
    }
    with pytest.raises(ValueError, match="needs partition_column"):
        S.read_options("jdbc:x", "bars", "trade_date", 1, 2)
    for lower, upper, parts in ((2, 1, 4), (1, 2, 0)):
        with pytest.raises(ValueError, match="bounds"):
            S.read_options("jdbc:x", "bars", "volume", lower, upper, parts)


def test_ticker_filter_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0), ("A", dt.date(2024, 1, 1), 2.0), ("B", dt.date(2024, 1, 1), 3.0)], "ticker string, trade_date date, x double")
    S.write_table(df, str(tmp_path / "m"))
    out = S.retrieve_by_ticker(spark.read.parquet(str(tmp_path / "m")), "A")
    assert [r.x for r in out.collect()] == [2.0, 1.0]
    assert "PartitionFilters: [isnotnull(ticker" in out._jdf.queryExecution().executedPlan().toString()


def test_vendor_payloads(spark, tmp_path):
    alpha = write_lines(tmp_path / "alpha.json", [{"items": "1", "feed": [{"title": "a", "time_published": "20230501T101112", "summary": "s", "overall_sentiment_score": 0.25}, {"title": "b", "time_published": "oops", "summary": None}]}])
    assert one_by_title(V.alpha_vantage(V.read_payloads(spark, "alpha_vantage", alpha), "X")) == {"a": (dt.datetime(2023, 5, 1, 10, 11, 12), "s", 0.25), "b": (None, None, None)}
    eodhd = write_lines(tmp_path / "eodhd.json", [[{"title": "a", "date": "2024-07-28T12:00:00+02:00", "content": "c", "sentiment": {"polarity": -0.5}}, {"title": "b", "date": "2024-07-28T12:00:00+00:00", "content": "c", "sentiment": None}]])
    assert one_by_title(V.eodhd(V.read_payloads(spark, "eodhd", eodhd), "X")) == {"a": (dt.datetime(2024, 7, 28, 12), "c", -0.5), "b": (dt.datetime(2024, 7, 28, 12), "c", None)}
    finnhub = write_lines(tmp_path / "finnhub.json", [{"category": "c", "datetime": 1700000000, "headline": "a", "summary": ""}])
    assert one_by_title(V.finnhub(V.read_payloads(spark, "finnhub", finnhub), "X")) == {"a": (dt.datetime(2023, 11, 14, 22, 13, 20), "", None)}
    aux = write_lines(tmp_path / "aux.json", [{"meta": {"found": 2, "returned": 2}, "data": [{"title": "a", "published_at": "2023-11-12T00:40:55.000000Z", "description": "d", "entities": [{"sentiment_score": 0.9}, {"sentiment_score": 0.1}]}, {"title": "b", "published_at": "2023-11-12T00:40:55.000000Z", "description": "d", "entities": []}]}])
    assert one_by_title(V.marketaux(V.read_payloads(spark, "marketaux", aux), "X")) == {"a": (dt.datetime(2023, 11, 12, 0, 40, 55), "d", 0.9), "b": (dt.datetime(2023, 11, 12, 0, 40, 55), "d", None)}
    massive = write_lines(
        tmp_path / "massive.json",
        [
            {"title": "a", "description": "d", "published_utc": "2026-01-01T00:00:00Z", "insights": [{"ticker": "Y", "sentiment": "bearish"}, {"ticker": "X", "sentiment": "Neutral/Positive"}, {"ticker": "X", "sentiment": "bearish"}]},
            {"title": "b", "description": "d", "published_utc": "2026-01-01T00:00:00Z", "insights": None},
            {"title": "c", "description": "d", "published_utc": "2026-01-01T00:00:00Z", "insights": [{"ticker": "X", "sentiment": "Odd"}]},
            {"title": "e", "description": "d", "published_utc": "2026-01-01T00:00:00Z", "insights": [{"ticker": "Y", "sentiment": "bullish"}]},
        ],
    )
    payload = V.read_payloads(spark, "massive", massive)
    assert {k: v[2] for k, v in one_by_title(V.massive(payload, "X")).items()} == {"a": 0.3, "b": None, "c": None, "e": None}
    assert [tuple(r) for r in V.massive_rejects(payload, "X").collect()] == [("odd", 1)]
    yahoo = write_lines(tmp_path / "yahoo.json", [{"content": {"title": "a", "pubDate": "2024-01-01T01:02:03Z", "summary": "s"}}])
    assert one_by_title(V.yahoo(V.read_payloads(spark, "yahoo", yahoo), "X")) == {"a": (dt.datetime(2024, 1, 1, 1, 2, 3), "s", None)}


def news(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), t, title, score) for i, m, t, title, score in rows], "news_id long, pub_time timestamp_ntz, ticker string, title string, sentiment_score double")


def test_upsert_and_file_store_agree(spark, tmp_path):
    old = news(spark, [(1, 0, "A", "x", 0.1), (2, 0, "A", None, 0.2)])
    new = news(spark, [(5, 0, "A", "x", 0.9), (6, 0, "A", None, 0.9), (7, 1, "A", "x", 0.3), (8, 1, "A", "x", 0.4), (9, 60 * 24 * 40, "B", "y", 0.5)])
    want = {(r.news_id, r.sentiment_score) for r in U.upsert(old, new).collect()}
    assert want == {(1, 0.1), (2, 0.2), (7, 0.3), (9, 0.5)}
    path = str(tmp_path / "store")
    for part in (old, new, new):
        U.append_to_store(part, path)
    assert {(r.news_id, r.sentiment_score) for r in spark.read.parquet(path).collect()} == want


def walk_by_hand(days_with_news, start, end, limit=7):
    todo, empty, day = [], 0, end
    while day >= start:
        if empty > limit:
            break
        if day in days_with_news:
            empty = 0
        else:
            empty += 1
            todo.append(day)
        day -= dt.timedelta(days=1)
    return sorted(todo)


def test_backfill_equals_the_walk(spark):
    rng = random.Random(9)
    start, end = dt.date(2024, 1, 1), dt.date(2024, 6, 30)
    rows, want = [], {}
    for ticker, share in (("A", 0.3), ("B", 0.15), ("C", 0.02)):
        days = {start + dt.timedelta(days=i) for i in range(182) if rng.random() < share} | {end if ticker == "A" else start}
        rows += [(ticker, dt.datetime.combine(d, dt.time(5))) for d in days for _ in range(2)]
        want[ticker] = walk_by_hand(days, start, end)
    stored = spark.createDataFrame(rows, "ticker string, pub_time timestamp_ntz")
    got = {}
    for r in U.backfill_days(stored, str(start), str(end)).collect():
        got.setdefault(r.ticker, []).append(r.day)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_stream_upsert_restarts_and_equals_batch(spark, tmp_path):
    land, store, check = (str(tmp_path / n) for n in ("land", "store", "check"))
    old = news(spark, [(1, 0, "A", "x", 0.1)])
    U.append_to_store(old, store)
    batches = [
        news(spark, [(2, 0, "A", "x", 0.9), (3, 5, "A", "y", 0.3)]),
        news(spark, [(4, 5, "A", "y", 0.8), (5, 9, "B", "z", 0.5)]),
    ]
    for part in batches:
        part.coalesce(1).write.mode("append").parquet(land)
        T.stream_upsert(T.landed(spark, land, old.schema), store, check).awaitTermination()
    batch = U.upsert(U.upsert(old, batches[0]), batches[1])
    key = [*NEWS_KEY, "sentiment_score"]
    assert sorted(map(tuple, spark.read.parquet(store).select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))


CALLS = []


def load_length():
    return lambda texts: [float(len(t)) for t in texts]


def test_stream_scores_only_new_rows(spark, tmp_path):
    land, store, check = (str(tmp_path / n) for n in ("land", "store", "check"))
    schema = "news_id long, title string"
    for i in range(2):
        spark.createDataFrame([(i, "x" * (i + 1))], schema).write.mode("append").parquet(land)
        stream = T.landed(spark, land, spark.createDataFrame([], schema).schema)
        T.stream_scores(stream, "title", load_length, "s", "double", store, check).awaitTermination()
    rows = spark.read.parquet(store).orderBy("news_id").collect()
    assert [(r.news_id, r.s, r.batch) for r in rows] == [(0, 1.0, 0), (1, 2.0, 1)]


def test_tree_presets_and_jobs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        a, b = rng.random(), rng.random()
        rows.append(("train" if i < 200 else "val" if i < 250 else "test", a, b, 2 * a - b + rng.gauss(0, 0.01)))
    df = spark.createDataFrame(rows, "split string, a double, b double, target_forward_return double")
    settings = M.preset("multi", trees=4, rate=0.5, row_sample=1.0, column_sample=1.0)
    assert M.PRESETS["multi"].trees == 1000 and settings.depth == 3
    model = M.fit_trees(df, ["a", "b"], settings)
    again = M.fit_trees(df, ["a", "b"], settings)
    importance = M.feature_importance(model, ["a"], news=["b"]).collect()
    assert sum(r.importance for r in importance) == pytest.approx(1.0) and importance[0].grp == "technical"
    with pytest.raises(ValueError, match="2 features but 1 names"):
        M.feature_importance(model, ["a"])
    curve = M.training_curve(model).toPandas()
    assert set(curve["part"]) == {"train", "val"} and curve["rmse"].notna().all()
    test = df.filter("split = 'test'")
    first, second = (M.predict(m, test, ["a", "b"]).orderBy("a").toPandas()["y_hat"] for m in (model, again))
    assert (first == second).all()
    hybrid = df.withColumn("x", F.array("a", "b"))
    assert M.predict(M.fit_trees(hybrid, "x", settings), hybrid, "x").filter("y_hat is null").count() == 0
