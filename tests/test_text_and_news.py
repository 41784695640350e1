import datetime as dt
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.operators import news as N
from tidewire.operators.near_titles import drop_near_titles
from tidewire.schemas import MissingColumns, require_columns

T0 = dt.datetime(2024, 5, 1, 10, 0)
SCHEMA = "news_id long, pub_time timestamp_ntz, ticker string, title string, summary string, sentiment_score double"


def articles(spark, *rows):
    """Rows of (id, minutes after T0, ticker, title, summary)."""
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(minutes=m), t, title, summary, 0.5) for i, m, t, title, summary in rows],
        SCHEMA,
    )


TEXTS = [
    "plain", "  two  blanks ", "tab\tand\nline\r\nend", "no break   em", "sep\x1cone\x1ftwo",
    "it’s “fine”", "‘open", "", "   ", "　wide　", "naïve", "a\x0bb\x0cc", "next\x85line",
    "price > 3", "50% & more #1 @x", "back`tick", "tilde~", "em — dash – en", "[a] {b} (c) /\\ _", "🚀", "\x07bell",
]


def python_tidy(text):
    text = re.sub(r"\s+", " ", text)
    return text.replace("’", "'").replace("“", '"').replace("”", '"').strip()


def python_english(text):
    kept = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,!?;:'\"’“”()[]{}-–—_/\\$%&+*=#@")
    return bool(text) and all(c in kept or c.isspace() for c in text)


def test_tidy_and_filter_equal_python(spark):
    rng = random.Random(1)
    mixed = ["".join(rng.choice(TEXTS) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in TEXTS + mixed], "t string")
    out = df.select(
        "t", X.tidy(F.col("t")).alias("tidy"), X.is_plain_english(F.col("t")).alias("raw_ok"),
        X.is_plain_english(X.tidy(F.col("t"))).alias("tidy_ok"),
    ).collect()
    for row in out:
        assert row.tidy == python_tidy(row.t)
        assert row.raw_ok == row.tidy_ok == python_english(python_tidy(row.t)), repr(row.t)


def test_english_filter_on_articles(spark):
    df = articles(
        spark,
        (1, 0, "A", "ok", None), (2, 0, "A", None, "s"), (3, 0, "A", "ok", ""), (4, 0, "A", "ok", "über"),
        (5, 0, "A", "‘quote", "s"), (6, 0, "A", "x", "y z"),
    )
    assert sorted(r.news_id for r in N.english_news(df).collect()) == [1, 6]


def test_news_text_dots(spark):
    df = spark.createDataFrame([("t", None), ("t", "s..."), ("t..", "s"), ("t", "...")], "t string, s string")
    out = [r[0] for r in df.select(X.news_text(F.col("t"), F.col("s"))).collect()]
    assert out == ["t. ", "t. s", "t... s", "t. "]
    assert df.select(X.news_text(F.col("t"), F.col("s"), clean=True)).first()[0] == "t"


def test_clean_news_keeps_other_tickers_and_days(spark):
    day = 24 * 60
    df = articles(
        spark,
        (2, 5, "A", "Same Title", "b"), (1, 5, "A", "same title", "a"), (3, 0, "B", "same title", "c"),
        (4, 14 * 60 - 1, "A", "SAME TITLE", "d"), (5, 14 * 60, "A", "same title", "midnight"), (6, day * 3, "A", "same title", None),
    )
    kept = {r.news_id: r for r in N.clean_news(df).collect()}
    assert sorted(kept) == [1, 3, 5, 6]
    assert "sentiment_score" not in N.clean_news(df).columns
    again = N.dedupe_by_day(N.dedupe_by_day(df))
    assert again.count() == N.dedupe_by_day(df).count()


def test_merge_prefers_first_file_and_fills_columns(spark):
    first = articles(spark, (9, 0, "A", "t", "first"))
    second = articles(spark, (1, 0, "A", "t", "second"), (2, 0, "A", None, "x"), (3, 0, "A", None, "y")).drop("sentiment_score")
    out = {(r.title, r.summary): r.sentiment_score for r in N.merge_news([first, second]).collect()}
    assert out == {("t", "first"): 0.5, (None, "x"): None}


def test_period_and_position(spark):
    df = articles(spark, (1, -600, "A", "t", None), (2, -601, "A", "t", None), (3, 14 * 60 - 1, "A", "t", None), (4, 14 * 60, "A", "t", None))
    assert sorted(r.news_id for r in N.between_days(df, "2024-05-01", "2024-05-01").collect()) == [1, 3]
    assert N.add_column(df, "source", "v").columns[1] == "source"
    assert N.add_column(df, "title", "v").columns == df.columns


def test_missing_days_and_pending(spark):
    df = articles(spark, (1, 0, "A", "t", None), (2, 2 * 24 * 60, "A", "t", None), (3, 0, "B", "t", None))
    days = [str(r.day) for r in N.missing_days(df, "pub_time", "2024-04-30", "2024-05-04").orderBy("day").collect()]
    assert days == ["2024-04-30", "2024-05-02", "2024-05-04"]
    assert N.missing_days(df, "pub_time", "2024-05-01", "2024-05-03", ["ticker"]).count() == 3
    done = spark.createDataFrame([(1, "neutral"), (2, None)], "news_id long, llm_label string")
    assert sorted(r.news_id for r in N.pending(df, done, ["news_id"], "llm_label").collect()) == [2, 3]
    assert N.with_results(df, done, ["news_id"]).count() == 3


def test_required_columns(spark):
    with pytest.raises(MissingColumns, match=r"\['b', 'c'\]"):
        require_columns(spark.createDataFrame([(1,)], "a int"), ["c", "a", "b"])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_by_hand(rows):
    kept = []
    for i, m, t, title, _ in rows:
        low = title.lower()
        day = (T0 + dt.timedelta(minutes=m)).date()
        hit = any(
            t2 == t and (T0 + dt.timedelta(minutes=m2)).date() == day and (m2, i2) < (m, i)
            and distance(low, title2.lower()) * 10 <= max(len(low), len(title2))
            for i2, m2, t2, title2, _ in rows
        )
        if not hit:
            kept.append(i)
    return sorted(kept)


def test_near_titles_equal_brute_force(spark):
    rng = random.Random(7)
    letters = "abcde "
    bases = ["".join(rng.choice(letters) for _ in range(n)) for n in (5, 9, 10, 20, 31, 60, 200)]
    rows = []
    for i in range(150):
        title = list(rng.choice(bases))
        for _ in range(rng.randrange(0, max(2, len(title) // 8))):
            k = rng.randrange(len(title))
            kind = rng.randrange(3)
            if kind == 0:
                title[k] = rng.choice(letters)
            elif kind == 1:
                title.insert(k, rng.choice(letters))
            elif len(title) > 1:
                del title[k]
        rows.append((i, rng.randrange(300), rng.choice("AAAB"), "".join(title), None))
    rows += [(1000 + i, 1, "A", "aaaaaaaaaaaaaaaaaaaa" + "a" * (i % 4), None) for i in range(12)]
    got = sorted(r.news_id for r in drop_near_titles(articles(spark, *rows)).collect())
    assert got == near_by_hand(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from("AB"), st.sampled_from("xyz")), min_size=1, max_size=20))
def test_keep_first_is_a_dedupe(spark, picks):
    rows = [(i, m, t, title, f"s{i}") for i, (m, t, title) in enumerate(picks)]
    out = N.keep_first(articles(spark, *rows), N.NEWS_KEY, ["news_id"]).collect()
    want = {}
    for i, m, t, title, _ in rows:
        want.setdefault((m, t, title), i)
    assert sorted(r.news_id for r in out) == sorted(want.values())


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "news")
    articles(spark, (1, 0, "A", "t", None)).write.parquet(path)
    out = N.between_days(spark.read.parquet(path), "2024-05-01", "2024-05-02").select("news_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(pub_time," in plan and "LessThan(pub_time," in plan
    assert "ReadSchema: struct<news_id:bigint,pub_time:timestamp_ntz>" in plan
