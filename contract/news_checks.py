"""News path: cleaning, merging, de-duplication, gaps, roll-up, as-of mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.adapters import (
    BARS,
    CLEAN,
    ENGLISH,
    NEWS,
    SCORE_COLUMNS,
    SCORED,
    TALKS,
    bars,
    news,
    r,
    rounded,
    scored,
    table,
    talks,
    tidy_sql,
)
from contract.registry import check, sql
from tidewire.functions import text as X
from tidewire.operators import asof as J
from tidewire.operators import news as N
from tidewire.operators.near_titles import drop_near_titles
from tidewire.plans.tables import news_to_daily
from tidewire.session import materialise

NEWS_COLUMNS = "news_id, pub_time, ticker, title, summary, sentiment_score"


def clean(spark, sf_dir):
    return N.clean_news(news(spark, sf_dir))


def rolled_up(spark, sf_dir):
    return J.group_news_by_date(scored(clean(spark, sf_dir)))


def daily(spark, sf_dir):
    """The roll-up as a stored table: later steps read it more than once."""
    return materialise(rolled_up(spark, sf_dir), "daily")


_MEANS = ", ".join(f"avg({c}) as {c}" for c in SCORE_COLUMNS)
_ROUNDED_SCORES = ", ".join(r(c, c) for c in SCORE_COLUMNS)

DAILY = f"""daily as (
  select cast(pub_time as date) as news_date, ticker, {_MEANS}, count(*) as news_count
  from scored group by all)"""
MAPPED = """mapped as (
  select n.*, m.trade_date as market_date
  from daily n asof join (select ticker, trade_date from bars) m
    on n.ticker = m.ticker and n.news_date <= m.trade_date)"""
AGG = f"""agg as (
  select market_date, ticker, {_MEANS}, cast(sum(news_count) as bigint) as news_count
  from mapped group by all)"""


# --- text expressions ---


@check("x8_whitespace", sql(
    f"select news_id, {tidy_sql('title')} as t_all, "
    "trim(regexp_replace(title, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) as title_blanks from news", NEWS))
def _(spark, sf_dir):
    return news(spark, sf_dir).select(
        "news_id",
        X.tidy(F.col("title")).alias("t_all"),
        F.trim(X.collapse_blanks(F.col("title"))).alias("title_blanks"),
    )


@check("x9_quotes", sql(
    "select news_id, translate(title, '’“”', '''\"\"') as title from news", NEWS))
def _(spark, sf_dir):
    return news(spark, sf_dir).select("news_id", X.straighten_quotes(F.col("title")).alias("title"))


@check("x10_trim_lower", sql("select news_id, lower(trim(title)) as title from news", NEWS))
def _(spark, sf_dir):
    return news(spark, sf_dir).select("news_id", X.trimmed_lower(F.col("title")).alias("title"))


@check("x11_english_filter", sql("select news_id, title, summary from english", NEWS, ENGLISH))
def _(spark, sf_dir):
    return N.english_news(news(spark, sf_dir)).select("news_id", "title", "summary")


@check("x12_news_text", sql("select news_id, news_text from clean", NEWS, CLEAN))
def _(spark, sf_dir):
    return clean(spark, sf_dir).select("news_id", "news_text")


@check("x13_classifier_text", sql(
    """select news_id, case when coalesce(summary, '') <> '' then coalesce(title, '') || '. ' || summary
       else coalesce(title, '') end as body from news""", NEWS))
def _(spark, sf_dir):
    return news(spark, sf_dir).select(
        "news_id", X.classifier_text(F.col("title"), F.col("summary")).alias("body")
    )


@check("x14_time_formats", sql(
    """select news_id, pub_time as from_compact, pub_time as from_iso, pub_time as from_dashes,
       cast(null as timestamp) as from_bad, strftime(pub_time, '%Y-%m-%d %H:%M:%S') as formatted
       from news""", NEWS))
def _(spark, sf_dir):
    t = F.col("pub_time")
    return news(spark, sf_dir).select(
        "news_id",
        X.parse_time(F.date_format(t, "yyyyMMdd'T'HHmmss"), "yyyyMMdd'T'HHmmss").alias("from_compact"),
        X.parse_time(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("from_iso"),
        X.parse_time(X.format_time(t)).alias("from_dashes"),
        X.parse_time(F.concat(F.lit("on "), X.format_time(t))).alias("from_bad"),
        X.format_time(t).alias("formatted"),
    )


@check("x15_calendar_date", sql("select news_id, cast(pub_time as date) as pub_date from news", NEWS))
def _(spark, sf_dir):
    return news(spark, sf_dir).select("news_id", X.calendar_date(F.col("pub_time")).alias("pub_date"))


PROMPT = "Rate the news below for %s. Answer as one JSON object.\n---\n%s\n---"


@check("x17_prompt_text", sql(
    """select news_id, printf('Rate the news below for %s. Answer as one JSON object.' || chr(10)
       || '---' || chr(10) || '%s' || chr(10) || '---', ticker, news_text) as prompt from clean""",
    NEWS, CLEAN))
def _(spark, sf_dir):
    return clean(spark, sf_dir).select(
        "news_id", X.prompt_text(PROMPT, F.col("ticker"), F.col("news_text")).alias("prompt")
    )


# --- filters and projections ---


@check("p1_chop_by_period", sql(
    """select news_id, pub_time from news where pub_time >= timestamp '1996-03-01'
       and pub_time < timestamp '1998-07-01'""", NEWS))
def _(spark, sf_dir):
    return N.between_days(news(spark, sf_dir), "1996-03-01", "1998-06-30").select("news_id", "pub_time")


@check("p2_date_slice", sql(
    "select * from bars where trade_date between date '1995-05-01' and date '1997-04-30'", BARS))
def _(spark, sf_dir):
    return N.date_slice(bars(spark, sf_dir), "1995-05-01", "1997-04-30")


@check("p3_add_column", sql(
    "select news_id, 'vendor-a' as source_name, 'X' as ticker, title from news", NEWS))
def _(spark, sf_dir):
    added = N.add_column(news(spark, sf_dir).select("news_id", "ticker", "title"), "source_name", "vendor-a")
    return N.add_column(added, "ticker", "X")


@check("p4_drop_columns", sql(
    "select news_id, pub_time, ticker, title, summary from news", NEWS))
def _(spark, sf_dir):
    return N.drop_columns(news(spark, sf_dir), "sentiment_score")


@check("p7_fill_zero", sql(
    "select news_id, coalesce(sentiment_score, 0.0) as sentiment_score from news", NEWS))
def _(spark, sf_dir):
    from tidewire.operators.features import fill_zero

    return fill_zero(news(spark, sf_dir).select("news_id", "sentiment_score"), ["sentiment_score"])


@check("p9_pending_rows", sql(
    """select news_id, ticker from news n where not exists (
         select 1 from labels l where l.doc_id = n.news_id and l.quality = 1)""", NEWS))
def _(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("news_id"), F.when(F.col("quality") == 1, "positive").alias("llm_label")
    )
    return N.pending(news(spark, sf_dir), done, ["news_id"], "llm_label").select("news_id", "ticker")


@check("p10_limit", sql("select news_id, title from news order by pub_time, news_id limit 10", NEWS))
def _(spark, sf_dir):
    return N.first_rows(news(spark, sf_dir), 10, ["pub_time", "news_id"]).select("news_id", "title")


@check("p11_distinct", sql("select distinct ticker, trade_date from bars", BARS))
def _(spark, sf_dir):
    return N.distinct_values(bars(spark, sf_dir), "ticker", "trade_date")


@check("p12_one_ticker", sql("select * from bars where ticker = '2-HIGH'", BARS))
def _(spark, sf_dir):
    return N.one_ticker(bars(spark, sf_dir), "2-HIGH")


# --- dedupe, union, sort ---


def _files(spark, sf_dir):
    first = news(spark, sf_dir)
    again = first.withColumn(
        "title", F.when(F.col("sentiment_score").isNull(), F.concat(F.lit("Update: "), "title")).otherwise(
            F.col("title")
        ),
    ).withColumn("sentiment_score", F.lit(9.0))
    return [first, talks(spark, sf_dir), again]


_FILES = """files as (
  select news_id, pub_time, ticker, title, summary, sentiment_score, 0 as file_rank from news
  union all
  select news_id, pub_time, ticker, title, summary, cast(null as double), 1 from talks
  union all
  select news_id, pub_time, ticker, case when sentiment_score is null then 'Update: ' || title else title end,
    summary, 9.0, 2 from news)"""


@check("u1_merge_news", sql(
    f"""select {NEWS_COLUMNS} from files qualify row_number() over (
        partition by pub_time, ticker, title order by file_rank, news_id) = 1""",
    NEWS, TALKS, _FILES))
def _(spark, sf_dir):
    return N.merge_news(_files(spark, sf_dir)).select(*NEWS_COLUMNS.split(", "))


@check("u2_merge_market", sql(
    "select * from bars where ticker <> '5-LOW' union all select * from bars", BARS))
def _(spark, sf_dir):
    whole = bars(spark, sf_dir)
    return N.merge_market([whole.filter("ticker <> '5-LOW'"), whole]).orderBy("ticker", "trade_date")


@check("u3_dedupe_key", sql(
    f"""select {NEWS_COLUMNS} from (select * from news union all select * from news)
        qualify row_number() over (partition by pub_time, ticker, title order by news_id) = 1""", NEWS))
def _(spark, sf_dir):
    whole = news(spark, sf_dir)
    return N.keep_first(whole.unionByName(whole), N.NEWS_KEY, ["news_id"])


@check("u4_dedupe_day_title", sql(
    f"""select {NEWS_COLUMNS} from news qualify row_number() over (
        partition by ticker, cast(pub_time as date), lower(title) order by pub_time, news_id) = 1""", NEWS))
def _(spark, sf_dir):
    return N.dedupe_by_day(news(spark, sf_dir))


@check("u4_clean_news", sql(
    "select news_id, pub_time, ticker, title, summary, news_text from clean", NEWS, CLEAN))
def _(spark, sf_dir):
    return clean(spark, sf_dir)


@check("u5_date_difference", sql(
    """select d.trade_date from (select distinct trade_date from bars) d
       where d.trade_date not in (select cast(pub_time as date) from news)""", BARS, NEWS))
def _(spark, sf_dir):
    return N.date_difference(bars(spark, sf_dir), news(spark, sf_dir), "trade_date", "pub_time")


@check("u6_sort", sql("select * from bars order by trade_date, ticker", BARS))
def _(spark, sf_dir):
    return N.in_order(bars(spark, sf_dir), "trade_date", "ticker")


# --- joins ---


@check("j1_asof_forward", sql(
    """select n.news_id, n.ticker, n.news_date, m.trade_date as market_date
       from (select news_id, ticker, cast(pub_time as date) as news_date from news) n
       asof left join (select ticker, trade_date from bars) m
         on n.ticker = m.ticker and n.news_date <= m.trade_date""", NEWS, BARS))
def _(spark, sf_dir):
    left = news(spark, sf_dir).select("news_id", "ticker", F.to_date("pub_time").alias("news_date"))
    return J.asof_forward(left, bars(spark, sf_dir), "news_date", "trade_date")


@check("j2_left_join", sql(
    """select b.ticker, b.trade_date, b.close_px, coalesce(d.news_count, 0) as news_count
       from bars b left join daily d on b.ticker = d.ticker and b.trade_date = d.news_date""",
    BARS, NEWS, SCORED, DAILY))
def _(spark, sf_dir):
    counts = daily(spark, sf_dir).select("ticker", F.col("news_date").alias("market_date"), "news_count")
    joined = J.join_market(bars(spark, sf_dir), counts)
    return joined.select("ticker", "trade_date", "close_px", "news_count")


@check("j3_missing_dates", sql(
    """select cast(d as date) as day from range(timestamp '1995-01-01', timestamp '2002-01-01',
         interval 1 day) t(d) where cast(d as date) not in (select cast(pub_time as date) from news)""",
    NEWS))
def _(spark, sf_dir):
    return N.missing_days(news(spark, sf_dir), "pub_time", "1995-01-01", "2001-12-31")


@check("j3_missing_dates_by_ticker", sql(
    """select t.ticker, cast(d as date) as day
       from range(timestamp '1995-01-01', timestamp '2002-01-01', interval 1 day) r(d)
       cross join (select distinct ticker from news union select 'NOT STORED' as ticker) t
       where not exists (select 1 from news n
         where n.ticker = t.ticker and cast(n.pub_time as date) = cast(d as date))""", NEWS))
def _(spark, sf_dir):
    seen = news(spark, sf_dir)
    wanted = seen.select("ticker").unionByName(spark.createDataFrame([("NOT STORED",)], "ticker string"))
    return N.missing_days(seen, "pub_time", "1995-01-01", "2001-12-31", ["ticker"], groups=wanted)


@check("j4_side_by_side", sql(
    """select n.news_id, n.ticker, e.news_text from news n join clean e using (news_id)""", NEWS, CLEAN))
def _(spark, sf_dir):
    left = news(spark, sf_dir).select("news_id", "ticker")
    return N.by_key(left, clean(spark, sf_dir).select("news_id", "news_text"), ["news_id"])


@check("j6_semi_join", sql(
    "select news_id, title from tidied where title in (select title from clean)", NEWS, CLEAN))
def _(spark, sf_dir):
    whole = news(spark, sf_dir).withColumn("title", X.tidy(F.col("title")))
    kept = N.with_title_in(whole, clean(spark, sf_dir), F.col("title"))
    return kept.select("news_id", "title")


@check("j7_near_titles", sql(
    """select news_id, title from untitled e where not exists (
         select 1 from untitled b where b.ticker = e.ticker
           and cast(b.pub_time as date) = cast(e.pub_time as date)
           and (b.pub_time, b.news_id) < (e.pub_time, e.news_id)
           and abs(length(b.title) - length(e.title)) * 10 <= greatest(length(b.title), length(e.title))
           and levenshtein(lower(b.title), lower(e.title)) * 10
             <= greatest(length(b.title), length(e.title)))""", NEWS, ENGLISH,
    "untitled as (select * replace (case when news_id % 7 <> 0 then title end as title) from english)"))
def _(spark, sf_dir):
    english = N.english_news(news(spark, sf_dir))
    untitled = english.withColumn("title", F.when(F.col("news_id") % 7 != 0, F.col("title")))
    return drop_near_titles(untitled).select("news_id", "title")


@check("j7_greedy_titles", sql(
    """select news_id, title from untitled where title is null
       union all select i.news_id, i.title from scan s, unnest(s.kept) as u(place)
         join in_order i on i.ticker = s.ticker and i.day = s.day and i.place = u.place
       where s.place = s.rows""", NEWS, ENGLISH,
    "untitled as (select * replace (case when news_id % 7 <> 0 then title end as title) from english)",
    """in_order as (
         select *, cast(pub_time as date) as day, lower(title) as low, count(*) over (partition by ticker, cast(pub_time as date)) as rows,
           row_number() over (partition by ticker, cast(pub_time as date) order by pub_time, news_id) as place
         from untitled where title is not null)""",
    """scan as (
         select ticker, day, place, rows, [place] as kept, [low] as lows from in_order where place = 1
         union all
         select i.ticker, i.day, i.place, i.rows,
           case when len(list_filter(s.lows, lambda k: levenshtein(k, i.low) * 10 <= greatest(length(k), length(i.low)))) = 0
             then list_append(s.kept, i.place) else s.kept end,
           case when len(list_filter(s.lows, lambda k: levenshtein(k, i.low) * 10 <= greatest(length(k), length(i.low)))) = 0
             then list_append(s.lows, i.low) else s.lows end
         from scan s join in_order i on i.ticker = s.ticker and i.day = s.day and i.place = s.place + 1)""", recursive=True))
def _(spark, sf_dir):
    """Only titles that stay count, in order of time."""
    english = N.english_news(news(spark, sf_dir))
    untitled = english.withColumn("title", F.when(F.col("news_id") % 7 != 0, F.col("title")))
    return drop_near_titles(untitled, greedy=True).select("news_id", "title")


# --- roll-up and mapping ---


@check("a1_group_by_date", sql(
    f"select news_date, ticker, {_ROUNDED_SCORES}, news_count from daily", NEWS, SCORED, DAILY))
def _(spark, sf_dir):
    return rounded(rolled_up(spark, sf_dir))


_MERGED = """news as (
  select news_id, pub_time, ticker, title, summary, sentiment_score from (
    select *, 0 as file_rank from first_file union all
    select news_id, pub_time, ticker, title, summary, null, 1 from talks)
  qualify row_number() over (partition by pub_time, ticker, title order by file_rank, news_id) = 1)"""


@check("e1_news_to_daily", sql(
    f"select news_date, ticker, {_ROUNDED_SCORES}, news_count from daily",
    NEWS.replace("news as (", "first_file as ("), TALKS, _MERGED, SCORED, DAILY))
def _(spark, sf_dir):
    return rounded(news_to_daily([news(spark, sf_dir), talks(spark, sf_dir)], scored))


@check("a2_aggregate_mapped", sql(
    f"select market_date, ticker, {_ROUNDED_SCORES}, news_count from agg",
    BARS, NEWS, SCORED, DAILY, MAPPED, AGG))
def _(spark, sf_dir):
    mapped = J.map_to_market_days(daily(spark, sf_dir), bars(spark, sf_dir))
    return rounded(J.aggregate_mapped(mapped, "llm_"))


A3_SQL = sql(
    f"""select b.*, {_ROUNDED_SCORES}, coalesce(news_count, 0) as news_count
       from bars b left join agg a on b.ticker = a.ticker and b.trade_date = a.market_date""".replace(
        "select b.*",
        "select b.ticker, b.trade_date, round(open_px,6)+0.0 as open_px, round(high_px,6)+0.0 as high_px, "
        "round(low_px,6)+0.0 as low_px, round(close_px,6)+0.0 as close_px, volume",
    ),
    BARS, NEWS, SCORED, DAILY, MAPPED, AGG,
)


@check("a3_market_and_sentiment", A3_SQL)
def _(spark, sf_dir):
    return rounded(
        J.merge_market_and_sentiment(bars(spark, sf_dir), daily(spark, sf_dir), "llm_")
    )
