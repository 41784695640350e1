"""Vendor payloads to one news schema.

Payloads are landed files; each vendor has a declared schema and a function from payload rows
to (pub_time, ticker, title, summary, sentiment_score). ``ticker`` is a name or a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.expressions import finite, label_score
from tidewire.functions.text import parse_time

SCHEMAS = {
    "alpha_vantage": "items string, feed array<struct<title:string,time_published:string,"
    "summary:string,overall_sentiment_score:double,overall_sentiment_label:string>>",
    "eodhd": "title string, date string, content string, tags array<string>,"
    " sentiment struct<polarity:double,neg:double,neu:double,pos:double>",
    "finnhub": "category string, datetime bigint, headline string, summary string",
    "marketaux": "meta struct<found:bigint,returned:bigint>, data array<struct<title:string,"
    "published_at:string,description:string,relevance_score:double,"
    "entities:array<struct<match_score:double,sentiment_score:double>>>>",
    "massive": "title string, description string, published_utc string, insights array<"
    "struct<ticker:string,sentiment:string,sentiment_reasoning:string>>",
    "yahoo": "content struct<title:string,pubDate:string,summary:string>",
}


def read_payloads(
    spark: SparkSession, vendor: str, paths: str | list[str], multi_line: bool = False
) -> DataFrame:
    """Landed JSON, one payload per line (or per file with ``multi_line``); a top-level list
    gives one row per element."""
    reader = spark.read.schema(SCHEMAS[vendor]).option("multiLine", multi_line)
    return reader.json(paths)


def _name(ticker: str | Column) -> Column:
    return F.lit(ticker) if isinstance(ticker, str) else ticker


def _news(df: DataFrame, time: Column, ticker, title, summary, score) -> DataFrame:
    return df.select(
        time.alias("pub_time"),
        _name(ticker).alias("ticker"),
        title.alias("title"),
        summary.alias("summary"),
        finite(score).alias("sentiment_score"),
    )


def alpha_vantage(payloads: DataFrame, ticker: str | Column) -> DataFrame:
    """S6."""
    rows = payloads.withColumn("a", F.explode("feed"))
    time = parse_time(F.col("a.time_published"), "yyyyMMdd'T'HHmmss")
    return _news(
        rows, time, ticker, F.col("a.title"), F.col("a.summary"), F.col("a.overall_sentiment_score")
    )


def eodhd(articles: DataFrame, ticker: str | Column) -> DataFrame:
    """The offset of the time is dropped, not applied."""
    time = parse_time(F.substring("date", 1, 19), "yyyy-MM-dd'T'HH:mm:ss")
    score = F.col("sentiment.polarity")
    return _news(articles, time, ticker, F.col("title"), F.col("content"), score)


def finnhub(articles: DataFrame, ticker: str | Column) -> DataFrame:
    """Epoch seconds, no score."""
    time = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, `datetime`)")
    none = F.lit(None).cast("double")
    return _news(articles, time, ticker, F.col("headline"), F.col("summary"), none)


def marketaux(payloads: DataFrame, ticker: str | Column) -> DataFrame:
    """The score of the first entity; none without entities."""
    rows = payloads.withColumn("a", F.explode("data"))
    time = parse_time(F.col("a.published_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    score = F.try_element_at(F.col("a.entities"), F.lit(1))["sentiment_score"]
    return _news(rows, time, ticker, F.col("a.title"), F.col("a.description"), score)


def massive_label(ticker: str | Column) -> Column:
    """Sentiment label of the first insight about the ticker."""
    own = F.filter("insights", lambda i: i["ticker"] == _name(ticker))
    return F.try_element_at(own, F.lit(1))["sentiment"]


def massive(articles: DataFrame, ticker: str | Column) -> DataFrame:
    """Label of the ticker's insight mapped to a score; unknown labels give NULL."""
    time = parse_time(F.col("published_utc"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    score = label_score(massive_label(ticker))
    return _news(articles, time, ticker, F.col("title"), F.col("description"), score)


def massive_rejects(articles: DataFrame, ticker: str | Column) -> DataFrame:
    """Unknown labels and how often each came."""
    label = massive_label(ticker)
    unknown = articles.filter(label.isNotNull() & label_score(label).isNull())
    return unknown.groupBy(F.lower(label).alias("label")).agg(F.count("*").alias("n"))


def yahoo(articles: DataFrame, ticker: str | Column) -> DataFrame:
    """Nested content, no score."""
    time = parse_time(F.col("content.pubDate"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    none = F.lit(None).cast("double")
    return _news(
        articles, time, ticker, F.col("content.title"), F.col("content.summary"), none
    )


NORMALISERS = {
    "alpha_vantage": alpha_vantage,
    "eodhd": eodhd,
    "finnhub": finnhub,
    "marketaux": marketaux,
    "massive": massive,
    "yahoo": yahoo,
}
