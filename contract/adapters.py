"""The driver's tables seen as market and news tables: once for Spark, once as DuckDB text.

Every adapter reads whole tables. Both sides spell the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.schemas import q

TICKERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero removed: the form both engines compare in."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(
        *[
            (F.round(q(c), digits) + F.lit(0.0)).alias(c) if c in doubles else q(c)
            for c in df.columns
        ]
    )


def r(expr: str, name: str, digits: int = 6) -> str:
    """The same rounding in an oracle."""
    return f"round(cast({expr} as double), {digits}) + 0.0 as {name}"


# --- bars: one row per order priority and day -------------------------------------------------


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("trade_date")
    ).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open_px"),
        F.max("o_totalprice").alias("high_px"),
        F.min("o_totalprice").alias("low_px"),
        F.max_by("o_totalprice", "o_orderkey").alias("close_px"),
        F.sum(F.col("o_custkey") + 1).alias("volume"),
    )


BARS = """bars as (
  select o_orderpriority as ticker, cast(o_orderdate as date) as trade_date,
    min_by(o_totalprice, o_orderkey) as open_px, max(o_totalprice) as high_px,
    min(o_totalprice) as low_px, max_by(o_totalprice, o_orderkey) as close_px,
    cast(sum(o_custkey + 1) as bigint) as volume
  from orders group by all)"""


# --- news: one article per document -----------------------------------------------------------


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    first_line = F.substring_index("text", "\n", 1)
    rest = F.expr("case when instr(text, '\\n') > 0 then substring(text, instr(text, '\\n') + 1) end")
    names = F.array(*[F.lit(t) for t in TICKERS])
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("news_id"),
        F.expr(
            "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval("
            "cast((n_chars * 7) % 2400 as int), 0, 0, doc_id % 86400)"
        ).alias("pub_time"),
        F.element_at(names, (F.col("n_chars") % 5).cast("int") + 1).alias("ticker"),
        first_line.alias("title"),
        F.nullif(rest, F.lit("")).alias("summary"),
        (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment_score"),
    )


_TICKER_LIST = "[" + ", ".join(f"'{t}'" for t in TICKERS) + "]"

NEWS = f"""news as (
  select d.doc_id as news_id,
    timestamp '1995-01-01 00:00:00' + to_days(cast((n_chars * 7) % 2400 as int))
      + to_seconds(d.doc_id % 86400) as pub_time,
    list_extract({_TICKER_LIST}, cast(n_chars % 5 as int) + 1) as ticker,
    split_part(text, chr(10), 1) as title,
    nullif(substring(text, length(split_part(text, chr(10), 1)) + 2), '') as summary,
    cast(l.quality - l.toxic as double) as sentiment_score
  from documents d left join labels l on d.doc_id = l.doc_id)"""


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second news file without scores: one article per conversation turn."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("news_id"),
        F.expr(
            "timestamp_ntz'1995-01-01 00:00:00'"
            " + make_dt_interval(cast(conv_id % 2400 as int), 0, 0, turn)"
        ).alias("pub_time"),
        F.col("role").alias("ticker"),
        F.col("text").alias("title"),
        F.lit(None).cast("string").alias("summary"),
    )


TALKS = """talks as (
  select conv_id * 1000 + turn as news_id,
    timestamp '1995-01-01 00:00:00' + to_days(cast(conv_id % 2400 as int)) + to_seconds(turn)
      as pub_time,
    role as ticker, text as title, cast(null as varchar) as summary
  from conversations)"""

# White space as Unicode has it, for a regex engine whose own class is ASCII only.
_BLANK = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)
_ALLOWED = r"a-zA-Z0-9" + _BLANK + r".,!?;:''\"’“”()\[\]{}\-–—_/\\$%&+*=#@"


def tidy_sql(c: str) -> str:
    quotes = "'’“”', '''\"\"'"
    return f"trim(translate(regexp_replace({c}, '[{_BLANK}]+', ' ', 'g'), {quotes}))"


def english_sql(c: str) -> str:
    return f"regexp_full_match({c}, '[{_ALLOWED}]+')"


ENGLISH = f"""tidied as (
  select * replace ({tidy_sql("title")} as title, {tidy_sql("summary")} as summary) from news),
english as (
  select * from tidied
  where coalesce({english_sql("title")}, false)
    and (summary is null or {english_sql("summary")}))"""

CLEAN = f"""{ENGLISH},
clean as (
  select *, rtrim(title || '. ' || coalesce(summary, ''), '.') as news_text from english
  qualify row_number() over (
    partition by ticker, cast(pub_time as date), lower(title) order by pub_time, news_id) = 1)"""


# --- scored: cleaned articles with model scores by formula --------------------------------------


def scored(clean: DataFrame) -> DataFrame:
    size = F.length("news_text")
    score = ((size % 201) - 100) / 100.0
    return clean.withColumns(
        {
            "llm_score": score,
            "llm_confidence": (F.col("news_id") % 101) / 100.0,
            "llm_positive": F.greatest(score, F.lit(0.0)),
            "llm_negative": F.greatest(-score, F.lit(0.0)),
            "llm_neutral": 1 - F.abs(score),
            "llm_relevance": (F.col("news_id") % 11) / 10.0,
            "llm_impact_magnitude": F.abs(score),
            "llm_uncertainty": (size % 51) / 50.0,
        }
    )


SCORED = f"""{CLEAN},
scored as (
  select *, ((length(news_text) % 201) - 100) / 100.0 as llm_score,
    (news_id % 101) / 100.0 as llm_confidence,
    greatest(llm_score, 0.0) as llm_positive, greatest(-llm_score, 0.0) as llm_negative,
    1 - abs(llm_score) as llm_neutral, (news_id % 11) / 10.0 as llm_relevance,
    abs(llm_score) as llm_impact_magnitude, (length(news_text) % 51) / 50.0 as llm_uncertainty
  from clean)"""

SCORE_COLUMNS = (
    "llm_positive",
    "llm_negative",
    "llm_neutral",
    "llm_confidence",
    "llm_score",
    "llm_relevance",
    "llm_impact_magnitude",
    "llm_uncertainty",
)


# --- predictions: one per order -----------------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").alias("ticker"),
        F.to_date("o_orderdate").alias("trade_date"),
        F.col("o_totalprice").alias("close_px"),
        F.round(((F.col("o_custkey") * 7919) % 2001 - 1000) / 10000.0, 4).alias("y"),
        F.round((F.col("o_totalprice") - 250000.0) / 2000000.0, 3).alias("y_hat"),
    )


PREDICTIONS = """predictions as (
  select o_orderkey as row_id, o_orderpriority as ticker, cast(o_orderdate as date) as trade_date,
    o_totalprice as close_px,
    round(cast((o_custkey * 7919) % 2001 - 1000 as double) / 10000, 4) as y,
    round((o_totalprice - 250000) / 2000000, 3) as y_hat
  from orders)"""


# --- answers: raw model answers of 14 shapes, by document ---------------------------------------

# One template per shape; {s}, {c} and {p} are a score, a confidence and a share.
ANSWER_SHAPES = (
    '{"llm_score": {s}, "llm_confidence": {c}, "llm_positive": {p}, "llm_label": "positive"}',
    'Sure, here it is: {"llm_score": {s}, "llm_confidence": {c}, "llm_label": "negative"} Bye.',
    '{"llm_score": {s}} {"llm_score": 0.1}',
    '{"llm_score": "{s}", "llm_confidence": "{c}", "llm_positive": "{p}"}',
    '{"llm_label": " Positive "}',
    '{"llm_score": {s}, "llm_label": "bullish"}',
    '{"llm_score": 9, "llm_confidence": 10, "llm_positive": 1.5, "llm_label": "neutral"}',
    '{"llm_score": -5, "llm_confidence": 10, "llm_negative": -2}',
    '{"llm_score": null, "llm_confidence": {c}}',
    '{"llm_score": {s}, "llm_confidence": {c}} trailing text',
    '{"llm_score": "high", "llm_confidence": {c}}',
    "no json here",
    "",
    '[{"llm_score": {s}}]',
)

SHARE_SHAPES = (
    '{"positive": {p}, "negative": 0.0, "neutral": {n}, "relevance": 0.5, "impact_magnitude": {p}, "uncertainty": 0.1}',
    '{"positive": 0.0, "negative": {p}, "neutral": {n}, "relevance": 0.5, "impact_magnitude": 0.2, "uncertainty": {p}}',
    '{"positive": 0.5, "negative": 0.3, "neutral": 0.17, "relevance": 1, "impact_magnitude": 0, "uncertainty": 0}',
    '{"positive": 0.5, "negative": 0.3, "neutral": 0.21, "relevance": 1, "impact_magnitude": 0, "uncertainty": 0}',
    '{"positive": 0.5, "negative": 0.3, "neutral": 0.22, "relevance": 1, "impact_magnitude": 0, "uncertainty": 0}',
    '{"positive": 0.4, "negative": 0.4, "neutral": 0.2, "relevance": {p}, "impact_magnitude": 0.9, "uncertainty": 0.3}',
    '{"positive": 1.4, "negative": -0.4, "neutral": 0.0, "relevance": 0.5, "impact_magnitude": 0.1, "uncertainty": 0.1}',
    '{"positive": 0.2, "negative": 0.2, "neutral": 0.6, "relevance": 0.5, "impact_magnitude": 0.1}',
    "no json here",
)


def _shape_expression(shapes: tuple[str, ...], modulus_of: str) -> str:
    arms = []
    for i, shape in enumerate(shapes):
        text = "'" + shape.replace("'", "''") + "'"
        for mark in ("s", "c", "p", "n"):
            if "{" + mark + "}" in shape:
                text = f"replace({text}, '{{{mark}}}', {mark}_text)"
        arms.append(f"when {i} then {text}")
    return f"case {modulus_of} % {len(shapes)} {' '.join(arms)} end"


_ANSWER_BODY = f"""
  select doc_id as news_id, news_text, {_shape_expression(ANSWER_SHAPES, "doc_id")} as answer,
    {_shape_expression(SHARE_SHAPES, "doc_id")} as share_answer
  from (
    select doc_id, case when doc_id % 17 = 0 then '  ' else text end as news_text,
      cast((n_chars % 25) - 12 as varchar(10)) as s_text,
      cast(n_chars % 13 as varchar(10)) as c_text,
      concat('0.', cast(10 + n_chars % 90 as varchar(10))) as p_text,
      concat('0.', cast(100 - (10 + n_chars % 90) as varchar(10))) as n_text
    from {{documents}}) t"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _ANSWER_BODY.replace("varchar(10)", "string").replace(
        "{documents}", f"parquet.`{sf_dir}/documents.parquet`"
    )
    return spark.sql(body)


ANSWERS = "answers as (" + _ANSWER_BODY.replace("{documents}", "documents") + ")"
