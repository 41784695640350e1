"""Files, vendor payloads, the news store, streaming, model jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contract.adapters import BARS, CLEAN, NEWS, TICKERS, bars, news, predictions, r, rounded, table
from contract.answer_checks import length_model
from contract.news_checks import clean
from contract.registry import check, sql
from tidewire.operators import dataset as D
from tidewire.operators import features as Z
from tidewire.operators import indicators as I
from tidewire.operators.evaluate import regression_metrics
from tidewire.operators.news import merge_market
from tidewire.operators.series import COUNT, POS
from tidewire.plans import trees as M
from tidewire.schemas import NEWS_RAW, TECHNICAL_FEATURES, require_columns
from tidewire.session import materialise, shared_dir
from tidewire.sources import files as S
from tidewire.sources import store as U
from tidewire.sources import vendors as V
from tidewire.streaming import ingest as T

RAW = [f.name for f in NEWS_RAW.fields]
RAW_SQL = "pub_time, ticker, nullif(title, '') as title, summary, sentiment_score"


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- files and tables ---


@check("s1_csv_scan", sql(f"select {RAW_SQL} from news", NEWS))
def _(spark, sf_dir):
    path = scratch(spark, "csv")
    S.write_csv(news(spark, sf_dir).select(*RAW), path)
    return S.read_csv(spark, path, multi_line=True)  # summaries have line breaks


@check("s2_table_overwrite", sql(f"select news_id, {RAW_SQL} from news", NEWS))
def _(spark, sf_dir):
    path = scratch(spark, "news")
    whole = news(spark, sf_dir).withColumn("title", F.nullif("title", F.lit("")))
    S.write_table(whole.withColumn("title", F.lit("old")), path)
    S.write_table(whole, path)
    return spark.read.parquet(path)


@check("s3_append", sql(
    f"select news_id, {RAW_SQL} from news union all select news_id, {RAW_SQL} from news", NEWS))
def _(spark, sf_dir):
    path = scratch(spark, "news")
    whole = news(spark, sf_dir).withColumn("title", F.nullif("title", F.lit("")))
    S.write_table(whole, path, "append")
    S.write_table(whole, path, "append")
    return spark.read.parquet(path)


@check("s4_save_table", sql("select * from bars union all select * from bars", BARS))
def _(spark, sf_dir):
    path = scratch(spark, "market")
    whole = bars(spark, sf_dir)
    for mode in ("fail", "append", "replace", "append"):
        S.save_table(whole, path, mode)
    return spark.read.parquet(path)


@check("s5_retrieve_by_ticker", sql(
    "select * from bars where ticker = '3-MEDIUM' order by trade_date", BARS))
def _(spark, sf_dir):
    return S.retrieve_by_ticker(bars(spark, sf_dir), "3-MEDIUM")


@check("p8_required_columns", sql("select * from bars", BARS))
def _(spark, sf_dir):
    return require_columns(bars(spark, sf_dir), ["ticker", "trade_date", "close_px"])


@check("s12_flatten_ohlcv", sql(
    "select trade_date, ticker, open_px, high_px, low_px, close_px, volume from bars", BARS))
def _(spark, sf_dir):
    """Each ticker's bars come as a download of its own, with two-level names."""
    whole = materialise(bars(spark, sf_dir), "bars")
    flat = []
    for name in TICKERS:
        landed = whole.filter(F.col("ticker") == name).select(
            *[F.col(ours).alias(f"{theirs}|{name}") for theirs, ours in S.OHLCV_NAMES.items()]
        )
        flat.append(S.flatten_ohlcv(landed, name))
    return merge_market(flat)


# --- vendor payloads: written as JSON text from the news table, read back with the schema ---

ISO = "yyyy-MM-dd'T'HH:mm:ss"
LABEL_OF = {1.0: "Bullish", 0.0: "neutral"}


def _payload(spark, sf_dir, vendor: str, *columns):
    text = news(spark, sf_dir).select("ticker", F.to_json(F.struct(*columns)).alias("j"))
    return text.select("ticker", F.from_json("j", V.SCHEMAS[vendor]).alias("p")).select("ticker", "p.*")


def _time(pattern: str):
    return F.date_format("pub_time", pattern)


@check("s6_alpha_vantage", sql("select pub_time, ticker, title, summary, sentiment_score from news", NEWS))
def _(spark, sf_dir):
    article = F.struct(
        "title", _time("yyyyMMdd'T'HHmmss").alias("time_published"), "summary",
        F.col("sentiment_score").alias("overall_sentiment_score"),
    )
    payload = _payload(spark, sf_dir, "alpha_vantage", F.array(article).alias("feed"))
    return V.alpha_vantage(payload, F.col("ticker"))


@check("s7_eodhd", sql("select pub_time, ticker, title, summary, sentiment_score from news", NEWS))
def _(spark, sf_dir):
    payload = _payload(
        spark, sf_dir, "eodhd", "title", F.concat(_time(ISO), F.lit("+02:00")).alias("date"),
        F.col("summary").alias("content"),
        F.struct(F.col("sentiment_score").alias("polarity")).alias("sentiment"),
    )
    return V.eodhd(payload, F.col("ticker"))


@check("s8_finnhub", sql(
    "select pub_time, ticker, title, summary, cast(null as double) as sentiment_score from news", NEWS))
def _(spark, sf_dir):
    epoch = F.unix_timestamp(F.col("pub_time").cast("timestamp"))
    payload = _payload(
        spark, sf_dir, "finnhub", F.lit("company").alias("category"), epoch.alias("datetime"),
        F.col("title").alias("headline"), "summary",
    )
    return V.finnhub(payload, F.col("ticker"))


@check("s9_marketaux", sql("select pub_time, ticker, title, summary, sentiment_score from news", NEWS))
def _(spark, sf_dir):
    entity = F.struct(F.lit(1.0).alias("match_score"), "sentiment_score")
    second = F.struct(F.lit(0.5).alias("match_score"), F.lit(0.123).alias("sentiment_score"))
    article = F.struct(
        "title", F.concat(_time(ISO), F.lit(".000000Z")).alias("published_at"),
        F.col("summary").alias("description"),
        F.when(F.col("sentiment_score").isNull(), F.array()).otherwise(F.array(entity, second)).alias("entities"),
    )
    payload = _payload(spark, sf_dir, "marketaux", F.array(article).alias("data"))
    return V.marketaux(payload, F.col("ticker"))


@check("s10_massive", sql(
    """select pub_time, ticker, title, summary, case sentiment_score when 1 then 1.0 when 0 then 0.0 end::double
       as sentiment_score from news""", NEWS))
def _(spark, sf_dir):
    label = F.when(F.col("sentiment_score") == 1, "Bullish").when(F.col("sentiment_score") == 0, "neutral").otherwise("unheard of")
    other = F.struct(F.lit("OTHER").alias("ticker"), F.lit("bearish").alias("sentiment"))
    own = F.struct("ticker", label.alias("sentiment"))
    payload = _payload(
        spark, sf_dir, "massive", "title", F.col("summary").alias("description"),
        F.concat(_time(ISO), F.lit("Z")).alias("published_utc"),
        F.when(F.col("sentiment_score").isNotNull(), F.array(other, own)).alias("insights"),
    )
    return V.massive(payload, F.col("ticker"))


@check("s11_yahoo", sql(
    "select pub_time, ticker, title, summary, cast(null as double) as sentiment_score from news", NEWS))
def _(spark, sf_dir):
    content = F.struct("title", F.concat(_time(ISO), F.lit("Z")).alias("pubDate"), "summary")
    return V.yahoo(_payload(spark, sf_dir, "yahoo", content.alias("content")), F.col("ticker"))


# --- store ---


# Some articles without a time, others without a title.
HOLES = """holes as (select * replace (case when news_id % 9 <> 0 then pub_time end as pub_time,
  case when news_id % 11 <> 0 then title end as title) from news)"""


def with_holes(spark, sf_dir):
    return news(spark, sf_dir).withColumns(
        {
            "pub_time": F.when(F.col("news_id") % 9 != 0, F.col("pub_time")),
            "title": F.when(F.col("news_id") % 11 != 0, F.col("title")),
        }
    )


@check("s13_store_upsert", sql(
    """select * exclude (prio) from (
         select *, 0 as prio from holes union all
         select news_id, pub_time, ticker, case when sentiment_score is null then title || ' (2)' else title end,
           summary, 5.0, 1 from holes)
       qualify row_number() over (partition by pub_time, ticker, title order by prio, news_id) = 1""", NEWS, HOLES))
def _(spark, sf_dir):
    existing = with_holes(spark, sf_dir)
    second = F.when(F.col("sentiment_score").isNull(), F.concat("title", F.lit(" (2)"))).otherwise(F.col("title"))
    incoming = existing.withColumn("title", second).withColumn("sentiment_score", F.lit(5.0))
    return U.upsert(existing, incoming)


@check("s13_store_append", sql(
    """select * from holes
       qualify row_number() over (partition by pub_time, ticker, title order by news_id) = 1""", NEWS, HOLES))
def _(spark, sf_dir):
    """The same batch three times, as after two failures."""
    path = scratch(spark, "store")
    for _ in range(3):
        U.append_to_store(with_holes(spark, sf_dir), path)
    return spark.read.parquet(path).drop(U.MONTH)


@check("s13_indexed_store", sql(
    """select * from holes
       qualify row_number() over (partition by pub_time, ticker, title order by news_id) = 1""", NEWS, HOLES))
def _(spark, sf_dir):
    """Two halves, the whole, a compaction, and the whole again: the buckets say what is there."""
    name = f"indexed_{uuid.uuid4().hex}"
    whole = with_holes(spark, sf_dir)
    U.open_indexed_store(spark, name, scratch(spark, "indexed"), whole.schema, buckets=8)
    # Of equal articles the one with the smaller number is stored, so those of the other half wait.
    first = whole.groupBy("pub_time", "ticker", "title").agg(F.min("news_id").alias("news_id")).select("news_id")
    first = materialise(first, "first-ids")
    for part in (whole.filter("news_id % 2 = 0"), whole.filter("news_id % 2 = 1")):
        U.append_to_indexed_store(part.join(first, "news_id", "left_semi"), name)
    U.append_to_indexed_store(whole, name)
    U.compact_store(spark, name, files=1)
    U.append_to_indexed_store(whole, name)
    return spark.table(name).drop(U.KEY, U.MONTH)


_WALK = """have as (select distinct ticker, cast(pub_time as date) as day from news),
walk as (
  select ticker, date '2001-07-31' as day, 0::bigint as empty from (select distinct ticker from news union select 'NOT STORED')
  union all
  select w.ticker, cast(w.day - interval 1 day as date),
    case when h.day is not null then 0 else w.empty + 1 end
  from walk w left join have h on h.ticker = w.ticker and h.day = w.day
  where w.day > date '1995-01-01'
    and case when h.day is not null then 0 else w.empty + 1 end <= 7)"""


@check("s14_backfill_plan", sql(
    """select w.ticker, w.day from walk w left join have h on h.ticker = w.ticker and h.day = w.day
       where h.day is null""", NEWS, _WALK, recursive=True))
def _(spark, sf_dir):
    stored = news(spark, sf_dir)
    wanted = stored.select("ticker").unionByName(spark.createDataFrame([("NOT STORED",)], "ticker string"))
    return U.backfill_days(stored, "1995-01-01", "2001-07-31", tickers=wanted)


# --- streaming over the events table ---


def _event_news(events):
    return events.select(
        F.col("event_id").alias("news_id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("pub_time"),
        F.col("event_type").alias("ticker"),
        F.concat(F.lit("by user "), F.col("user_id").cast("string")).alias("title"),
        F.lit(0.0).alias("sentiment_score"),
        "value",
        F.col("ts").cast("timestamp_ntz").alias("at"),
    )


def _landing(spark, sf_dir, base):
    """All events as four files that land out of order: the newest first, the oldest last but one."""
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    share = (F.unix_timestamp("ts") - F.unix_timestamp(F.lit(first))) / max((last - first).total_seconds(), 1)
    placed = events.withColumn("_quarter", F.least(F.floor(share * 4), F.lit(3)))
    for quarter in (3, 1, 0, 2):
        part = placed.filter(F.col("_quarter") == quarter).drop("_quarter")
        part.coalesce(1).write.mode("append").parquet(f"{base}/landing")
    return _event_news(T.landed(spark, f"{base}/landing", events.schema, per_trigger=1))


@check("t1_stream_upsert", """select distinct date_trunc('hour', ts) as pub_time, event_type as ticker,
  'by user ' || user_id as title, case when event_type = 'click' then 1.0 else 0.0 end::double as sentiment_score
  from events""")
def _(spark, sf_dir):
    base = scratch(spark, "upsert")
    stored = table(spark, sf_dir, "events").filter("event_type = 'click'").select(
        F.col("event_id").alias("news_id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("pub_time"),
        F.col("event_type").alias("ticker"),
        F.concat(F.lit("by user "), F.col("user_id").cast("string")).alias("title"),
        F.lit(1.0).alias("sentiment_score"),
        "value",
        F.col("ts").cast("timestamp_ntz").alias("at"),
    )
    U.append_to_store(stored, f"{base}/store")
    T.stream_upsert(_landing(spark, sf_dir, base), f"{base}/store", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/store").select("pub_time", "ticker", "title", "sentiment_score")


@check("t2_stream_scores", """select event_id as news_id, ('by user ' || user_id) as title,
  (length('by user ' || user_id) % 7) / 2.0::double as s0 from events""")
def _(spark, sf_dir):
    base = scratch(spark, "scores")
    stream = _landing(spark, sf_dir, base).select("news_id", "title")
    for _ in range(2):  # the second start finds everything done
        T.stream_scores(
            stream, "title", length_model, "scores", "array<double>", f"{base}/store", f"{base}/checkpoint"
        ).awaitTermination()
    return spark.read.parquet(f"{base}/store").select("news_id", "title", F.col("scores")[0].alias("s0"))


@check("t3_stream_daily", f"""select cast(ts as date) as news_date, event_type as ticker,
  {r('avg(value)', 'value')}, count(*) as news_count from events group by 1, 2""")
def _(spark, sf_dir):
    base = scratch(spark, "daily")
    stream = _landing(spark, sf_dir, base)
    for _ in range(2):  # the second start finds everything done
        T.stream_daily(stream, {"value": F.col("value")}, f"{base}/store", f"{base}/checkpoint").awaitTermination()
    return rounded(T.read_daily(spark, f"{base}/store", ["value"]))


@check("t1_stream_state", """select distinct date_trunc('hour', ts) as pub_time, event_type as ticker,
  'by user ' || user_id as title, 1 as copies from events""")
def _(spark, sf_dir):
    """Every file lands twice; what state remembers does not reach the store, and nothing changes."""
    base = scratch(spark, "state")
    once = _landing(spark, sf_dir, base)
    T.stream_upsert(once, f"{base}/store", f"{base}/checkpoint", memory="7 days").awaitTermination()
    spark.read.parquet(f"{base}/landing").write.parquet(f"{base}/again")
    spark.read.parquet(f"{base}/again").write.mode("append").parquet(f"{base}/landing")
    T.stream_upsert(once, f"{base}/store", f"{base}/checkpoint", memory="7 days").awaitTermination()
    stored = spark.read.parquet(f"{base}/store")
    return stored.groupBy("pub_time", "ticker", "title").agg(F.count("*").cast("int").alias("copies"))


_LATE = "event_id % 20 = 0"


@check("t3_closed_days", f"""with span as (select min(ts) as lo, max(ts) as hi from events),
  -- Late rows are told by the watermark that the batch before them ran with: that of three files.
  ends as (
    select max(ts) filter (not {_LATE} and floor((floor(epoch(ts)) - floor(epoch(lo))) / (epoch(hi) - epoch(lo)) * 4) < 3)
        - interval 2 day as mark_then, max(ts) - interval 2 day as mark from events, span),
  days as (
    select cast(ts as date) as news_date, event_type as ticker, avg(value) as mean, count(*) as news_count,
      count(*) filter (not {_LATE} or cast(ts as date) + interval 1 day > mark_then) as seen
    from events, ends group by cast(ts as date), event_type, mark_then)
  select news_date, ticker, {r('mean', 'value')}, news_count, news_count - seen as late
  from days, ends where seen > 0 and news_date + interval 1 day <= mark""")
def _(spark, sf_dir):
    """Files land in order of time; a twentieth of all events comes after every day it is of was closed."""
    base = scratch(spark, "closed")
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    share = (F.unix_timestamp("ts") - F.unix_timestamp(F.lit(first))) / max((last - first).total_seconds(), 1)
    placed = events.withColumn("_part", F.when(F.expr(_LATE), 4).otherwise(F.least(F.floor(share * 4), F.lit(3))))
    for part in range(5):
        placed.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(f"{base}/landing")
    stream = _event_news(T.landed(spark, f"{base}/landing", events.schema, per_trigger=1)).withColumn("pub_time", F.col("at"))
    scores = {"value": F.col("value")}
    for _ in range(2):  # the second start finds everything done
        T.stream_closed_days(stream, scores, f"{base}/closed", f"{base}/closed-checkpoint").awaitTermination()
        T.stream_daily(stream, scores, f"{base}/parts", f"{base}/parts-checkpoint").awaitTermination()
    return rounded(T.read_closed_days(spark, f"{base}/closed", f"{base}/parts", ["value"]))


# --- model jobs: a preset as it is, over whole tables ---

FEATURES = [c for c in TECHNICAL_FEATURES]


def model_rows(spark, sf_dir):
    market = I.add_indicators(bars(spark, sf_dir), keep=(POS, COUNT))
    rows = materialise(
        D.split_by_date(materialise(Z.drop_incomplete(Z.labelled_features(market), FEATURES), "features")),
        "split",
    )
    fitted = D.fit_scaler(rows.filter("split = 'train'"), FEATURES)
    return D.apply_scaler(rows, fitted, FEATURES)


_MODELS: dict[tuple[str, str], tuple] = {}


def preset_model(spark, sf_dir):
    """Rows and the model of preset ``multi``; fitted once per session and folder for its three checks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        settings = M.preset("multi")
        rows = materialise(model_rows(spark, sf_dir), "model-rows")
        _MODELS[key] = settings, rows, M.fit_trees(rows, FEATURES, settings)
    return _MODELS[key]


@check("m5_boosted_trees")
def _(spark, sf_dir):
    _, rows, model = preset_model(spark, sf_dir)
    scored = M.predict(model, rows.filter("split = 'test'"), FEATURES)
    return scored.select("ticker", "trade_date", "close_px", "y", "y_hat")


@check("m5_learns", "select 'train' as split, true as beats_mean, true as all_predicted")
def _(spark, sf_dir):
    """On the rows it has seen the model is better than their mean, with a prediction for each."""
    _, rows, model = preset_model(spark, sf_dir)
    scored = M.predict(model, rows.filter("split = 'train'"), FEATURES)
    errors = scored.agg(
        F.avg((F.col("y") - F.col("y_hat")) ** 2).alias("model"), F.var_pop("y").alias("mean"),
        (F.count("y_hat") == F.count("*")).alias("all_predicted"),
    )
    return errors.select(F.lit("train").alias("split"), (F.col("model") < F.col("mean")).alias("beats_mean"), "all_predicted")


@check("m7_feature_importance", " union all ".join(
    f"select '{c}' as feature, 'technical' as grp, true as in_range, true as sums_to_one" for c in FEATURES))
def _(spark, sf_dir):
    _, _, model = preset_model(spark, sf_dir)
    table_ = M.feature_importance(model, FEATURES)
    total = table_.agg(F.sum("importance")).scalar()
    return table_.select(
        "feature", "grp", F.col("importance").between(0, 1).alias("in_range"), (F.abs(total - 1) < 1e-9).alias("sums_to_one")
    )


@check("m8_training_curve", "select unnest(['train', 'val']) as part, true as every_round, true as same_rmse, true as same_mae")
def _(spark, sf_dir):
    """The errors of the round that is kept are those of the predictions, as A10 has them."""
    settings, rows, model = preset_model(spark, sf_dir)
    ends = M.training_curve(model).groupBy("part").agg(
        F.max_by("rmse", F.col("iteration") == model.best).alias("last_rmse"),
        F.max_by("mae", F.col("iteration") == model.best).alias("last_mae"),
        (F.count("*") == F.max("iteration")).alias("every_round"),
    )
    measured = [
        regression_metrics(M.predict(model, rows.filter(F.col("split") == part), FEATURES)).withColumn("part", F.lit(part))
        for part in ("train", settings.validation)
    ]
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-9
    return ends.join(measured[0].unionByName(measured[1]), "part").select(
        "part", "every_round", near("last_rmse", "rmse").alias("same_rmse"), near("last_mae", "mae").alias("same_mae")
    )
