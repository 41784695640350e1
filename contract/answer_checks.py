"""Model answers to columns, classifier post-processing, batch scoring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from contract.adapters import ANSWERS, CLEAN, NEWS, answers, news, r, rounded, table
from contract.news_checks import clean
from contract.registry import check, sql
from tidewire.functions import answers as A
from tidewire.functions.expressions import label_score
from tidewire.plans.scoring import score_texts

# Vendor labels as they may come in, with one nobody knows.
LABELS_IN = (
    "Very Positive", "bullish", "positive", "Neutral/Positive", "neutral", "mixed", "HOLD",
    "neutral/negative", "Negative", "bearish", "unheard of",
)


@check("x16_label_score", sql(
    """select doc_id, label, case lower(label)
         when 'very positive' then 1.0 when 'bullish' then 1.0 when 'positive' then 0.8
         when 'neutral/positive' then 0.3 when 'neutral' then 0.0 when 'mixed' then 0.0
         when 'hold' then 0.0 when 'neutral/negative' then -0.3 when 'negative' then -1.0
         when 'bearish' then -1.0 end::double as score from raw_labels""",
    "raw_labels as (select doc_id, list_extract(["
    + ", ".join(f"'{x}'" for x in LABELS_IN)
    + f"], cast(doc_id % {len(LABELS_IN)} as int) + 1) as label from documents)"))
def _(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in LABELS_IN])
    label = F.element_at(names, (F.col("doc_id") % len(LABELS_IN)).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label")).withColumn(
        "score", label_score(F.col("label"))
    )


# --- reading an answer ---

RESCUED = """braces as (
  select *, regexp_extract(answer, '(?s)\\{.*\\}') as inner_text from answers),
rescued as (
  select *, case when json_valid(answer) then answer when json_valid(inner_text) then inner_text end as j,
    case when json_valid(inner_text) then inner_text end as inner_j,
    case when json_valid(share_answer) and json_type(share_answer) = 'OBJECT' then share_answer end as sj
  from braces)"""


@check("x18_json_rescue", sql(
    """select news_id, case when json_type(j) in ('OBJECT', 'ARRAY') then json_type(j) end as kind,
       json_extract_string(j, '$.llm_score') as score_text,
       json_extract_string(j, '$.llm_label') as label_text from rescued""", ANSWERS, RESCUED))
def _(spark, sf_dir):
    read = answers(spark, sf_dir).withColumn("v", A.rescued_json(F.col("answer")))
    kind = A.json_kind(F.col("v"))
    return read.select(
        "news_id",
        F.when(kind.isin("OBJECT", "ARRAY"), kind).alias("kind"),
        F.try_variant_get("v", "$.llm_score", "string").alias("score_text"),
        F.try_variant_get("v", "$.llm_label", "string").alias("label_text"),
    )


def _number(j: str, name: str) -> str:
    return f"try_cast(json_extract_string({j}, '$.{name}') as double)"


def _there(j: str, name: str) -> str:
    return f"json_exists({j}, '$.{name}')"


_ORDER = (
    "llm_positive", "llm_negative", "llm_neutral", "llm_confidence", "llm_score", "llm_relevance",
    "llm_impact_magnitude", "llm_uncertainty",
)
_BAD = " or ".join(f"({_there('j', n)} and {_number('j', n)} is null)" for n in _ORDER)
_STATE = f"""states as (
  select *, case when news_text is null or trim(news_text) = '' then 'blank'
    when j is null or json_type(j) <> 'OBJECT' then 'no JSON object'
    when {_BAD} then 'bad' else 'good' end as state,
    case when json_exists(j, '$.llm_label')
      and lower(trim(json_extract_string(j, '$.llm_label'))) in ('positive', 'negative', 'neutral')
      then lower(trim(json_extract_string(j, '$.llm_label'))) else 'neutral' end as label
  from rescued)"""


def _float_column(name: str) -> str:
    default = A.FLOAT_DEFAULTS[name]
    low = -1.0 if name == "llm_score" else 0.0
    blank = {"llm_neutral": 1.0, "llm_confidence": 1.0}.get(name, 0.0)
    failed = {"llm_neutral": 1.0, "llm_uncertainty": 1.0}.get(name, 0.0)
    return r(
        f"case state when 'blank' then {blank} when 'good' then "
        f"greatest({low}, least(1.0, coalesce({_number('j', name)}, {default}))) else {failed} end",
        name,
    )


def _float_answers(spark, sf_dir):
    return A.add_answer(
        answers(spark, sf_dir), A.float_answer(F.col("news_text"), F.col("answer"))
    )


@check("x19_float_answer", sql(
    f"""select news_id, {', '.join(_float_column(n) for n in _ORDER)},
        case when state = 'good' then label else 'neutral' end as llm_label,
        case state when 'no JSON object' then state when 'bad' then 'not a number: llm_score' end
          as llm_error from states""", ANSWERS, RESCUED, _STATE))
def _(spark, sf_dir):
    out = _float_answers(spark, sf_dir)
    return rounded(out.select("news_id", *A.ORDER))


@check("x22_fixed_answers", sql(
    """select state in ('blank') as is_blank, count(*) as n,
       sum(case state when 'blank' then 1.0 when 'good' then null else 0.0 end) as sum_confidence,
       sum(case state when 'blank' then 0.0 when 'good' then null else 1.0 end) as sum_uncertainty
       from states where state <> 'good' group by all""", ANSWERS, RESCUED, _STATE))
def _(spark, sf_dir):
    out = _float_answers(spark, sf_dir)
    blank = A.is_blank(F.col("news_text"))
    return (
        out.filter(blank | F.col("llm_error").isNotNull())
        .groupBy(blank.alias("is_blank"))
        .agg(
            F.count("*").alias("n"),
            F.sum("llm_confidence").alias("sum_confidence"),
            F.sum("llm_uncertainty").alias("sum_uncertainty"),
        )
    )


_INTEGER = f"""whole as (
  select *, case when inner_j is not null and json_type(inner_j) = 'OBJECT' then inner_j end as v from rescued),
scaled as (
  select *, (coalesce({_there('v', 'llm_score')}, false) and {_number('v', 'llm_score')} is null)
      or (coalesce({_there('v', 'llm_confidence')}, false) and {_number('v', 'llm_confidence')} is null) as bad,
    round(greatest(-1.0, least(1.0, coalesce({_number('v', 'llm_score')}, 0) / 5)), 2) as s,
    round(greatest(0.0, least(1.0, coalesce({_number('v', 'llm_confidence')}, 0) / 10)), 2) as c,
    case when lower(trim(json_extract_string(v, '$.llm_label'))) in ('positive', 'negative', 'neutral')
      then lower(trim(json_extract_string(v, '$.llm_label'))) else 'neutral' end as label
  from whole)"""


def _ok(expr: str, name: str) -> str:
    return r(f"case when not bad then {expr} end", name)


@check("x20_integer_answer", sql(
    f"""select news_id, {_ok('case when s > 0.2 then s else 0 end', 'llm_positive')},
        {_ok('case when s < -0.2 then -s else 0 end', 'llm_negative')},
        {_ok('round(1 - abs(s), 2)', 'llm_neutral')}, {_ok('c', 'llm_confidence')},
        {_ok('s', 'llm_score')}, {_ok('0.9', 'llm_relevance')},
        {_ok('abs(s)', 'llm_impact_magnitude')}, {_ok('round(1 - c, 2)', 'llm_uncertainty')},
        case when not bad then label end as llm_label,
        case when bad then 'not a number: llm_score' end as llm_error from scaled""",
    ANSWERS, RESCUED, _INTEGER))
def _(spark, sf_dir):
    out = A.add_answer(answers(spark, sf_dir), A.integer_answer(F.col("answer")))
    return rounded(out.select("news_id", *A.ORDER))


_FIELDS = A.PROBABILITY_FIELDS
_OUTSIDE = "coalesce(" + ", ".join(
    f"case when coalesce({_number('sj', n)} not between 0 and 1, true) then 'range: {n}' end" for n in _FIELDS
) + ")"
_STRICT = f"""strict as (
  select news_id, {', '.join(f"{_number('sj', n)} as {n}" for n in _FIELDS)},
    case when sj is null then 'no JSON object' when {_OUTSIDE} is not null then {_OUTSIDE}
      when abs({_number('sj', 'positive')} + {_number('sj', 'negative')} + {_number('sj', 'neutral')} - 1) > 0.02::double
      then 'shares do not sum to 1' end as llm_error
  from rescued)"""


def _valid(expr: str, name: str) -> str:
    return r(f"case when llm_error is null then {expr} end", name)


@check("x21_strict_answer", sql(
    f"""select news_id, {_valid('positive', 'llm_positive')}, {_valid('negative', 'llm_negative')},
        {_valid('neutral', 'llm_neutral')},
        {_valid('greatest(positive, negative, neutral)', 'llm_confidence')},
        {_valid('positive - negative', 'llm_score')}, {_valid('relevance', 'llm_relevance')},
        {_valid('impact_magnitude', 'llm_impact_magnitude')}, {_valid('uncertainty', 'llm_uncertainty')},
        case when llm_error is null then case when positive >= greatest(negative, neutral) then 'positive'
          when negative >= neutral then 'negative' else 'neutral' end end as llm_label,
        llm_error from strict""", ANSWERS, RESCUED, _STRICT))
def _(spark, sf_dir):
    out = A.add_answer(answers(spark, sf_dir), A.strict_answer(F.col("share_answer")))
    return rounded(out.select("news_id", *A.ORDER))


# --- classifier ---

_SOFTMAX = """logits as (
  select doc_id, (n_chars % 7) / 2.0::double as a, (doc_id % 5) / 2.0::double as b,
    (n_chars % 3)::double as c from documents),
softmax as (
  select doc_id, exp(a) / (exp(a) + exp(b) + exp(c)) as p, exp(b) / (exp(a) + exp(b) + exp(c)) as n,
    exp(c) / (exp(a) + exp(b) + exp(c)) as u, a, b, c from logits)"""


@check("x23_classifier_columns", sql(
    f"""select doc_id, {r('p', 'finbert_positive')}, {r('n', 'finbert_negative')},
        {r('u', 'finbert_neutral')}, {r('greatest(p, n, u)', 'finbert_confidence')},
        {r('p - n', 'finbert_score')},
        case when a >= b and a >= c then 'positive' when b >= c then 'negative' else 'neutral' end
          as finbert_label from softmax""", _SOFTMAX))
def _(spark, sf_dir):
    logits = F.array(
        (F.col("n_chars") % 7) / 2.0, (F.col("doc_id") % 5) / 2.0, (F.col("n_chars") % 3).cast("double")
    )
    out = table(spark, sf_dir, "documents").select("doc_id", logits.alias("logits"))
    return rounded(out.select("doc_id", *A.classifier_columns(F.col("logits"))))


def length_model():
    """A stand-in for a model: class scores from text length. Loaded once per Python worker."""

    def score(texts: list[str]) -> list[list[float]]:
        if any(t is None for t in texts):
            raise ValueError("no text")
        return [[(len(t) % 7) / 2.0, (len(t) % 5) / 2.0, float(len(t) % 3)] for t in texts]

    return score


@check("m6_batch_scoring", sql(
    """select news_id, (length(news_text) % 7) / 2.0::double as s0,
       (length(news_text) % 5) / 2.0::double as s1, (length(news_text) % 3)::double as s2,
       cast(null as varchar) as score_error from clean""", NEWS, CLEAN))
def _(spark, sf_dir):
    texts = clean(spark, sf_dir).select("news_id", "news_text")
    out = score_texts(texts, "news_text", length_model, "scores", "array<double>", batch_size=32)
    return out.select(
        "news_id", *[F.col("scores")[i].alias(f"s{i}") for i in range(3)], "score_error"
    )
