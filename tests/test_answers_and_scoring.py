import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewire.functions import answers as A
from tidewire.functions.expressions import label_score
from tidewire.plans.scoring import score_texts

ANSWERS = [
    '{"llm_score": 0.4, "llm_confidence": 0.9, "llm_label": "positive"}',
    'Here: {"llm_score": -0.4} bye',
    '{"llm_score": 0.4} {"llm_score": 0.1}',
    '{"llm_score": 0.4}} x {"llm_score": 0.1',
    '{"llm_score": 0.4}] {"a": 1}',
    '{"llm_score": "0.7", "llm_uncertainty": " 0.2 "}',
    '{"llm_label": " Positive "}',
    '{"llm_label": "bullish", "llm_score": 9, "llm_relevance": -3}',
    '{"llm_score": null}',
    '{"llm_score": "high"}',
    '{"llm_score": true}',
    '{"llm_score": [1]}',
    "[1, 2]",
    "5",
    "not json",
    "",
    "{}",
    '{"llm_score": 0.1, "deep": {"llm_score": 5}}',
]


def python_float_answer(answer):
    def strict(text):
        try:
            return json.loads(text)
        except ValueError:
            return None

    value = strict(answer)
    if value is None and "{" in answer and "}" in answer:
        value = strict(answer[answer.find("{") : answer.rfind("}") + 1])
    if not isinstance(value, dict):
        return None
    out = {}
    for name, default in A.FLOAT_DEFAULTS.items():
        try:
            number = float(value.get(name, default))
        except (TypeError, ValueError):
            return None
        out[name] = max(-1.0 if name == "llm_score" else 0.0, min(1.0, number))
    label = str(value.get("llm_label", "neutral")).lower().strip()
    out["llm_label"] = label if label in A.LABELS else "neutral"
    return out


def test_float_answers_equal_python(spark):
    df = spark.createDataFrame([(i, "text", a) for i, a in enumerate(ANSWERS)], "i int, t string, a string")
    out = A.add_answer(df, A.float_answer(F.col("t"), F.col("a"))).orderBy("i").collect()
    for row, answer in zip(out, ANSWERS):
        want = python_float_answer(answer)
        if want is None:
            assert row.llm_error is not None and row.llm_confidence == 0 and row.llm_uncertainty == 1, answer
        else:
            assert row.llm_error is None, answer
            assert {k: row[k] for k in want} == want, answer


def test_blank_text_and_null_answer(spark):
    df = spark.createDataFrame([(None, "{}"), ("  ", "{}"), ("x", None)], "t string, a string")
    rows = A.add_answer(df, A.float_answer(F.col("t"), F.col("a"))).collect()
    assert [(r.llm_confidence, r.llm_uncertainty, r.llm_error) for r in rows] == [(1.0, 0.0, None), (1.0, 0.0, None), (0.0, 1.0, "no JSON object")]


def test_integer_answers(spark):
    cases = [
        ('{"llm_score": 1, "llm_confidence": 7, "llm_label": "Positive"}', (0.0, 0.0, 0.8, "positive", 0.7, 0.2)),
        ('{"llm_score": -5, "llm_confidence": 10}', (0.0, 1.0, 0.0, "neutral", 1.0, -1.0)),
        ('x {"llm_score": 9, "llm_confidence": 99} y', (1.0, 0.0, 0.0, "neutral", 1.0, 1.0)),
        ("no json", (0.0, 0.0, 1.0, "neutral", 0.0, 0.0)),
        ('{"llm_score": 0.625, "llm_confidence": 5}', (0.0, 0.0, 0.88, "neutral", 0.5, 0.12)),
        ('{"llm_score": "bad"}', (None, None, None, None, None, None)),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string")
    rows = A.add_answer(df, A.integer_answer(F.col("a"))).orderBy("i").collect()
    for row, (answer, want) in zip(rows, cases):
        got = (row.llm_positive, row.llm_negative, row.llm_neutral, row.llm_label, row.llm_confidence, row.llm_score)
        assert got == want, answer
    assert rows[-1].llm_error == "not a number: llm_score"


def share(p, n, u, **rest):
    return json.dumps({"positive": p, "negative": n, "neutral": u, "relevance": 0.5, "impact_magnitude": 0.1, "uncertainty": 0.2, **rest})


def test_strict_answers(spark):
    cases = [
        (share(0.5, 0.3, 0.2), "positive", None),
        (share(0.5, 0.3, 0.21), "positive", None),
        (share(0.5, 0.3, 0.22), None, "shares do not sum to 1"),
        (share(0.5, 0.3, 0.17), None, "shares do not sum to 1"),
        (share(0.4, 0.4, 0.2), "positive", None),
        (share(0.3, 0.35, 0.35), "negative", None),
        (share(1.4, -0.4, 0.0), None, "range: positive"),
        (share(0.5, 0.3, 0.2, uncertainty=None), None, "range: uncertainty"),
        ("text " + share(0.5, 0.3, 0.2), None, "no JSON object"),
        (None, None, "no JSON object"),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(cases)], "i int, a string")
    rows = A.add_answer(df, A.strict_answer(F.col("a"))).orderBy("i").collect()
    assert [(r.llm_label, r.llm_error) for r in rows] == [(l, e) for _, l, e in cases]


def test_filter_on_error_stays_small(spark):
    df = spark.createDataFrame([("t", a) for a in ANSWERS], "t string, a string")
    out = A.add_answer(df, A.float_answer(F.col("t"), F.col("a"))).filter("llm_error is not null")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") <= 16 and out.count() > 3


def test_classifier_columns(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0],), ([0.0, 0.0, 1.0],)], "l array<double>")
    a, b = df.select(*A.classifier_columns(F.col("l"))).collect()
    assert (a.finbert_label, a.finbert_score, a.finbert_confidence) == ("positive", 0.0, 0.5)
    assert b.finbert_label == "neutral" and b.finbert_neutral == pytest.approx(math.e / (math.e + 2))


def test_unknown_label_is_null(spark):
    rows = spark.createDataFrame([("BULLISH",), ("odd",), (None,)], "x string").select(label_score(F.col("x"))).collect()
    assert [r[0] for r in rows] == [1.0, None, None]


def load_picky():
    def score(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[float(len(t))] for t in texts]

    return score


def test_one_bad_row_does_not_spoil_its_batch(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(10)], "i int, t string")
    rows = score_texts(df, "t", load_picky, "s", "array<double>", batch_size=4, partitions=2).orderBy("i").collect()
    assert rows[3].s is None and "bad text" in rows[3].score_error
    assert [r.s for r in rows if r.i != 3] == [[float(i)] for i in range(10) if i != 3]
    assert all(r.score_error is None for r in rows if r.i != 3)


def load_measured():
    import tracemalloc

    tracemalloc.start()

    def score(texts):
        held = float(tracemalloc.get_traced_memory()[1])
        if texts[-1].startswith("end"):
            tracemalloc.stop()
        return [[held]] * len(texts)

    return score


def test_only_a_few_batches_are_python_objects(spark):
    """Three Arrow batches of 8 MB, four times that as strings: a task never holds all strings of one."""
    rows = spark.range(6000, numPartitions=1).select("id", F.when(F.col("id") == 5999, "end").otherwise(F.concat(F.lit("\U0001f600"), F.col("id"), F.repeat(F.lit("texts "), 680))).alias("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    try:
        out = score_texts(rows, "t", load_measured, "s", "array<double>").agg(F.count("*"), F.count("s"), F.max(F.col("s")[0])).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out[0] == out[1] == 6000 and out[2] < 28e6


def load_odd():
    import numpy as np

    made = [{"a": 1, "b": [[1.0], []]}, Row(a=2, b=np.eye(2)), None, {"a": None, "b": None}]

    def score(texts):
        return [made[len(t)] for t in texts]

    return score


def test_results_of_other_types(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(4)], "i int, t string").coalesce(1)
    rows = score_texts(df, "t", load_odd, "s", "struct<a: int, b: array<array<double>>>").orderBy("i").collect()
    assert [r.score_error for r in rows] == [None] * 4
    assert [r.s and (r.s.a, r.s.b) for r in rows] == [(1, [[1.0], []]), (2, [[1.0, 0.0], [0.0, 1.0]]), None, (None, None)]
