"""From a model's raw answer to sentiment columns.

Parsing uses the VARIANT type, so an answer is read once per row inside the JVM. A strict parse
is one where nothing follows the value: ``[text]`` must be a one-element list and ``{"v":text}``
a one-key object, both at once, because the parser alone ignores trailing text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a missing field of a float-scale answer stands for.
FLOAT_DEFAULTS = {
    "llm_positive": 0.0,
    "llm_negative": 0.0,
    "llm_neutral": 1.0,
    "llm_confidence": 0.0,
    "llm_score": 0.0,
    "llm_relevance": 0.0,
    "llm_impact_magnitude": 0.0,
    "llm_uncertainty": 1.0,
}
LABELS = ("positive", "negative", "neutral")
PROBABILITY_FIELDS = (
    "positive",
    "negative",
    "neutral",
    "relevance",
    "impact_magnitude",
    "uncertainty",
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often it is used there.

    Plain nesting would repeat the parse for each field, and again in every filter the optimizer
    pushes down.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def strict_json(text: Column) -> Column:
    """The text's JSON value as a VARIANT, NULL unless the whole text is one JSON value."""

    def parse(t: Column) -> Column:
        return F.struct(
            F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))).alias("listed"),
            F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}"))).alias("keyed"),
        )

    def only_value(p: Column) -> Column:
        alone = p["keyed"].isNotNull() & _at(p["listed"], "$[1]", "variant").isNull()
        return F.when(alone, _at(p["listed"], "$[0]", "variant"))

    return _let(text, lambda t: _let(parse(t), only_value))


def outer_braces(text: Column) -> Column:
    """First ``{`` through last ``}``; empty where there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def rescued_json(text: Column) -> Column:
    """The whole text, else what lies between the outer braces; NULL when neither parses."""
    return _let(text, lambda t: F.coalesce(strict_json(t), strict_json(outer_braces(t))))


def json_kind(value: Column) -> Column:
    """OBJECT, ARRAY or another type name; NULL without a value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _is_object(value: Column) -> Column:
    return F.coalesce(json_kind(value) == "OBJECT", F.lit(False))


def _numbers(v: Column, names: Sequence[str]) -> Column:
    """Struct: per field its number, and ``bad``: the first field that is there but is none."""
    fields = [_at(v, f"$.{n}", "double").alias(n) for n in names]
    bad = [
        F.when(
            _at(v, f"$.{n}", "double").isNull() & _at(v, f"$.{n}", "variant").isNotNull(), F.lit(n)
        )
        for n in names
    ]
    return F.struct(
        *fields,
        F.coalesce(*bad).alias("bad"),
        _label(v).alias("label"),
        _is_object(v).alias("is_object"),
    )


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _label(value: Column) -> Column:
    text = F.lower(F.trim(_at(value, "$.llm_label", "string")))
    return F.when(text.isin(*LABELS), text).otherwise(F.lit("neutral"))


ORDER = (
    "llm_positive",
    "llm_negative",
    "llm_neutral",
    "llm_label",
    "llm_confidence",
    "llm_score",
    "llm_relevance",
    "llm_impact_magnitude",
    "llm_uncertainty",
    "llm_error",
)


def _answer(fields: dict[str, Column], label: Column, error: Column) -> Column:
    every = {**fields, "llm_label": label, "llm_error": error}
    kinds = {"llm_label": "string", "llm_error": "string"}
    return F.struct(*[every[n].cast(kinds.get(n, "double")).alias(n) for n in ORDER])


def _fixed_answer(confidence: float, uncertainty: float, error: Column) -> Column:
    fields = {n: F.lit(0.0) for n in FLOAT_DEFAULTS}
    fields |= {
        "llm_neutral": F.lit(1.0),
        "llm_confidence": F.lit(confidence),
        "llm_uncertainty": F.lit(uncertainty),
    }
    return _answer(fields, F.lit("neutral"), error)


def blank_answer() -> Column:
    """The answer for an empty article (sure that there is nothing)."""
    return _fixed_answer(1.0, 0.0, F.lit(None))


def fallback_answer(error: Column) -> Column:
    """The answer for a row that failed, with the reason."""
    return _fixed_answer(0.0, 1.0, error)


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def float_answer(news_text: Column, answer: Column) -> Column:
    """X19 + X22: float-scale answer, clamped; ``llm_error`` tells why a row fell back.

    A missing field takes its default. A field that is there but is no number (also JSON null)
    fails the row.
    """

    def good(n: Column) -> Column:
        fields = {
            x: _clamp(F.coalesce(n[x], F.lit(d)), -1.0 if x == "llm_score" else 0.0, 1.0)
            for x, d in FLOAT_DEFAULTS.items()
        }
        error = F.when(~n["is_object"], F.lit("no JSON object")).otherwise(
            F.concat(F.lit("not a number: "), n["bad"])
        )
        return F.when(error.isNotNull(), fallback_answer(error)).otherwise(
            _answer(fields, n["label"], F.lit(None))
        )

    read = _let(
        rescued_json(answer), lambda v: _let(_numbers(v, list(FLOAT_DEFAULTS)), good)
    )
    return F.when(is_blank(news_text), blank_answer()).otherwise(read)


def integer_answer(answer: Column) -> Column:
    """Score -5..5 and confidence 1..10 brought to unit scale, shares derived from the score.

    An answer without readable JSON counts as score 0 and confidence 0. A field that is there
    but is no number makes the row a reject: all columns NULL but ``llm_error``.
    """

    def scale(n: Column) -> Column:
        def unit(name: str, full: float, low: float) -> Column:
            raw = F.coalesce(n[name], F.lit(0.0)) / full
            return F.when(n["bad"].isNull(), F.bround(_clamp(raw, low, 1.0), 2))

        return F.struct(
            unit("llm_score", 5.0, -1.0).alias("score"),
            unit("llm_confidence", 10.0, 0.0).alias("conf"),
            n["bad"].alias("bad"),
            n["label"].alias("label"),
        )

    def shares(u: Column) -> Column:
        score, conf, ok = u["score"], u["conf"], u["bad"].isNull()
        size = F.abs(score)
        fields = {
            "llm_positive": F.when(score > 0.2, size).when(ok, 0.0),
            "llm_negative": F.when(score < -0.2, size).when(ok, 0.0),
            "llm_neutral": F.bround(1.0 - size, 2),
            "llm_confidence": conf,
            "llm_score": score,
            "llm_relevance": F.when(ok, 0.9),
            "llm_impact_magnitude": size,
            "llm_uncertainty": F.bround(1.0 - conf, 2),
        }
        error = F.concat(F.lit("not a number: "), u["bad"])
        return _answer(fields, F.when(ok, u["label"]), error)

    names = ("llm_score", "llm_confidence")
    return _let(
        strict_json(outer_braces(answer)),
        lambda v: _let(
            F.when(_is_object(v), v),
            lambda o: _let(_numbers(o, names), lambda n: _let(scale(n), shares)),
        ),
    )


def strict_answer(answer: Column, tolerance: float = 0.02) -> Column:
    """Six probabilities, all needed, in [0,1]; the three shares sum to 1 within tolerance.

    Label is the largest share (ties: positive, negative, neutral). A row that breaks a rule has
    NULL columns and the rule's name in ``llm_error``.
    """

    def judge(n: Column) -> Column:
        outside = F.coalesce(
            *[
                F.when(n[x].isNull() | ~n[x].between(0.0, 1.0), F.lit(f"range: {x}"))
                for x in PROBABILITY_FIELDS
            ]
        )
        total = n["positive"] + n["negative"] + n["neutral"]
        error = (
            F.when(~n["is_object"], F.lit("no JSON object"))
            .when(outside.isNotNull(), outside)
            .when(F.abs(total - 1.0) > tolerance, F.lit("shares do not sum to 1"))
        )
        top = F.greatest(n["positive"], n["negative"], n["neutral"])
        label = F.coalesce(*[F.when(n[x] == top, F.lit(x)) for x in LABELS])
        fields = {f"llm_{x}": n[x] for x in PROBABILITY_FIELDS}
        fields |= {"llm_confidence": top, "llm_score": n["positive"] - n["negative"]}
        valid = _answer(fields, label, F.lit(None))
        nothing = {x: F.lit(None) for x in fields}
        return F.when(error.isNull(), valid).otherwise(_answer(nothing, F.lit(None), error))

    return _let(strict_json(answer), lambda v: _let(_numbers(v, PROBABILITY_FIELDS), judge))


def add_answer(df: DataFrame, answer: Column) -> DataFrame:
    """Add one of the answer structs above as columns."""
    return df.withColumn("_answer", answer).select(*df.columns, "_answer.*")


def classifier_columns(logits: Column, labels: tuple[str, ...] = LABELS) -> list[Column]:
    """Softmax over class logits, one column per label, plus label, confidence and score.

    ``labels`` gives the class order of the model that made the logits.
    """
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    share = {name: powers[i] / total for i, name in enumerate(labels)}
    best = F.greatest(*share.values())
    label = F.coalesce(*[F.when(share[name] == best, F.lit(name)) for name in labels])
    return [
        *[share[name].alias(f"finbert_{name}") for name in labels],
        label.alias("finbert_label"),
        best.alias("finbert_confidence"),
        (share["positive"] - share["negative"]).alias("finbert_score"),
    ]
