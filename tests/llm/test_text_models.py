"""Toxicity, language, quality and language-model scoring: definitions, odd rows, held-out accuracy."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tidewire.llm import attention_lm, language, quality_forest, toxicity

from .conftest import prose, written

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
INSULTS = ("idiot", "stupid", "worthless")


@pytest.fixture(scope="module")
def insulted(spark, tmp_path_factory):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(600):
        words = prose(rng, words=40).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), "en", f"src{i % 3}"))
        marks.append((i, 1, int(toxic)))
    docs = written(spark, rows, tmp_path_factory.mktemp("toxic") / "documents.parquet")
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {m[0]: m[2] for m in marks}


@pytest.fixture(scope="module")
def toxic_model(insulted):
    return toxicity.train(*insulted[:2])


def test_hidden_insults_are_restored(toxic_model):
    for hidden, plain in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooot", "idiot"), ("$tup1d", "stupid"), ("w0rthless", "worthless")):
        assert toxicity.decode(hidden, toxic_model.chars) == plain
        assert toxic_model.score(f"the inth {hidden} of erti") >= toxicity.THRESHOLD
    assert toxic_model.score("ering an i d i o t theth") >= toxicity.THRESHOLD
    assert toxic_model.score("") < toxicity.THRESHOLD


@pytest.mark.parametrize("gap", [" ", " - ", "   ", "\t", "\n", ".", " * ", "\u2022", " / "])
def test_hidden_insults_anywhere_in_a_run(toxic_model, gap):
    clean = "ntherininreothereinatinthreoninatre" * 3
    assert toxic_model.score(gap.join(clean)) < toxicity.THRESHOLD
    for place in (0, 20, 63, 64, 65, len(clean)):
        run = gap.join(clean[:place] + "idiot" + clean[place:])
        assert toxic_model.score(run) >= toxicity.THRESHOLD, (gap, place)
        assert toxic_model.score(f"the inth ({run}) erti") >= toxicity.THRESHOLD, (gap, place)
    # Every distinct word counts, the same one only once.
    assert len(toxic_model._run(" ".join("idiotinthworthlessreonstupidinidiot"))) == len(INSULTS)


def test_long_tokens_are_decoded(toxic_model):
    assert toxicity.decode("id" + "i" * 300 + "ot", toxic_model.chars) == "idiot"
    for token in ("id" + "i" * 300 + "ot", "i" + "." * 80 + "d.i.o.t", ".".join(["inth", "erti"] * 10 + ["idiot"] + ["reon"] * 10)):
        assert toxic_model.score(f"the inth {token} of erti") >= toxicity.THRESHOLD


def test_hidden_tokens_and_runs_by_definition():
    former = r"[^\W\d_].*[^\w\s].*[^\W\d_]|[^\W\d_].*\d|\d.*[^\W\d_]|[@$!|+€£¡(<].*[^\W\d_]|(\w)\1\1"
    rng = random.Random(3)
    for _ in range(20_000):
        token = "".join(rng.choices("abéß1²7_.-@!(<|漢", k=rng.randint(1, 7)))
        assert toxicity.hidden(token) == bool(re.search(former, token)), token
    for text in ("ab cd ef", "a b", "the i of", "a. bc d. ef g"):
        assert not toxicity.SPACED.findall(text)
    assert toxicity.SPACED.findall("an i d i o t! it") == ["i d i o t"]


def test_held_out_toxicity(insulted, toxic_model):
    docs, _, truth = insulted
    found = toxicity.scores(docs, toxic_model).collect()
    assert len(found) == 600 and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if crc32(str(r.id).encode()) % 4 == 2]
    assert np.mean([(r.score >= toxicity.THRESHOLD) == bool(truth[r.id]) for r in held]) > 0.97


def test_toxicity_of_odd_rows(docs, no_docs, labels, no_labels, rows):
    for marks in (labels, no_labels):
        model = toxicity.train(docs, marks)
        assert toxicity.scores(docs, model).count() == len(rows)
        assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.scores(no_docs, toxicity.train(no_docs, labels)).count() == 0


def test_viterbi_equals_all_paths():
    rng = random.Random(2)
    languages = ["a", "b", "c"]
    model = language.Model(languages, np.zeros((1 << language.BUCKET_BITS, 3)), np.ones((1 + len(language.SCRIPTS), 3), bool))
    words = [f"w{chr(97 + i)}" for i in range(6)]
    model.known = {w: i for i, w in enumerate(words)}
    model.scores = np.array([[rng.uniform(-20, 0) for _ in languages] for _ in words])
    model.letters = np.ones(6, int)
    texts = [" ".join(rng.choices(words, k=n)) for n in (5, 1, 0, 4)]

    def cost(text, path):
        score = sum(model.scores[model.known[w], s] for w, s in zip(text.split(), path, strict=True))
        return score - language.SWITCH_PENALTY * sum(a != b for a, b in zip(path, path[1:], strict=False))

    from itertools import product

    for text, (path, _) in zip(texts, model.paths(texts), strict=True):
        n = len(text.split())
        assert len(path) == n
        if n:
            best = max(cost(text, p) for p in product(range(3), repeat=n))
            assert cost(text, path.tolist()) == pytest.approx(best)


def test_scripts():
    names = ["none", *language.SCRIPTS]
    assert [names[language.script_of(w)] for w in ("abc", "текст", "漢字", "12", "ελ", "שלום", "é")] == ["latin", "cyrillic", "han", "none", "greek", "hebrew", "latin"]


def test_language_held_out_and_spans(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = [(i, prose(rng, ("en", "de", "fr")[i % 3], 50), ("en", "de", "fr")[i % 3], "s") for i in range(450)]
    docs = written(spark, rows, tmp_path_factory.mktemp("lang") / "documents.parquet")
    model = language.train(docs)
    found = {r.id: r for r in language.detect(docs, model).collect()}
    held = [i for i in range(450) if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([found[i].lang == rows[i][2] for i in held]) > 0.97
    mixed = prose(rng, "en", 40) + " " + prose(rng, "fr", 40)
    lang, score, spans = model.predict([mixed])[0]
    assert [s[0] for s in spans] == ["en", "fr"] and abs(spans[0][2] - 40) <= 3 and 0.3 < score < 0.7
    # A script of one language leaves no other candidate.
    assert language.UNKNOWN == model.predict(["12 !!"])[0][0]


def test_language_of_odd_rows(docs, no_docs, rows):
    found = language.detect(docs, language.train(docs)).collect()
    assert len(found) == len(rows)
    by = {r.id: r for r in found}
    for i in (100, 101, 102, 109, 113):
        assert (by[i].lang, by[i].score, by[i].spans) == ("und", 0.0, [])
    assert all(0 <= r.score <= 1 for r in found)
    empty = language.train(no_docs)
    assert language.detect(no_docs, empty).count() == 0
    assert {r.lang for r in language.detect(docs, empty).collect()} == {"und"}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_words(words):
    words = [w.encode() for w in words]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    assert quality_forest.repeated_words(words) == len(covered)


def test_statistics_by_definition():
    text = "Ab c#d\nx y\n\n \nx y\nx y\n% é|"
    base, _ = quality_forest.statistics(text.encode())
    assert base == [10, 14, 3, 2, 0]
    assert quality_forest.statistics(b"")[0] == [0, 0, 0, 0, 0]


def test_quality_of_odd_rows(docs, no_docs, labels, no_labels, rows):
    for marks in (labels, no_labels):
        found = quality_forest.judge(docs, marks).collect()
        assert len(found) == len(rows)
        for r in found:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert quality_forest.judge(no_docs, labels).count() == 0


def test_thresholds_catch_junk(spark, tmp_path_factory):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(500):
        words = prose(rng, words=50).split()
        junk = i % 10 == 0
        rows.append((i, " ".join(w + "%%%" if junk else w for w in words), "en", "s"))
        marks.append((i, int(not junk), 0))
    docs = written(spark, rows, tmp_path_factory.mktemp("junk") / "documents.parquet")
    found = quality_forest.judge(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert not any(r.kept for r in found if r.id % 10 == 0)
    assert np.mean([r.kept for r in found if r.id % 10]) > 0.98


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    bigrams = attention_lm.Bigrams.from_counts(rng.poisson(1, (attention_lm.VOCABULARY,) * 2).astype(float))
    texts = [rng.integers(0, 40, n).astype(np.uint16) for n in (40, 3, 17)]
    before, inputs, targets, _ = attention_lm.blocks_of(texts)
    w = attention_lm.Weights.start()
    for a in w.arrays()[-3:]:
        a += rng.normal(0, 0.3, a.shape).astype(np.float32)
    loss = lambda: attention_lm.gradients(w, bigrams, before, inputs, targets)[0]
    _, grads = attention_lm.gradients(w, bigrams, before, inputs, targets)
    for a, g in zip(w.arrays(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = a[at]
        a[at] = kept + 0.01
        high = loss()
        a[at] = kept - 0.01
        low = loss()
        a[at] = kept
        assert (high - low) / 0.02 == pytest.approx(g[at], rel=0.15, abs=1e-4)


def test_probabilities_add_up_and_look_back_only():
    rng = np.random.default_rng(1)
    w = attention_lm.Weights.start()
    for a in w.arrays():
        a += rng.normal(0, 0.2, a.shape).astype(np.float32)
    bigrams = attention_lm.Bigrams.from_counts(rng.poisson(1, (attention_lm.VOCABULARY,) * 2).astype(float))
    text = rng.integers(0, attention_lm.VOCABULARY, 37).astype(np.uint16)

    def logs(ids):
        before, inputs, targets, _ = attention_lm.blocks_of([ids])
        place = np.zeros(targets.size)
        valid = np.flatnonzero(targets.ravel() != attention_lm.PAD)
        order = np.argsort((targets.ravel()[valid] // attention_lm.MEMBERS).astype(np.uint8), kind="stable")
        place[valid[order]] = attention_lm.log_probabilities(w, bigrams, before, inputs, targets)[1]
        return place[: len(ids)]

    first = logs(text)
    changed = text.copy()
    changed[20] = (changed[20] + 1) % attention_lm.VOCABULARY
    assert np.allclose(first[:20], logs(changed)[:20], atol=1e-5) and not np.allclose(first[21:], logs(changed)[21:], atol=1e-5)
    total = 0.0
    for last in range(attention_lm.VOCABULARY):
        other = text[:18].copy()
        other[17] = last
        total += math.exp(logs(other)[17])
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_scores_equal_brute_force(docs, no_docs, rows):
    found = attention_lm.score(docs, RANKS).collect()
    assert len(found) == len(rows)
    words = [((t or "").encode().lower().split(), i) for i, t, *_ in rows]
    trained = [w for w, i in words if crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    counts = Counter(x for w in trained for x in w)
    n = sum(counts.values()) + len(trained)
    size = n + 0.5 * (len(counts) + 2)
    want = sorted(
        (len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(sum(math.log10((counts[x] + 0.5) / size) for x in w) + math.log10((len(trained) + 0.5) / size), 4))
        for w, _ in words
    )
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want
    assert all(r.score < 0 for r in found)
    assert attention_lm.score(no_docs, RANKS).count() == 0


def test_attention_learns(tmp_path_factory, spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, ("en", "de")[i % 2], 300), "en", "s") for i in range(300)]
    docs = written(spark, rows, tmp_path_factory.mktemp("lm") / "documents.parquet")
    gathered = attention_lm.gather(docs, RANKS, "doc_id", "text")
    model = attention_lm.train(gathered)
    plain = attention_lm.Model(attention_lm.Weights.start(), model.bigrams)
    held = [attention_lm.subword_ids(RANKS)(t.encode().lower().split()) for i, t, *_ in rows if crc32(str(i).encode()) % 5 == 1]
    assert model.score(held).sum() > plain.score(held).sum()


def test_attention_trains_on_every_block(docs, rows):
    gathered = attention_lm.gather(docs, RANKS, "doc_id", "text").where("kind = 'texts'").collect()
    ids_of = attention_lm.subword_ids(RANKS)
    want = Counter()
    for i, t, *_ in rows:
        if crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            blocks = np.stack(attention_lm.blocks_of([ids_of((t or "").encode().lower().split())])[:3], axis=1)
            want.update(b.astype(np.int32).tobytes() for b in blocks)
    got = Counter(b.tobytes() for r in gathered for b in attention_lm.training_blocks(r.ids))
    assert got == want
