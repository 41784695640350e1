"""Decoding against all paths, character counts of the whole corpus, slices by bytes, the joint forest."""

import itertools
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from tidewire.llm import quality_forest, text, toxicity

from .conftest import prose, written


def all_paths(token, model):
    """The best score of any way to read a token, and every string that has it."""
    best, found = -np.inf, set()
    for ways in itertools.product(*toxicity.lattice(token)):
        letters = "".join(letter for letter, _ in ways)
        padded = " " * (toxicity.GRAM - 1) + letters + " "
        score = -sum(cost for _, cost in ways)
        score += sum(model.log(padded[i : i + toxicity.GRAM - 1], padded[i + toxicity.GRAM - 1]) for i in range(len(letters) + 1))
        if score > best + 1e-9:
            best, found = score, {letters}
        elif abs(score - best) <= 1e-9:
            found.add(letters)
    return found


def test_decode_equals_all_paths():
    rng = random.Random(3)
    counts = Counter()
    for _ in range(60):
        for word in prose(rng, words=20).split():
            counts.update(toxicity.grams(word.strip(".")))
    model = toxicity.CharModel(dict(counts))
    symbols = "abeilost" + "01345678@$!|+" + ".-_"
    for _ in range(400):
        token = "".join(rng.choice(symbols) for _ in range(rng.randint(1, 9)))
        if rng.random() < 0.4:
            at = rng.randrange(len(token))
            token = token[:at] + token[at] * rng.randint(1, 3) + token[at:]
        assert toxicity.decode(token, model) in all_paths(token, model), token


def test_many_marks_keep_states_bounded():
    """All paths of a long token of ambiguous symbols are followed: no beam, and time in its length."""
    model = toxicity.CharModel(dict(Counter(toxicity.grams("battle") + toxicity.grams("list"))))
    assert len(toxicity.decode("a" + "!|+$@" * 60 + "b", model)) > 1
    assert toxicity.decode("l!$t" + "." * 300, model) == "list"


def test_character_model_counts_every_row(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [(i, prose(rng, words=30) + " Zebra, zebra!", "en", "s") for i in range(200)] + [(900, None, None, None), (None, "nulls here", None, None)]
    docs = written(spark, rows, tmp_path / "documents.parquet")
    monkeypatch.setattr(toxicity, "COUNTED_WORDS", 50)
    want = Counter()
    for i, t, *_ in rows:
        if crc32(b"" if i is None else str(i).encode()) % toxicity.FOLDS != toxicity.HELD_OUT:
            for word in {w.strip(toxicity.MARKS) for w in (t or "").lower().split()}:
                if word.isalpha():
                    want.update(toxicity.grams(word))
    assert toxicity.character_model(docs, "doc_id", "text").counts == dict(want)
    monkeypatch.setattr(toxicity, "RAREST_GRAM", 300)
    pruned = toxicity.character_model(docs, "doc_id", "text")
    kept = pruned.counts
    for size in range(1, toxicity.GRAM + 1):
        of_size = {g: n for g, n in want.items() if len(g) == size}
        least = -(-sum(of_size.values()) // 300)
        assert {g: n for g, n in kept.items() if len(g) == size} == {g: n for g, n in of_size.items() if n >= least}
        assert sum(len(g) == size for g in kept) <= 300
        # Contexts know what they have lost.
        for g in {g[:-1] for g in kept}:
            assert pruned.lost.get(g, 0) == sum(n for x, n in want.items() if x[:-1] == g and x not in kept)
    full = toxicity.CharModel(dict(want))
    letters = sorted({g for g in want if len(g) == 1})
    logs = lambda model, word: [model.log((" " * 3 + word)[i : i + 3], (word + " ")[i]) for i in range(len(word) + 1)]
    words = [w.strip(".") for w in prose(rng, words=200).split()]
    means = [np.mean([x for w in words for x in logs(model, w)]) for model in (full, pruned)]
    # The error measured: three hundred n-grams of each length instead of all cost this much per letter.
    assert means[0] - means[1] < 0.6
    # Over the letters there are, probabilities of a context add up to one, but for letters never seen.
    for context in ("  t", "her", "zeb", "qqq"):
        assert 0.5 < sum(np.exp(pruned.log(context, x)) for x in letters) < 1.3


@pytest.mark.parametrize("rows, limit", [(3, 10), (100, 10), (100, 1), (2, 10**6)])
def test_slices_are_bounded_by_rows_and_bytes(monkeypatch, rows, limit):
    monkeypatch.setattr(text, "SLICE_BYTES", limit)
    sizes = [0, 3, 50, 2, 2, 2, 9, 0, 0, None, 1]
    batch = pa.RecordBatch.from_arrays([pa.array([None if n is None else b"x" * n for n in sizes], pa.binary()), pa.array(range(len(sizes)))], names=["bytes", "row"])
    cuts = list(text.slices_of(batch, rows))
    assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and cuts[0][0] == 0 and cuts[-1][1] == len(sizes)
    for a, b in cuts:
        assert b - a <= rows and (b - a == 1 or sum(n or 0 for n in sizes[a:b]) <= limit)
    assert list(text.slices_of(batch.slice(0, 0), rows)) == []


def test_joint_forest_finds_what_no_single_statistic_shows():
    """Two statistics go together; rows that break the tie are ordinary in each of them."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=4000)
    x = np.c_[a, a + rng.normal(scale=0.05, size=4000), rng.normal(size=4000)]
    x[:40, 0], x[:40, 1] = rng.uniform(1.0, 1.5, 40), rng.uniform(-1.5, -1.0, 40)
    forests = quality_forest.grow_all(x)
    assert len(forests) == 4
    joint = forests[-1].scores(x)
    singles = [forest.scores(x[:, [i]]) for i, forest in enumerate(forests[:-1])]
    cut = np.quantile(joint[40:], 0.95)
    assert (joint[:40] > cut).mean() > 0.4
    assert all((s[:40] > np.quantile(s[40:], 0.95)).mean() < 0.2 for s in singles)


def test_verdicts_do_not_depend_on_file_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality_forest, "SAMPLE_ROWS", 60)
    rng = random.Random(12)
    rows = [(i, prose(rng, words=40) + (" ####" * 9 if i % 9 == 0 else ""), "en", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(200)] * 2, "doc_id long, quality int, toxic int")
    docs = written(spark, rows, tmp_path / "documents.parquet")
    one, other = (
        {r.id: (r.kept, r.anomaly) for r in quality_forest.judge(spark.read.parquet(str(tmp_path / n)), labels).collect()}
        for n in ("documents.parquet", "other") if n != "other" or docs.repartition(7).write.parquet(str(tmp_path / n)) is None
    )
    assert one == other and not all(kept for kept, _ in one.values())
