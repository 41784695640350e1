"""Shallot clustering, licence templates and runs, each against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidewire.llm import license_templates as licences, periodic_runs as runs, shallot
from tidewire.session import written_so_far

# --- clustering ---


def plain_kmeans(rows, k, rounds):
    """(id, vec) -> centroids and (id, cluster, distance), every distance worked out."""
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
    centroids = [list(v) for _, v in rows[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        told = [near(v)[1] for _, v in rows]
        for i in range(len(centroids)):
            mine = [v for (_, v), t in zip(rows, told) if t == i]
            if mine:
                centroids[i] = [sum(column) // len(mine) for column in zip(*mine)]
    return centroids, [(key, near(v)[1], near(v)[0]) for key, v in rows]


def clustered(spark, rows, dims, k, rounds):
    frame = spark.createDataFrame([(i, [float(x) / 256 for x in v], 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    return shallot.cluster(frame.repartition(3), dims=dims, clusters=k, rounds=rounds).collect()


@pytest.mark.parametrize("dims, spread, n, k", [(4, 3, 300, 12), (6, 40, 200, 9), (2, 100_000, 120, 7), (3, 5, 5, 8), (3, 5, 30, 1)])
def test_clusters_equal_plain_kmeans(spark, dims, spread, n, k):
    rng = random.Random(n + k)
    rows = [(i, [rng.randint(-spread, spread) for _ in range(dims)]) for i in range(n)]
    rows += [(7, rows[3][1]), (7, rows[4][1]), (None, rows[0][1])]
    centroids, want = plain_kmeans(rows, k, 5)
    before = written_so_far()
    got = clustered(spark, rows, dims, k, 5)
    assert written_so_far() == before + 1
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.inertia == sum(d for _, _, d in want)
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_bounds_save_distances():
    """After a small move most rows are settled without a search, and no result changes."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (20, 8))
    rows = (centres[rng.integers(0, 20, 3000)] + rng.integers(-9, 9, (3000, 8))).astype(np.int64)
    ball = shallot.Ball(centres.astype(np.int64))
    near, second = np.zeros(3000, np.int32), np.ones(3000, np.int32)
    upper, lower = np.full(3000, np.inf), np.zeros(3000)
    assert ball.settle(rows, near, second, upper, lower) == 3000
    moved = shallot.Ball((centres + 1).astype(np.int64))
    upper, lower = shallot.loosened(near, upper, lower, np.full(20, 8**0.5))
    assert moved.settle(rows, near, second, upper, lower) < 300
    distances = ((rows[:, None] - moved.centroids[None]) ** 2).sum(axis=2)
    assert (near == distances.argmin(axis=1)).all()


def test_vectors_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [1e9, 0.0]), (8, [-1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = {r.id: r.vec for r in shallot.integer_vectors(frame, "vec_id", "embedding", 2).collect()}
    assert kept == {1: [128, -1], 8: [-256, 512]}
    assert shallot.cluster(frame.where("vec_id = 2"), dims=2).collect() == []
    assert shallot.cluster(frame.limit(0), dims=2).columns == shallot.cluster(frame, dims=2).columns


# --- licences ---


def plain_matches(parts, words, i):
    """Ends of all matches of a template's parts that start at word ``i``."""
    if not parts:
        return {i}
    head, rest = parts[0], parts[1:]
    if isinstance(head, licences.Optional):
        starts = plain_matches(head.parts, words, i) | {i}
    elif isinstance(head, licences.Region):
        starts = set(range(i + head.least, min(i + head.most, len(words)) + 1))
    else:
        starts = {i + 1} if i < len(words) and words[i] == head else set()
    return {end for s in starts for end in plain_matches(rest, words, s)}


MARKED = (
    "a b <<beginOptional>>c <<beginOptional>>d<<endOptional>> a<<endOptional>> b",
    "<<beginOptional>>c <<var;words=0..2>><<endOptional>> a <<var;words=1..3>> d",
    "d d <<var;words=0..1>> <<beginOptional>>a<<endOptional>>",
)


@given(st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 30))
@settings(max_examples=300, deadline=None)
def test_automaton_equals_backtracking(words, chunk):
    templates = [("a", "b"), *(licences.parse(t) for t in MARKED)]
    want = []
    busy = [0] * len(templates)
    for i in range(len(words)):
        for number, parts in enumerate(templates):
            ends = plain_matches(parts, words, i)
            if ends and (number < 1 or busy[number] <= i):
                want.append((number, i, max(ends)))
                busy[number] = max(ends)
    n, got = licences.scan_text(licences.Automaton(templates), " ".join(words).encode(), 1, chunk)
    assert n == len(words) and sorted(got) == sorted(want)
    for number, parts in enumerate(templates):
        line = "".join(f" {w}" for w in words) + " "
        assert bool(re.search(licences.as_pattern(parts) + " ", line)) == any(t == number for t, _, _ in got)


@pytest.mark.parametrize("bad", ["a <<beginOptional>>b", "a <<endOptional>>", "a <<var;words=3..2>>", "<<var;words=0..2>> a", "<<beginOptional>>a<<endOptional>>"])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        licences.Automaton([licences.parse(bad)])


def test_states_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(licences, "MOST_STATES", 3)
    automaton = licences.Automaton([licences.parse(MARKED[1])])
    assert licences.scan_text(automaton, b"c x a y z d " * 50, 0)[1] == [(0, 6 * i, 6 * i + 6) for i in range(50)]


def test_licence_wording(spark):
    mit = next(t for label, t in licences.TEMPLATES if label == "mit-text")
    full = re.sub("<<[^>]*>>", " ", mit)
    texts = [
        "Released under the MIT License.",
        "x é This file is licensed under the Apache License, Version 2.0. CC-BY",
        full.upper(),
        full.replace("the software to deal", "to deal").replace("merge", "sell"),
        full.replace("the software to deal", "to deal"),
        "gnu general public license " * 3,
        None,
        "",
        "é" * 50_000 + " mit license",
    ]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.id: r for r in licences.scan(frame).collect()}
    assert [got[i].labels for i in range(9)] == ["mit,mit-notice", "apache,apache-2.0-notice,cc-by", "mit-text", "", "mit-text", "gpl", "", "", "mit"]
    assert (got[0].base_labels, got[0].whole, got[0].spans, got[0].score) == ("mit", True, "mit-notice:0:5", 5 / 9)
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].whole) == (2, 8, 13, False)
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (3, 0, 8)
    assert (got[6].n_words, got[6].n_base, got[6].first_word, got[6].score, got[6].labels) == (0, 0, None, 0.0, "")
    assert (got[8].n_words, got[8].first_word) == (3, 1)


def test_chunks_are_whole_words():
    text = ("Ab" * 20 + " c, d-É " + "ü" * 9 + "\t") .encode() * 3
    for chunk in range(1, 60):
        assert [w for part in licences.word_chunks(text, chunk) for w in part] == text.translate(licences._FOLD).split()


# --- runs ---


def plain_runs(words, least):
    """Every period tried at every place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("least", [12, 5, 4, 2])
def test_runs_equal_plain_search(least):
    rng = random.Random(least)
    for _ in range(120):
        texts = [fibonacci(rng.randint(0, 90)), [0] * rng.randint(0, 40), [i % 7 for i in range(rng.randint(0, 60))]]
        for _ in range(3):
            letters = rng.choice([1, 2, 3, 30])
            made = [rng.randrange(letters) for _ in range(rng.randint(0, 70))]
            texts.append(runs.planted(made, rng.randrange(400)))
        got = runs.runs_of([np.array(t, dtype=np.int64) for t in texts], least)
        assert got == [plain_runs(t, least) for t in texts]


def test_very_long_repetition():
    n = 300_000
    words = np.r_[np.zeros(n, np.int64), np.arange(n) % 1000, np.arange(n)]
    assert runs.runs_of([words]) == [[(0, n + 1, 1), (n, n + 1000, 1000)]]


def plain_row(key, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if key is None else str(key).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, 12)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    thousandths = 1000 * best[1] // best[2] if found else None
    return (key, len(found), *best, thousandths, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_query_rows_equal_plain_version(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(runs, "BATCH_WORDS", 150)
    small = [r for r in rows if len(r[1] or "") < 5_000] + [(i, "a b  c\t" * (i % 9) + "x y", None, None) for i in range(200, 260)]
    frame = spark.createDataFrame([(r[0], r[1], 0) for r in small], "doc_id long, text string, period int")
    key = lambda r: tuple((v is not None, v) for v in r)
    got = sorted((tuple(r) for r in runs.detect(frame, change=runs.planted).collect()), key=key)
    assert got == sorted((plain_row(r[0], r[1]) for r in small), key=key)


def test_odd_rows(docs, no_docs, rows):
    for operator in (runs.detect, licences.scan):
        assert operator(docs).count() == len(rows) and operator(no_docs).count() == 0
