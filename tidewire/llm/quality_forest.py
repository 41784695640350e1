"""Quality rules and an isolation forest over their statistics.

One pass takes the statistics of every text. Random trees, grown on a bounded sample, split the
ranges of statistics at random; a text that few splits set apart from the rest is anomalous. One
forest splits over all statistics, so that its paths tell rare combinations; beside it stands one
for each statistic, as junk of one kind is common enough to look ordinary among all statistics
together, but stands out in the one it spoils. The anomaly above which a text is rejected is set
by labelled rows, one threshold per forest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.text import BLANKS, drawn, map_batches, raw_text, split_words
from tidewire.session import materialise

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
# The base rules (fixed values): fewest words, and most words in repeated windows per hundred.
LEAST_WORDS, MOST_REPEATED = 20, 30
TREES, SAMPLE_PER_TREE = 100, 256
# The forest over all statistics needs deeper trees to tell combinations.
JOINT_TREES, JOINT_SAMPLE = 100, 1024
# About so many rows the forests grow on, drawn by a hash.
SAMPLE_ROWS = 20_000
# The share of good labelled rows that the thresholds may reject together, and how many times the
# share of good rows that of bad rows must be.
GOOD_LOST, LIFT = 0.01, 5.0
BINS = 2000
SEED = 20240229
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = UPPER + UPPER.lower()
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def without(text: bytes, dropped: bytes) -> int:
    return len(text.translate(None, dropped))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more in the text, first included.

    Windows are named exactly: words become integers, then neighbouring names are paired up by
    doubling, so that no hash takes part.
    """
    if len(words) < window + 1:
        return 0
    index: dict[bytes, int] = {}
    names = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(index) == len(words):
        return 0
    span = 1
    while span < window:
        step = min(span, window - span)
        pairs = names[:-step] * np.int64(len(words) + 1) + names[step:]
        names = np.unique(pairs, return_inverse=True)[1]
        span += step
    counts = np.bincount(names)
    starts = np.flatnonzero(counts[names] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The base counts of one text, and the numbers that the forest splits on."""
    words = split_words(text)
    chars = without(text, BLANKS + CONTINUATION)
    symbols = len(text) - without(text, SYMBOLS)
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    repeats = 0
    for line in lines:
        if line.strip(BLANKS):
            repeats += line in seen
            seen.add(line)
    again = repeated_words(words)
    n = len(words)
    base = [n, chars, symbols, repeats, again]
    if not n:
        return base, [0.0] * 8
    upper, letters = len(text) - without(text, UPPER), len(text) - without(text, LETTERS)
    marks = chars - (without(text, BLANKS + CONTINUATION + b"!?.,;:'\"()[]{}-_/\\+=~^`@"))
    ratios = [
        symbols / chars,
        marks / chars,
        upper / max(letters, 1),
        repeats / (len(seen) + repeats),
        again / n,
        # Words that follow themselves, and mean length of a word.
        sum(map(bytes.__eq__, words, words[1:])) / n,
        min(chars / n, 40.0),
        len(set(words)) / n ** 0.75,
    ]
    return base, ratios


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, mark, id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratios) per row.

    ``mark`` is a hash of id and text, by which samples are drawn.
    """

    def counted(cols: dict[str, list]) -> dict[str, list]:
        found = [statistics(t) for t in cols["bytes"]]
        out = {name: [base[i] for base, _ in found] for i, name in enumerate(BASE)}
        return {"row": cols["row"], "mark": cols["mark"], "id": cols["id"], **out, "ratios": [r for _, r in found]}

    mark = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), mark.alias("mark"), F.col(id_col).alias("id"), raw_text(text_col).alias("bytes"))
    kinds = ", ".join(f"{name} long" for name in BASE)
    return map_batches(rows, counted, f"row long, mark long, id {rows.schema['id'].dataType.simpleString()}, {kinds}, ratios array<double>")


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points in a random binary tree."""
    n = np.maximum(np.asarray(n, float), 1.0)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / n, np.where(n > 1, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), cut, left child (right is next), path at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    path: np.ndarray
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): 2 to the power of minus the mean path over the expected one."""
        total = np.zeros(len(x))
        for feature, cut, child, path in zip(self.feature, self.cut, self.child, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = child[node] + (x[inner, feature[node]] >= cut[node])
            total += path[at]
        norm = float(expected_path(self.sample)) or 1.0
        return 2.0 ** (-total / len(self.feature) / norm)


def grow(x: np.ndarray, trees: int = TREES, per_tree: int = SAMPLE_PER_TREE, seed: int = SEED) -> Forest:
    """A forest over the rows of ``x``; every tree gets ``per_tree`` of them and its own splits."""
    rng = np.random.default_rng(seed)
    per_tree = min(per_tree, len(x))
    depth = max(1, int(np.ceil(np.log2(max(per_tree, 2)))))
    size = 2 * per_tree + 1
    arrays = [np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size), int), np.zeros((trees, size))]
    for t in range(trees):
        feature, cut, child, path = (a[t] for a in arrays)
        todo, used = [(0, rng.choice(len(x), per_tree, replace=False), 0)], 1
        while todo:
            node, rows, level = todo.pop()
            part = x[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if level >= depth or not len(open_):
                path[node] = level + float(expected_path(len(rows)))
                continue
            f = int(rng.choice(open_))
            # A uniform cut above the smallest value leaves rows on both sides.
            value = high[f] - rng.random() * (high[f] - low[f])
            right = part[:, f] >= value
            feature[node], cut[node], child[node] = f, value, used
            todo += [(used, rows[~right], level + 1), (used + 1, rows[right], level + 1)]
            used += 2
    return Forest(*arrays, per_tree)


def grow_all(x: np.ndarray) -> list[Forest]:
    """A forest per column, and one more over all columns together."""
    width = x.shape[1]
    return [*(grow(x[:, [i]], seed=SEED + i) for i in range(width)), grow(x, JOINT_TREES, JOINT_SAMPLE, SEED + width)]


def forest_scores(stats: DataFrame, forests: list[Forest]) -> DataFrame:
    """``stats`` without ratios, with an array ``anomalies``: one number per forest, as ``grow_all`` has them."""

    def scored(cols: dict[str, list]) -> dict[str, list]:
        x = np.array(cols.pop("ratios"), float).reshape(len(cols["row"]), -1)
        found = [forest.scores(x[:, [i]]) for i, forest in enumerate(forests[:-1])]
        found = np.stack([*found, forests[-1].scores(x)], axis=1)
        return {**cols, "anomalies": list(found)}

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields if f.name != "ratios")
    return map_batches(stats, scored, f"{kinds}, anomalies array<double>", slice_rows=8192)


def thresholds(scored: DataFrame, labels: DataFrame, id_col: str, label_col: str, good_lost: float = GOOD_LOST) -> list[float]:
    """Per forest the anomaly from which rows are rejected, from all labelled rows.

    A label that is there several times counts once; a row with labels of both kinds counts for
    both. Each forest may reject an equal part of ``good_lost`` of the good rows. Of the thresholds
    that keep to it, and reject a share of bad rows ``LIFT`` times that of good ones, the one that
    rejects most bad rows; 1, which rejects nothing, if there is none. Counts come from ``BINS``
    bins of the anomaly, whose upper edges are the thresholds tried.
    """
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("key is not null and label in (0, 1)").distinct()
    each = scored.join(known, F.col("id") == F.col("key")).select("label", F.posexplode("anomalies").alias("statistic", "anomaly"))
    bins = each.groupBy("statistic", F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), "label").count().collect()
    number = 1 + max((r.statistic for r in bins), default=-1)
    counts = np.zeros((number, 2, BINS + 1))
    for r in bins:
        counts[r.statistic, r.label, min(r.bin, BINS)] += r["count"]
    out = []
    for of_one in counts:
        if not of_one.sum(axis=1).all():
            out.append(1.0)
            continue
        good, bad = (1 - np.cumsum(of_one[label]) / of_one[label].sum() for label in (1, 0))
        caught = np.where((good <= good_lost / number) & (bad >= LIFT * good), bad, 0.0)
        best = int(caught.argmax())
        out.append((best + 1) / BINS if caught[best] > 1e-9 else 1.0)
    return out


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    good_lost: float = GOOD_LOST,
) -> DataFrame:
    """(row, id, base counts, base_failed, anomaly, kept) per row of ``docs``.

    A row fails the base rules with fewer than 20 words, or with more than 30 of 100 words in
    repeated windows of 8 words. Rows that pass are kept unless the anomaly of a forest reaches its
    threshold; ``anomaly`` is the largest of a row. The forests grow on about ``SAMPLE_ROWS``
    rows that pass, drawn by a hash of id and text, so that other file splits change nothing; all
    else covers every row. NULL text has no words. Repeated rows are judged alike. An empty table
    gives an empty result.
    """
    stats = materialise(document_statistics(docs, id_col, text_col), "rule-statistics")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    passing = stats.where(~failed)
    rate = SAMPLE_ROWS / max(passing.count(), 1)
    sample = passing.where(drawn("mark", "forest") < rate).select("mark", "ratios").collect()
    x = np.array([r.ratios for r in sorted(sample)], float)
    if not len(x):
        return stats.drop("ratios", "mark").withColumn("anomaly", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    forests = grow_all(x)
    scored = materialise(forest_scores(stats.drop("mark"), forests), "anomalies")
    limits = thresholds(scored.where(~F.col("base_failed")), labels, id_col, label_col, good_lost)
    limits = F.array(*map(F.lit, limits or [1.0] * len(forests)))
    odd = F.exists(F.arrays_zip(F.col("anomalies").alias("a"), limits.alias("l")), lambda z: (z["l"] < 1) & (z["a"] >= z["l"]))
    return scored.withColumn("kept", ~F.col("base_failed") & ~odd).withColumn("anomaly", F.array_max("anomalies")).drop("anomalies")
