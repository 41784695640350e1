"""Toxicity of texts that hide their words: decode first, then score.

Writers hide insults as leetspeak (``1d10t``), with blanks or marks between letters (``i d i o t``,
``i.d.i.o.t``) or by repetition (``idiooot``). Each such token is read as the output of a noisy
channel: a lattice says which letters every symbol may stand for, which symbols may stand for
nothing and which repeats may be one letter, and a Viterbi search picks the most likely letters
under a character language model. The restored words, and how they begin, are looked up in a
lexicon of weighted features learned from labelled rows, and a logistic model turns what is found
into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.text import drawn, keep_rows, map_batches, raw_text, remainder
from tidewire.session import materialise

THRESHOLD = 0.3
# Rows whose id's crc32 leaves this remainder are held out.
FOLDS, HELD_OUT = 4, 2
# The bounded sample of labelled rows: about so many of each label, drawn by a hash of the id.
ROWS_PER_LABEL = 6000
# The lexicon's features have evidence beyond chance by this margin (as a log), where features with
# fewer rows than this are not counted as tried.
MARGIN, LEAST_ROWS = 3.0, 4
PREFIXES = (4, 5, 6)
GRAM = 4
# n-grams rarer than one in so many of their length are not kept: fewer than so many are, whatever
# the corpus. The weight of the rarer ones goes to shorter contexts.
RAREST_GRAM = 200_000
# Different words that a task counts before it hands them on.
COUNTED_WORDS = 400_000
# Numbers that ``summary`` gives.
SUMMARY = 6
CACHED_WORDS = 400_000
# Letters that a symbol may stand for (fixed values: common substitutions).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i",
}
# Log costs of the channel: a symbol for a letter, a mark dropped inside a word or at its ends,
# a repeated letter dropped, a third or later repeat kept.
SUBSTITUTED, DROPPED_INSIDE, DROPPED_AT_END, COLLAPSED, DRAWN_OUT = 1.0, 1.5, 0.1, 0.2, 3.0
MARKS = ".,;:!?\"'()[]{}<>|*#%&$_-~`/\\=+^@"
# Single letters, or symbols for them, with any run of blanks or marks between.
LETTER, SYMBOLS = r"[^\W\d_]", "@$!|+€£¡"
SINGLE = rf"(?:[^\W_]|[{SYMBOLS}])"
GAP = r"[\s_.,;:?'\"*%&#~^=/\\()\[\]{}<>`\-\xa7\xa8\xab\xac\xad\xaf\xb0\xb4\xb6\xb7\xb8\xbb\xbf\u2000-\u206f\u3000-\u3003\ufeff]"
SPACED = re.compile(rf"(?<![^\W_])(?<![{SYMBOLS}]){SINGLE}(?:{GAP}++{SINGLE}(?![^\W_]|[@$|+€£¡])){{2,}}+")
GAPS, PIECES = re.compile(rf"{GAP}+"), re.compile(r"(?:[^\w\s]|_)+")
FIRST, MARK, DIGIT, SYMBOL, DRAWN = re.compile(LETTER), re.compile(r"[^\w\s]"), re.compile(r"\d"), re.compile(rf"[{SYMBOLS}(<]"), re.compile(r"(\w)\1\1")


def hidden(token: str) -> bool:
    """Whether a token may hide a word: marks between letters, letters and digits, a symbol before letters, a drawn-out letter."""
    first = None if token.isalpha() else FIRST.search(token)
    if first:
        last = len(token) - 1 - FIRST.search(token[::-1]).start()
        if MARK.search(token, first.end(), last) or DIGIT.search(token) or SYMBOL.search(token, 0, last):
            return True
    return DRAWN.search(token) is not None


@dataclass
class CharModel:
    """Interpolated character n-grams, up to ``GRAM`` letters, words padded with blanks.

    ``lost`` says how often a context went on with a letter whose n-gram is not kept; that much
    weight goes to the shorter context.
    """

    counts: dict[str, int]
    lost: dict[str, int] = field(default_factory=dict)
    letters: int = field(init=False)
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        # Counts of contexts, and how many different letters follow, per n-gram length.
        self.totals: dict[str, int] = Counter()
        self.kinds: dict[str, int] = Counter()
        for gram, n in self.counts.items():
            self.totals[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1
        self.letters = max(30, self.kinds.get("", 0))

    def log(self, context: str, letter: str) -> float:
        key = context + letter
        if key not in self.cache:
            p = 1.0 / self.letters
            for at in range(len(context), -1, -1):
                left = context[at:]
                total = self.totals.get(left, 0)
                if total:
                    spare = self.kinds[left] + self.lost.get(left, 0)
                    p = (self.counts.get(left + letter, 0) + spare * p) / (total + spare)
            self.cache[key] = math.log(p)
        return self.cache[key]


def grams(word: str) -> list[str]:
    """All n-grams of 1 to ``GRAM`` letters of a padded word that end in one of its letters or its end."""
    padded = " " * (GRAM - 1) + word + " "
    ends = range(GRAM - 1, len(padded))
    return [padded[end - n : end + 1] for end in ends for n in range(GRAM)]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each symbol the strings it may stand for (one letter or nothing) with log costs."""
    out = []
    body = token.strip(MARKS)
    first = token.find(body) if body else 0
    last = first + len(body)
    for i, c in enumerate(token):
        inside = first <= i < last
        ways = [(c, 0.0)] if c.isalpha() else []
        ways += [(x, SUBSTITUTED) for x in LEET.get(c, "")]
        if not c.isalnum():
            ways.append(("", DROPPED_INSIDE if inside else DROPPED_AT_END))
        if not ways:
            ways = [(c, 0.0)]
        if i and c == token[i - 1] and c.isalpha():
            # A third letter in a row is rarely meant.
            drawn = i > 1 and token[i - 2] == c
            ways = [(c, DRAWN_OUT if drawn else 0.0), ("", COLLAPSED)]
        out.append(ways)
    return out


def decode(token: str, model: CharModel) -> str:
    """The likeliest letters behind a token (Viterbi over the last ``GRAM - 1`` letters).

    All states are kept: they are strings of letters that symbols of the token may stand for, so
    their number does not grow with the token, and few tokens have more than a dozen.
    """
    start = " " * (GRAM - 1)
    # Letters so far are a chain (chain before, letter), so that time grows with the length only.
    best: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
    for ways in lattice(token):
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, chain) in best.items():
            for letter, cost in ways:
                to = state[1:] + letter if letter else state
                here = score - cost + model.log(state, letter) if letter else score - cost
                if to not in after or here > after[to][0]:
                    after[to] = (here, (chain, letter) if letter else chain)
        best = after
    # Every path also pays for the end of the word.
    _, chain = max(((score + model.log(state, " "), chain) for state, (score, chain) in best.items()), key=lambda x: x[0])
    out = []
    while chain:
        chain, letter = chain
        out.append(letter)
    return "".join(reversed(out))


def features(word: str) -> list[str]:
    """The word itself and its beginnings, the latter marked with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    """Everything a task needs: the character model, the lexicon and the logistic weights."""

    chars: CharModel
    lexicon: dict[str, tuple[float, float]]
    weights: list[float]
    words: dict[str, tuple[float, ...]] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.lengths = sorted({len(f) for f in self.lexicon if not f.endswith("*") and len(f) > 2})

    def _weights(self, token: str) -> tuple[float, ...]:
        """Weights of the words behind a token, remembered by token."""
        word = token.strip(MARKS)
        if hidden(token):
            found = {}
            # Words with marks between are looked up one by one if the whole is no word.
            whole = decode(token, self.chars)
            for piece in [whole] if self._best(whole)[1] else PIECES.split(word):
                best = self._best(piece if piece is whole else decode(piece, self.chars) if hidden(piece) else piece)
                if best[1]:
                    found.setdefault(best[2], best[1])
            weights = tuple(found.values())
        else:
            best = self._best(word)
            weights = (best[1],) if best[1] else ()
        self.words[token] = weights
        return weights

    def _best(self, word: str) -> tuple[float, float, str]:
        """Evidence, weight and name of the feature of a word that the labelled rows say most about."""
        return max(((*self.lexicon[f], f) for f in features(word) if f in self.lexicon), default=(0.0, 0.0, ""), key=lambda x: x[:2])

    def _inside(self, letters: str) -> dict[str, float]:
        """Weights, by how they begin, of the words of the lexicon in letters without borders.

        Of those that overlap the one with most evidence counts.
        """
        found = []
        for at in range(len(letters) - 2):
            ends = [(at + n, letters[at : at + n]) for n in self.lengths if at + n <= len(letters)]
            ends += [(at + n, letters[at : at + n] + "*") for n in PREFIXES if at + n < len(letters)]
            found += [(*self.lexicon[f], at, end, f) for end, f in ends if f in self.lexicon]
        taken, out = bytearray(len(letters)), {}
        for _, weight, at, end, f in sorted(found, key=lambda x: (-x[0], x[2], -x[3])):
            if weight and not any(taken[at:end]):
                taken[at:end] = b"\1" * (end - at)
                out.setdefault(f.rstrip("*")[: PREFIXES[0]], weight)
        return out

    def _run(self, run: str) -> list[float]:
        """Weights of the distinct words in a run of single letters: the whole of it, and cut at its wider gaps."""
        gaps = GAPS.findall(run)
        least = min(map(len, gaps))
        letters = GAPS.split(run)
        parts, part = [], letters[0]
        for gap, letter in zip(gaps, letters[1:], strict=True):
            if len(gap) > least:
                parts.append(part)
                part = ""
            part += letter
        parts.append(part)
        found = self._inside(decode("".join(letters), self.chars))
        for part in {p for p in parts if len(p) > 2} if len(parts) > 1 else ():
            for name, weight in self._inside(decode(part, self.chars)).items():
                found.setdefault(name, weight)
        return [found[name] for name in sorted(found)]

    def hits(self, text: str) -> list[float]:
        """Weights of what is in the lexicon: of distinct tokens, and of distinct words in each spaced run."""
        text = text.lower()
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        known, tokens = self.words, set(text.split())
        # Unknown tokens are looked up once; nearly all weigh nothing.
        out = [w for found in map(known.get, tokens) if found for w in found]
        out += [w for found in map(self._weights, [t for t in tokens if t not in known]) for w in found]
        for run in SPACED.findall(text):
            out += self._run(run)
        return out

    def score(self, text: str) -> float:
        return float(1 / (1 + math.exp(-float(np.dot(self.weights, summary(text, self.hits(text)))))))


def summary(text: str, hits: list[float]) -> list[float]:
    """What the logistic model sees: constant, strongest hit, sum of hits, two or more, three or more, length.

    The length only counts beside hits: a long text has more of them by chance.
    """
    length = math.log1p(len(text)) if hits else 0.0
    return [1.0, max(hits, default=0.0), math.log1p(sum(hits)), float(len(hits) > 1), float(len(hits) > 2), length]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights by Newton steps on the ridge-penalised likelihood (the constant is not penalised)."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)]) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> DataFrame:
    """(bytes, label, half) of about ``per_label`` rows per label outside the held-out fold.

    Rows are drawn by a hash of the id at the rate that a label's number of rows sets, so the
    sample is spread over all tasks and never sorted.
    """
    usable = labels.where(remainder(id_col, FOLDS) != HELD_OUT).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label"))
    usable = usable.where("key is not null and label in (0, 1)").distinct()
    sizes = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    rates = [min(1.0, per_label / sizes.get(label, 1)) for label in (0, 1)]
    chosen = usable.where(drawn("key", "toxic") < F.when(F.col("label") == 1, rates[1]).otherwise(rates[0]))
    half = F.pmod(F.xxhash64("key", F.lit("half")), F.lit(2)).cast("int").alias("half")
    texts = docs.select(F.col(id_col).alias("key"), raw_text(text_col).alias("bytes"))
    # About two times per_label rows of an id and a label, whatever the table's size.
    return texts.join(F.broadcast(chosen), "key").select("bytes", "label", half)


def _feature_rows(cols: dict[str, list]) -> dict[str, list]:
    """Each text's distinct features with the word before their first occurrence."""
    out: dict[str, list] = {"feature": [], "label": [], "half": [], "context": []}
    for raw, label, half in zip(cols["bytes"], cols["label"], cols["half"], strict=True):
        words = str(raw, "utf-8", "replace").lower().split()
        first: dict[str, str] = {}
        before = ""
        for token in words:
            word = token.strip(MARKS)
            for f in features(word) if word else ():
                first.setdefault(f, before)
            before = token
        out["feature"] += first
        out["context"] += first.values()
        out["label"] += [label] * len(first)
        out["half"] += [half] * len(first)
    return out


def _lexicon(per_feature: DataFrame, bad: Column, good: Column) -> dict[str, tuple[float, float]]:
    """Features that toxic rows have more often than chance would give any feature: evidence and log odds.

    The evidence of a feature is the log likelihood ratio of its share of toxic rows against the
    share of all features; it must exceed the log of the number of features tried by ``MARGIN``.
    There are no more of them than distinct features in the bounded sample.
    """
    counts = per_feature.select("feature", bad.cast("double").alias("bad"), good.cast("double").alias("good"))
    all_bad, all_good, tried = counts.agg(F.sum("bad"), F.sum("good"), F.count_if(F.col("bad") + F.col("good") >= LEAST_ROWS)).first()
    if not all_bad or not all_good:
        return {}
    share = all_bad / (all_bad + all_good)
    seen = F.col("bad") + F.col("good")
    part = lambda n, p: F.when(n > 0, n * F.log(n / (seen * p))).otherwise(0.0)
    evidence = part(F.col("bad"), share) + part(F.col("good"), 1 - share)
    odds = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - math.log(all_bad / all_good)
    sure = counts.select("feature", evidence.alias("evidence"), odds.alias("weight"))
    sure = sure.where((odds > 0) & (F.col("evidence") > math.log(max(tried, 1)) + MARGIN))
    return {r.feature: (r.evidence, r.weight) for r in sure.orderBy(F.desc("evidence"), "feature").collect()}


class _WordRows:
    """Task function: words of letters, with the number of rows that have each."""

    @staticmethod
    def per_task():
        seen: Counter = Counter()

        def handed() -> dict[str, list]:
            out = {"word": list(seen), "n": list(seen.values())}
            seen.clear()
            return out

        def count(cols: dict[str, list]) -> dict[str, list]:
            for raw in cols["bytes"]:
                seen.update({word for token in set(str(raw, "utf-8", "replace").lower().split()) if (word := token.strip(MARKS)).isalpha()})
            return handed() if len(seen) >= COUNTED_WORDS else {"word": [], "n": []}

        count.finish = handed
        return count


class _GramRows:
    """Task function: n-grams of distinct words, weighted by the words' counts."""

    @staticmethod
    def per_task():
        seen: Counter = Counter()

        def handed() -> dict[str, list]:
            out = {"gram": list(seen), "n": list(seen.values())}
            seen.clear()
            return out

        def count(cols: dict[str, list]) -> dict[str, list]:
            for word, n in zip(cols["word"], cols["n"], strict=True):
                for gram in grams(word):
                    seen[gram] += n
            return handed() if len(seen) >= COUNTED_WORDS else {"gram": [], "n": []}

        count.finish = handed
        return count


def character_model(docs: DataFrame, id_col: str, text_col: str) -> CharModel:
    """Character n-grams of the words of all rows outside the held-out fold; labels take no part.

    Words are added up first, then the n-grams of distinct words, each by the rows that have it. Of
    each length those with at least one in ``RAREST_GRAM`` of all occurrences are kept: a bound on
    what comes to the driver that no corpus size moves.
    """
    rows = docs.where(remainder(id_col, FOLDS) != HELD_OUT).select(raw_text(text_col).alias("bytes"))
    words = map_batches(rows, _WordRows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = map_batches(words, _GramRows, "gram string, n long", slice_rows=8192).groupBy("gram").agg(F.sum("n").alias("n"))
    counted = materialise(counted.withColumn("size", F.length("gram")), "char-grams")
    least = {r.size: -(-r.n // RAREST_GRAM) for r in counted.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    enough = F.element_at(F.create_map(*(F.lit(x) for pair in least.items() for x in pair)), F.col("size")) if least else F.lit(1)
    keeps = F.col("n") >= enough
    context = F.substring(F.col("gram"), F.lit(1), F.col("size") - 1).alias("context")
    lost = counted.groupBy(context).agg(F.sum(F.when(~keeps, F.col("n"))).alias("lost"), F.count_if(keeps).alias("kept"))
    kept = {r.gram: r.n for r in counted.where(keeps).select("gram", "n").collect()}
    return CharModel(kept, {r.context: r.lost for r in lost.where("kept > 0 and lost > 0").collect()})


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = ROWS_PER_LABEL,
) -> Model:
    """Fit on a bounded sample of labelled rows: about ``per_label`` of each label (default 6,000).

    The character model takes no labels and covers all rows outside the held-out fold. A feature counts once per distinct word before it, so that copies of one text, exact or near,
    count once. What comes to the driver is bounded: the sample's telling features, n-grams by
    their share, and ``SUMMARY`` numbers per sampled row. Without rows of both labels every score is the share of label 1
    (one half without any row).
    """
    sample = materialise(labelled_sample(docs, labels, id_col, text_col, label_col, per_label), "toxic-sample")
    chars = character_model(docs, id_col, text_col)
    found = map_batches(sample.select("bytes", "label", "half"), _feature_rows, "feature string, label int, half int, context string")
    per_feature = found.distinct().groupBy("feature").agg(
        *(F.count_if((F.col("label") == label) & (F.col("half") == half)).alias(f"{kind}{half}") for label, kind in ((1, "bad"), (0, "good")) for half in (0, 1))
    )
    per_feature = materialise(per_feature, "toxic-features")
    # The logistic weights are fitted on one half with what the other half's lexicon finds in it,
    # so that they see hits as new rows will have them.
    lexicons = [_lexicon(per_feature, *(F.col(f"{kind}{half}") for kind in ("bad", "good"))) for half in (0, 1)]
    both = _lexicon(per_feature, *(F.col(f"{kind}0") + F.col(f"{kind}1") for kind in ("bad", "good")))
    model = Model(chars, both, [0.0] * SUMMARY)
    crossed = [Model(chars, lexicons[1 - half], [0.0] * SUMMARY) for half in (0, 1)]

    class Seen:
        @staticmethod
        def per_task():
            def seen(cols: dict[str, list]) -> dict[str, list]:
                texts = [(str(t, "utf-8", "replace"), half) for t, half in zip(cols["bytes"], cols["half"], strict=True)]
                return {"x": [summary(t, crossed[half].hits(t)) for t, half in texts], "label": cols["label"]}

            return seen

    rows = map_batches(sample.select("bytes", "label", "half"), Seen, "x array<double>, label int").collect()
    if not rows:
        return model
    # Rows arrive in any order; sums of sorted rows are the same in every run.
    data = np.array(sorted((*r.x, r.label) for r in rows))
    x, y = data[:, :-1], data[:, -1]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    if 0 < y.sum() < len(y):
        model.weights = fit_logistic(x, y).tolist()
    else:
        model.weights = [math.log(share / (1 - share)), *[0.0] * (SUMMARY - 1)]
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, score) per row of ``docs``; whole texts, NULL as empty. One pass, no shuffle.

    An empty text has the score of a text without hits. Repeated rows and equal texts get the same
    score, each row its own; an empty table gives an empty result.
    """

    class Scored:
        @staticmethod
        def per_task():
            def scored(cols: dict[str, list]) -> dict[str, list]:
                found = [model.score(str(t, "utf-8", "replace")) for t in cols["bytes"]]
                return {"row": cols["row"], "id": cols["id"], "score": found}

            return scored

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), raw_text(text_col).alias("bytes"))
    return map_batches(rows, Scored, f"row long, id {rows.schema['id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns.

    A score equal to the threshold goes. Repeated rows stay or go together; an empty table gives
    an empty result.
    """
    clean = scores(docs, model, id_col, text_col).where(F.col("score") < threshold)
    return keep_rows(docs, clean.select("row"))
