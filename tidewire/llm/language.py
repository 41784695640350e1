"""Language of whole texts, and of spans inside them.

Every word gets a score per language from hashed character n-grams. Ranges of code points tell a
word's script, and only languages that use the script are candidates for it. A Viterbi search over
the words of a text, with a penalty for each switch, labels spans; the language with the most
letters is the text's.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.text import drawn, map_batches, raw_text, remainder

FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
# About so many training rows per language (all, where there are fewer).
ROWS_PER_LANGUAGE = 3000
LONGEST_GRAM = 4
BUCKET_BITS = 16
SMOOTHING = 0.5
# What a change of language costs, in natural logs; and a word in a script a language lacks.
SWITCH_PENALTY, FOREIGN_SCRIPT = 10.0, 60.0
# A language uses a script that at least this share of its training words are in.
SCRIPT_SHARE = 0.001
CACHED_WORDS = 300_000
# First code points of runs of one script each (fixed values, from the code charts); script 0 is
# everything without a script of its own.
SCRIPT_STARTS = (
    (0x0000, "none"), (0x0041, "latin"), (0x0250, "latin"), (0x02B0, "none"), (0x0370, "greek"), (0x0400, "cyrillic"),
    (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"),
    (0x0780, "thaana"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"),
    (0x2C60, "latin"), (0x2C80, "none"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3190, "none"),
    (0x3400, "han"), (0xA000, "yi"), (0xA4D0, "none"), (0xA640, "cyrillic"), (0xA6A0, "none"), (0xAC00, "hangul"),
    (0xD7B0, "none"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "none"),
    (0xFE70, "arabic"), (0xFF00, "none"), (0xFF21, "latin"), (0xFF5B, "none"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "none"), (0x20000, "han"), (0x32000, "none"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS} - {"none"})
_STARTS = [at for at, _ in SCRIPT_STARTS]
_SCRIPT_AT = [0 if name == "none" else 1 + SCRIPTS.index(name) for _, name in SCRIPT_STARTS]
MARKS = ".,;:!?\"'()|*#%&$"


@cache
def script_of_letter(letter: str) -> int:
    """Number of a letter's script, 0 if it has none of its own."""
    return int(_SCRIPT_AT[bisect_right(_STARTS, ord(letter)) - 1]) if letter.isalpha() else 0


def script_of(word: str) -> int:
    """Number of the script of a word's first letter that has one; 0 without such a letter."""
    return next(filter(None, map(script_of_letter, word)), 0)


def trimmed(token: str) -> str:
    """A lower-case token from its first letter to its last; empty if it has none."""
    if token.isalpha():
        return token
    token = token.strip(MARKS)
    if token.isalpha():
        return token
    letters = [i for i, c in enumerate(token) if c.isalpha()]
    return token[letters[0] : letters[-1] + 1] if letters else ""


def gram_buckets(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram length: bucket numbers of all n-grams in word order, and their number per word."""
    padded = "".join([f"\x02{w}\x03" for w in words])
    codes = np.frombuffer(padded.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    out, rolled = [], np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        whole = len(codes) - n + 1
        # A polynomial over the code points, spread by an odd multiplier; the top bits count.
        rolled = rolled[:whole] * np.uint64(1_000_003) + codes[n - 1 :] + np.uint64(n)
        inside = owner[:whole] == owner[n - 1 :]
        spread = rolled[inside] * np.uint64(0x9E3779B97F4A7C15)
        out.append(((spread >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.maximum(lengths - n + 1, 0)))
    return out


@dataclass
class Model:
    """Languages in code-point order, log probabilities per bucket and language, scripts in use."""

    languages: list[str]
    table: np.ndarray
    allowed: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)
    letters: np.ndarray | None = field(default=None, repr=False)

    def _learn(self, tokens: list[str]) -> None:
        """Score tokens not seen yet: a row per token, a column per language."""
        words = [trimmed(t) for t in tokens]
        found = np.zeros((len(words), len(self.languages)))
        for buckets, per_word in gram_buckets(words):
            sums = np.zeros((len(buckets) + 1, len(self.languages)))
            np.cumsum(self.table[buckets], axis=0, out=sums[1:])
            stops = np.cumsum(per_word)
            found += sums[stops] - sums[stops - per_word]
        found /= LONGEST_GRAM
        scripts = np.array([script_of(w) for w in words], int)
        found -= FOREIGN_SCRIPT * ~self.allowed[scripts]
        letters = np.array([len(w) for w in words])
        found[letters == 0] = 0.0
        first = 0 if self.scores is None else len(self.scores)
        self.known.update(zip(tokens, range(first, first + len(tokens)), strict=True))
        self.scores = found if self.scores is None else np.concatenate([self.scores, found])
        self.letters = letters if self.letters is None else np.concatenate([self.letters, letters])

    def rows_of(self, texts: list[str]) -> list[np.ndarray]:
        """Row numbers in ``scores`` of each text's tokens."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.scores, self.letters = {}, None, None
        split = [t.lower().split() for t in texts]
        known = self.known
        fresh = [w for w in set().union(*split) if w not in known]
        if fresh:
            self._learn(sorted(fresh))
        return [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in split]

    def paths(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: the language of each token by Viterbi, and each token's number of letters."""
        rows = self.rows_of(texts)
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        lengths = np.array([len(rows[i]) for i in order], int)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int))] * len(rows)
        flat = np.concatenate([rows[i] for i in order]) if rows else np.zeros(0, int)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
        stay = np.empty((len(flat), len(self.languages)), bool)
        come = np.empty(len(flat), np.int16)
        longest = int(lengths[0]) if len(lengths) else 0
        score = np.zeros((len(order), len(self.languages)))
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        # All texts that still have a token go one step together.
        for t in range(longest):
            k = int(active[t])
            here = starts[:k] + t
            best = score[:k].max(axis=1, keepdims=True) - SWITCH_PENALTY
            come[here] = score[:k].argmax(axis=1)
            stay[here] = score[:k] >= best
            score[:k] = np.maximum(score[:k], best) + self.scores[flat[here]]
        path = np.empty(len(flat), np.int16)
        state = score.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            k = int(active[t])
            here = starts[:k] + t
            path[here] = state[:k]
            state[:k] = np.where(stay[here, state[:k]], state[:k], come[here])
        for place, i in enumerate(order):
            part = slice(starts[place], starts[place] + lengths[place])
            out[i] = (path[part], self.letters[flat[part]] if lengths[place] else np.zeros(0, int))
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """Per text: language, share of the letters in it, and spans (language, first, past last word)."""
        if not self.languages:
            return [(UNKNOWN, 0.0, []) for _ in texts]
        out = []
        for path, letters in self.paths(texts):
            total = int(letters.sum())
            if not total:
                out.append((UNKNOWN, 0.0, []))
                continue
            weight = np.bincount(path, letters, len(self.languages))
            best = int(weight.argmax())
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            spans = [(self.languages[path[a]], a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            out.append((self.languages[best], float(weight[best] / total), spans))
        return out


class _GramCounts:
    """Task state: n-gram counts and script counts per language, given out once at the end."""

    def __init__(self):
        self.grams: dict[str, np.ndarray] = {}
        self.scripts: dict[str, np.ndarray] = {}

    def __call__(self, cols: dict[str, list]) -> dict[str, list]:
        for raw, lang in zip(cols["bytes"], cols["lang"], strict=True):
            tokens = [trimmed(t) for t in str(raw, "utf-8", "replace").lower().split()]
            words = [w for w in tokens if w]
            if not words:
                continue
            grams = self.grams.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            for buckets, _ in gram_buckets(words):
                grams += np.bincount(buckets, minlength=1 << BUCKET_BITS)
            scripts = self.scripts.setdefault(lang, np.zeros(1 + len(SCRIPTS), np.int64))
            scripts += np.bincount([script_of(w) for w in words], minlength=1 + len(SCRIPTS))
        return {"lang": [], "kind": [], "slot": [], "n": []}

    def finish(self) -> dict[str, list]:
        out: dict[str, list] = {"lang": [], "kind": [], "slot": [], "n": []}
        for kind, counts in (("gram", self.grams), ("script", self.scripts)):
            for lang, n in counts.items():
                slots = np.flatnonzero(n)
                out["lang"] += [lang] * len(slots)
                out["kind"] += [kind] * len(slots)
                out["slot"] += slots.tolist()
                out["n"] += n[slots].tolist()
        return out


class _CountGrams:
    per_task = _GramCounts


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` rows of each language outside the held-out fold.

    Rows are taken by a hash of the id, at a rate that the language's number of rows sets. The
    counts that come to the driver are bounded by languages x 65,536. No training row gives a model
    that answers ``und``.
    """
    usable = docs.where(remainder(id_col, FOLDS) != HELD_OUT).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = usable.select(F.col(id_col).alias("key"), F.col(lang_col).cast("string").alias("lang"), raw_text(text_col).alias("bytes"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0), bool))
    rates = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_language / n))))
    counts = map_batches(rows.where(drawn("key", "language") < rates[F.col("lang")]).select("lang", "bytes"), _CountGrams, "lang string, kind string, slot int, n long")
    found = counts.groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in found})
    grams = np.full((1 << BUCKET_BITS, len(languages)), SMOOTHING)
    scripts = np.zeros((1 + len(SCRIPTS), len(languages)))
    for r in found:
        (grams if r.kind == "gram" else scripts)[r.slot, languages.index(r.lang)] += r.n
    allowed = scripts >= SCRIPT_SHARE * scripts.sum(axis=0)
    # A script that no language uses narrows nothing.
    allowed |= ~allowed.any(axis=1, keepdims=True)
    allowed[0] = True
    return Model(languages, np.log(grams) - np.log(grams.sum(axis=0)), allowed)


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, lang, score, spans) per row of ``docs``; one pass, no shuffle.

    ``score`` is the share of the letters that lie in spans of ``lang``; ``spans`` has a struct
    (lang, first, last) per span, as word numbers, last excluded. NULL text, or text without a
    letter, is ``und`` with score 0 and no spans. Of languages that tie the first by name is taken.
    Repeated rows and equal texts get the same answer, each row its own; an empty table gives an
    empty result. Texts are taken whole, a few MB of them at a time or one longer text alone.
    """

    class Detected:
        @staticmethod
        def per_task():
            def detected(cols: dict[str, list]) -> dict[str, list]:
                found = model.predict([str(t, "utf-8", "replace") for t in cols["bytes"]])
                spans = [[{"lang": a, "first": b, "last": c} for a, b, c in s] for _, _, s in found]
                return {"row": cols["row"], "id": cols["id"], "lang": [f[0] for f in found], "score": [f[1] for f in found], "spans": spans}

            return detected

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), raw_text(text_col).alias("bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, lang string, score double, spans array<struct<lang:string,first:long,last:long>>"
    return map_batches(rows, Detected, schema, slice_rows=2048)
