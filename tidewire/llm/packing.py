"""Best-fit packing of token sequences with a bounded number of open bins.

Documents are tokenised and cut only where longer than a sequence. Pieces arrive one after the
other, in the order of the documents, at a packer with a fixed number of open bins, whose free spaces are the set bits of one
integer: the tightest bin that takes a piece is found with two bit operations, and when every bin
is open and none takes it, the fullest bin closes. Each task packs its own share; the bins still
open at its end are packed again as wholes with those of other tasks, in rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.text import fold_ascii, map_batches, raw_text, split_words
from tidewire.session import materialise

CAPACITY = 4096
OPEN_BINS = 1024
END_ID = 1
# Tasks whose open bins meet in one task of the next round.
FAN_IN = 16
# Words whose ids a worker keeps; beyond this it starts anew.
CACHED_WORDS = 1_200_000
ENCODED_TOGETHER = 2048
MARKS = b".,;:!?"
# Scripts up to here are settled in every version of Unicode that the libraries may follow.
LAST_PLAIN = "\u2000"
# Sequences that one task of the first round makes, about.
TASK_SEQUENCES = 16_384
# A bin's number: the round, 24 bits for the task, 32 bits inside the task.
ROUND_SHIFT, TASK_SHIFT = 56, 32


class WordIds:
    """Ids of whole texts, word by word, as little-endian unsigned 32-bit bytes.

    Fits tokenizers that drop white space, never let a token cross it and mark the end of a word in
    its last token (``word_bpe_49k``): the ids of a text are those of its words one after the
    other. Letters and the marks that close a word are separate words to the tokenizer. Words of
    lower-case letters in composed form pass its normaliser unchanged, so they go to the same
    model without it, many at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _plain(word: str) -> bool:
        return word.isalpha() and max(word) < LAST_PLAIN and word.lower() == word and is_normalized("NFC", word)

    def _learn(self, words: set[bytes]) -> None:
        heads = {w: w.rstrip(MARKS) for w in words}
        known = self.known
        fresh = {w: str(w, "utf-8", "replace") for w in {*heads.values(), b""} if w not in known}
        letters = [w for w, s in fresh.items() if self._plain(s)]
        for at in range(0, len(letters), ENCODED_TOGETHER):
            part = letters[at : at + ENCODED_TOGETHER]
            line = " ".join([fresh[w] for w in part])
            ids = np.array(self.letters.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            raw = ids.tobytes()
            starts = [0, *stops.tolist()[:-1]]
            known.update(zip(part, [raw[a:b] for a, b in zip(starts, stops.tolist(), strict=True)], strict=True))
        composed = {w: w[len(head) :] for w, head in heads.items() if head in known and head != w}
        rest = [w for w in {*words, *composed.values()} if w not in composed and w not in known]
        found = self.whole.encode_batch_fast([str(w, "utf-8", "replace") for w in rest], add_special_tokens=False)
        known.update((w, np.array(encoded.ids, "<u4").tobytes()) for w, encoded in zip(rest, found, strict=True))
        known.update([(w, known[heads[w]] + known[tail]) for w, tail in composed.items()])

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        # The tokenizer folds case itself; folding first only shortens the list of words. Special
        # tokens are matched before that, so texts that may hold one stay as they are.
        split = [split_words(t if b"<|" in t else fold_ascii(t)) for t in texts]
        self._learn(set().union(*split).difference(self.known))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


@cache
def word_ids(path: str) -> WordIds:
    """The reader of one file; a Python worker keeps it, with the words it knows, between tasks."""
    return WordIds(path)


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """(row, id, piece, start, length, ids_crc32) per piece; every document ends with ``end_id``.

    Only documents of more than ``capacity`` ids are cut, into pieces of ``capacity`` ids; the
    last may be shorter. NULL text counts as empty and is the end id alone. A very long text is one
    row in and as many pieces out as it needs; its ids are held in memory at once, four bytes each.
    """

    class Cut:
        @staticmethod
        def per_task():
            ids_of = word_ids(tokenizer_path)
            end = np.array([end_id], "<u4").tobytes()

            def cut(cols: dict[str, list]) -> dict[str, list]:
                out: dict[str, list] = {c: [] for c in ("row", "id", "piece", "start", "length", "ids_crc32")}
                for row, key, ids in zip(cols["row"], cols["id"], ids_of(cols["bytes"]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        values = (row, key, piece, at // 4, len(part) // 4, zlib.crc32(part))
                        for name, value in zip(out, values, strict=True):
                            out[name].append(value)
                return out

            return cut

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), raw_text(text_col).alias("bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, Cut, f"row long, id {kind}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Open bins by free space, with the set of free spaces that occur as bits of one integer."""

    def __init__(self, limit: int):
        self.limit, self.count, self.free = limit, 0, 0
        self.by_space: dict[int, list[int]] = {}

    def _put(self, bin_id: int, space: int) -> None:
        self.by_space.setdefault(space, []).append(bin_id)
        self.free |= 1 << space
        self.count += 1

    def _take(self, space: int) -> int:
        stack = self.by_space[space]
        bin_id = stack.pop()
        if not stack:
            del self.by_space[space]
            self.free ^= 1 << space
        self.count -= 1
        return bin_id

    def place(self, length: int, new_id: int, capacity: int) -> tuple[int, int, int | None]:
        """(bin, offset in it, closed bin or None). A bin that is full closes by itself."""
        fits = self.free >> length
        closed = None
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(space)
        else:
            if self.count >= self.limit:
                closed = self._take((self.free & -self.free).bit_length() - 1)
            bin_id, space = new_id, capacity
        if space > length:
            self._put(bin_id, space - length)
        return bin_id, capacity - space, closed


def _packer(limit: int, capacity: int, tag: int):
    """Task function: (item, length) in, (item, bin, offset, fill) out.

    A row with NULL item gives a bin that was still open at the end of the task, with its fill.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item", "bin", "offset", "fill"]
        kinds = [pa.int64()] * 4
        base = (tag << ROUND_SHIFT) | (TaskContext.get().partitionId() << TASK_SHIFT)
        bins, made = OpenBins(limit), 0
        for batch in batches:
            into, offsets = [], []
            for length in batch.column("length").to_pylist():
                bin_id, offset, _ = bins.place(length, base + made, capacity)
                made += bin_id == base + made
                into.append(bin_id)
                offsets.append(offset)
            cols = [batch.column("item"), into, offsets, [None] * len(into)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        rest = [(b, capacity - space) for space, ids in sorted(bins.by_space.items()) for b in ids]
        cols = [[None] * len(rest), [b for b, _ in rest], [None] * len(rest), [f for _, f in rest]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def _round(items: DataFrame, tasks: int, limit: int, capacity: int, tag: int) -> DataFrame:
    dealt = items.select("item", "length").repartition(tasks, F.xxhash64("item", F.lit(tag)))
    # The order of arrival, whichever way the shuffle brings the rows: lengths are not known ahead.
    dealt = dealt.sortWithinPartitions("item")
    packed = dealt.mapInArrow(_packer(limit, capacity, tag), "item long, bin long, offset long, fill long")
    return materialise(packed, f"bins-{tag}")


def pack(items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, fan_in: int = FAN_IN) -> DataFrame:
    """(item, bin, offset) for items (item long unique, length long in 1..capacity).

    Items are dealt to tasks by a hash, so that each task sees a mixture of lengths, and no key
    of the data decides the size of a task; in a task they come in their order. A task holds
    ``open_bins`` bins whatever its input: where all are open and none takes an item, the fullest
    closes for good.
    Bins left open by one round are the items of the next, with ``fan_in`` times fewer tasks,
    until one task is left; that one gets at most ``fan_in * open_bins`` rows. Nothing is dropped:
    bins of the last round stay as they are.
    """
    source = items.select("item", "length")
    total = source.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, round(total / capacity / TASK_SEQUENCES))
    placed, tag = None, 1
    while True:
        packed = _round(source, tasks, open_bins, capacity, tag)
        inside = packed.where("item is not null").select("item", "bin", "offset")
        if placed is None:
            placed = inside
        else:
            # What lay in a bin moves with it.
            moved = inside.select(F.col("item").alias("bin"), F.col("bin").alias("outer"), F.col("offset").alias("shift"))
            placed = placed.join(moved, "bin", "left").select(
                "item", F.coalesce("outer", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
            )
        if tasks == 1:
            return placed
        source = packed.where("item is null").select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        tasks, tag = -(-tasks // fan_in), tag + 1


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
) -> DataFrame:
    """Pieces with sequence_id and offset: every token of every document in some sequence once.

    Pieces as long as a sequence are one by themselves. Repeated rows are packed once each. An
    empty table gives an empty result.
    """
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, capacity)
    pieces = materialise(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.where(F.col("length") < capacity), capacity, open_bins)
    full = pieces.where(F.col("length") >= capacity).select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("offset"))
    at = full.unionByName(placed)
    return pieces.join(at, "item").select(
        "row", "id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )
