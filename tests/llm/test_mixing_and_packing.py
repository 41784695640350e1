"""Source mixing and best-fit packing: targets, sums, round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tidewire.llm import mixing, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def filled(sizes, weights=(5, 2, 1), share=1.5, stop=2):
    """Targets by sharing again and again, as the rule is stated."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if weight[s] * level > stop * sizes[s]]
        if not over:
            return {**fixed, **{s: weight[s] * level for s in free}}
        fixed.update({s: stop * sizes[s] for s in over})


def test_targets_by_repeated_sharing(spark):
    rng = random.Random(3)
    for n in (1, 2, 5, 40):
        sizes = {f"s{i}": rng.choice([0, 5, 100, 10_000]) for i in range(n)} | {None: 77}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys()
        assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_meets_targets(docs, no_docs, rows):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    again = mixing.mix(docs).collect()
    assert sorted((r.row, r.taken) for r in found) == sorted((r.row, r.taken) for r in again)
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    source_of = {i: s for i, _, _, s in rows}
    for r in found:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        key = source_of[r.id]
        taken[key] += r.taken
        target[key] = r.target
        longest[key] = max(longest[key], r.size)
    assert all(abs(taken[k] - target[k]) <= longest[k] for k in taken)
    assert mixing.mix(no_docs).count() == 0


def test_mixed_rows_repeat(docs, no_docs):
    copies = sum(r.copies for r in mixing.mix(docs).collect())
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == copies
    assert mixing.mixed_rows(no_docs).count() == 0


def test_sample_size_is_fixed(spark, tmp_path):
    rows = [(i, "a b c d", f"s{i % 2}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    for seed in range(3):
        found = mixing.mix(spark.read.parquet(str(tmp_path / "d")), seed=seed).collect()
        by = defaultdict(int)
        for r in found:
            by[r.target] += r.taken
        assert all(abs(v - t) <= 2 for t, v in by.items())


def whole_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


WORDS = st.sampled_from(["the", "Idiot.", "it's", "don't", "é", "É,", "éx", "12ab", "a.b,", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "naïve;", "ß", "ΣΑΣ", "漢字", "\U0001f600", "a b", "x" * 300, "I'LL", "İ"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(WORDS, st.text(min_size=1, max_size=12)), max_size=30), st.sampled_from([" ", "\n", "\t\x0b "]))
def test_word_ids_equal_whole_text(words, blank):
    text = blank.join(words).encode("utf-8", "replace").decode()
    got = packing.word_ids(PATH)([text.encode()])[0]
    assert np.frombuffer(got, "<u4").tolist() == whole_ids(text)


def test_pieces_pack_without_gaps(docs, no_docs, rows):
    packed = packing.pack_documents(docs, PATH).collect()
    ids = defaultdict(list)
    for r in packed:
        ids[r.row].append(r)
    assert len(ids) == len(rows)
    want = sorted(whole_ids(t or "") + [1] for _, t, *_ in rows)
    lengths = sorted(sum(p.length for p in pieces) for pieces in ids.values())
    assert lengths == sorted(map(len, want))
    crcs = sorted(p.ids_crc32 for p in packed)
    parts = [w[a : a + 4096] for w in want for a in range(0, len(w), 4096)]
    assert crcs == sorted(zlib.crc32(np.array(p, "<u4").tobytes()) for p in parts)
    for pieces in ids.values():
        pieces.sort(key=lambda p: p.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [p.start for p in pieces] == [4096 * p.piece for p in pieces]
    bins = defaultdict(list)
    for p in packed:
        bins[p.sequence_id].append((p.offset, p.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places[:-1]]).tolist()
        assert sum(n for _, n in places) <= 4096
    assert len(bins) <= -(-sum(map(len, want)) // 4096) + 1
    assert packing.pack_documents(no_docs, PATH).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 8))
def test_open_bins(lengths, limit):
    bins, spaces, made, closed = packing.OpenBins(limit), {}, 0, set()
    for n in lengths:
        tight = min((s for b, s in spaces.items() if s >= n and b not in closed and s), default=None)
        full = min((s for b, s in spaces.items() if b not in closed and s), default=None)
        bin_id, offset, shut = bins.place(n, made, 64)
        if tight is not None:
            assert spaces[bin_id] == tight and offset == 64 - tight
        else:
            assert bin_id == made and offset == 0
            made += 1
            if shut is not None:
                assert spaces[shut] == full
                closed.add(shut)
        spaces[bin_id] = spaces.get(bin_id, 64) - n
        assert bins.count <= limit


def test_rounds_merge_what_is_open(spark):
    items = spark.range(3000).selectExpr("id as item", "1 + id * 7919 % 1500 as length")
    placed = packing.pack(items, open_bins=16).collect()
    assert len(placed) == 3000
    lengths = {r.item: r.length for r in items.collect()}
    fill = defaultdict(int)
    for r in placed:
        fill[r.bin] += lengths[r.item]
    assert max(fill.values()) <= 4096 and len(fill) <= 1.05 * sum(lengths.values()) / 4096


def test_packing_is_online_and_the_bound_binds(spark, monkeypatch):
    """Bins are those of a packer that sees items in their order, and most close because all are open."""
    rng = random.Random(6)
    lengths = [rng.randint(1, 64) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long").repartition(5)
    got = {r.item: (r.bin & 0xFFFFFFFF, r.offset) for r in packing.pack(items, capacity=64, open_bins=20).collect()}
    bins, made, shut, want = packing.OpenBins(20), 0, 0, {}
    for i, n in enumerate(lengths):
        bin_id, offset, closed = bins.place(n, made, 64)
        made += bin_id == made
        shut += closed is not None
        want[i] = (bin_id, offset)
    assert got == want and shut > 200
    # At the size of a task in use, with lengths as documents have them, the default closes bins too.
    bins, made, shut = packing.OpenBins(packing.OPEN_BINS), 0, 0
    for _ in range(40_000):
        bin_id, _, closed = bins.place(min(int(rng.lognormvariate(6, 1)) + 1, 4095), made, 4096)
        made += bin_id == made
        shut += closed is not None
    assert shut > made / 2


def test_inclusion_follows_the_odds(spark, tmp_path):
    """Documents' shares of being taken over many seeds, against odds that meet the target in the mean."""
    sizes = [4, 9, 16, 25, 36, 49] * 20
    rows = [(i, " ".join(["w"] * n), "only") for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    left = 0.5 * sum(sizes)

    def chances(weight):
        low, high = 0.0, 1e6
        for _ in range(200):
            middle = (low + high) / 2
            met = sum(n * middle * weight(n) / (1 + middle * weight(n)) for n in sizes)
            low, high = (middle, high) if met < left else (low, middle)
        return {n: low * weight(n) / (1 + low * weight(n)) for n in set(sizes)}

    for odds, weight in ((mixing.size_odds, lambda n: n**0.5), (lambda size: size * size + 0.0, lambda n: float(n * n)), (lambda size: F.lit(1.0), lambda n: 1.0)):
        more, seeds = defaultdict(int), 12
        for seed in range(seeds):
            found = mixing.mix(docs, seed=seed, share=1.5, odds=odds).collect()
            assert abs(sum(r.taken for r in found) - 1.5 * sum(sizes)) <= 25
            for r in found:
                assert r.copies in (1, 2)
                more[r.size] += r.copies - 1
        for n, chance in chances(weight).items():
            assert more[n] / (20 * seeds) == pytest.approx(chance, abs=0.11), (n, chance)


def test_several_tasks_pack_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_SEQUENCES", 20)
    items = spark.range(2000).selectExpr("id as item", "1 + id * 7919 % 1500 as length")
    placed = packing.pack(items, fan_in=3).collect()
    lengths = {r.item: r.length for r in items.collect()}
    bins = defaultdict(list)
    for r in placed:
        bins[r.bin].append((r.offset, lengths[r.item]))
    assert sum(map(len, bins.values())) == 2000
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places[:-1]]).tolist()
        assert sum(n for _, n in places) <= 4096
