"""J7's two rules against plain loops: random titles, crowds, chains, a hot day."""

import datetime as dt
import random
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import near_titles as J
from tidewire.session import written_so_far

DAY = dt.datetime(2024, 5, 1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def similar(a, b):
    longer = max(len(a), len(b))
    # Letters that the other lacks are a lower bound of the distance.
    lacking = max(sum((Counter(a) - Counter(b)).values()), sum((Counter(b) - Counter(a)).values()))
    return lacking * 10 <= longer and distance(a, b) * 10 <= longer


def by_hand(rows, greedy):
    """Rows (id, minute, ticker, title) that stay."""
    out, seen = [], {}
    for i, minute, ticker, title in sorted(rows, key=lambda r: (r[1], r[0])):
        if title is None:
            out.append(i)
            continue
        earlier = seen.setdefault((ticker, minute // 1440), [])
        near = any(similar(title.lower(), other) for other in earlier)
        if not near:
            out.append(i)
        if not near or not greedy:
            earlier.append(title.lower())
    return sorted(out)


def frame(spark, rows):
    made = [(i, DAY + dt.timedelta(minutes=m), t, title) for i, m, t, title in rows]
    return spark.createDataFrame(made, "news_id long, pub_time timestamp_ntz, ticker string, title string")


def edited(rng, title, edits, letters="abcdé \U0001f600"):
    title = list(title)
    for _ in range(edits):
        k = rng.randrange(len(title))
        kind = rng.randrange(3)
        if kind == 0:
            title[k] = rng.choice(letters)
        elif kind == 1:
            title.insert(k, rng.choice(letters))
        elif len(title) > 1:
            del title[k]
    return "".join(title)


@pytest.mark.parametrize("greedy", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_titles(spark, greedy, seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdé \U0001f600") for _ in range(n)) for n in (5, 9, 10, 20, 31, 60, 90)]
    rows = []
    for i in range(160):
        base = rng.choice(bases)
        rows.append((i, rng.randrange(2880), rng.choice("AAAB"), edited(rng, base, rng.randrange(0, max(2, len(base) // 6)))))
    rows += [(1000 + i, 1, "A", "a" * (20 + i % 4)) for i in range(12)] + [(2000, 5, "A", None), (2001, 5, "A", None), (2002, 5, "A", ""), (2003, 6, "A", "")]
    got = sorted(r.news_id for r in J.drop_near_titles(frame(spark, rows), greedy=greedy).collect())
    assert got == by_hand(rows, greedy)


def test_greedy_rounds_on_a_chain_of_random_order(spark):
    """Each title is similar to the next few; rounds, seen by their written tables, stay few."""
    rng = random.Random(3)
    titles = ["a" * (40 - j) + "b" * j for j in range(40)]
    order = rng.sample(range(40), 40)
    rows = [(i, minute, "A", titles[i]) for minute, i in enumerate(order)]
    before = written_so_far()
    got = sorted(r.news_id for r in J.drop_near_titles(frame(spark, rows), greedy=True).collect())
    assert got == by_hand(rows, True) and got != by_hand(rows, False)
    assert written_so_far() - before < 40


@pytest.mark.parametrize("greedy", [False, True])
def test_hot_day(spark, greedy):
    """Six hundred titles of one ticker and day, most with the same opening, a third near copies of one."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(5))
    opening = "breaking news from the markets "
    base = opening + " ".join(word() for _ in range(6))
    rows = []
    for i in range(600):
        title = edited(rng, base, 2, "xyz") if i % 3 == 0 else opening + " ".join(word() for _ in range(6))
        rows.append((i, i % 1440, "A", title))
    pieces = []
    near = J._earlier_pairs
    try:
        J._earlier_pairs = lambda a, b: pieces.append(near(a, b)) or pieces[-1]
        got = sorted(r.news_id for r in J.drop_near_titles(frame(spark, rows), greedy=greedy).collect())
    finally:
        J._earlier_pairs = near
    assert got == by_hand(rows, greedy)
    # Pairs that met in the last step, of 180,000 there are.
    assert all(p.distinct().count() < 9_000 for p in pieces)


def test_pieces_meet_for_similar_titles():
    """The filter's promise: titles that are similar share a piece, whatever counts say is rare."""
    rng = random.Random(5)
    for _ in range(300):
        seen = np.array([rng.randrange(5) for _ in range(64)])
        title = "".join(rng.choice("abc ") for _ in range(rng.randint(9, 80)))
        other = edited(rng, title, rng.randint(1, len(title) // 9), "abcé")
        if similar(title, other) and len(other) >= 9:
            assert set(J.title_pieces(title, seen)) & set(J.title_pieces(other, seen))


def test_check_before_the_distance_loses_no_similar_pair():
    """Titles at the allowed distance pass the check of common grams; unlike ones of one alphabet do not."""
    rng = random.Random(7)
    for _ in range(200):
        title = "".join(rng.choice("abcd \U0001f600") for _ in range(rng.randint(60, 240)))
        other = edited(rng, title, len(title) // 10, "abcé")
        assert not similar(title, other) or J.enough_common(title, other)
    strangers = ["".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(2)]
    assert not J.enough_common(*strangers)


def test_distance_is_limited(spark):
    """Two long unlike titles: a whole table of distances would have 400 million cells a pair."""
    rng = random.Random(8)
    rows = [(i, i, "A", "".join(rng.choice("ab") for _ in range(20_000))) for i in range(2)]
    rows.append((2, 5, "A", edited(rng, rows[0][3], 100, "ab")))
    got = J.drop_near_titles(frame(spark, rows))
    assert sorted(r.news_id for r in got.collect()) == [0, 1]
    met = frame(spark, rows[:1]).select(J.similar_enough(F.col("title"), F.col("title")).alias("same"))
    assert "levenshtein(title#" in met._jdf.queryExecution().analyzed().toString()
    assert "cast(FLOOR" in met._jdf.queryExecution().analyzed().toString()
