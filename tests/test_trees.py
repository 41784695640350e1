"""Boosted trees against trees grown plainly, their curves and importances, and stored pipelines."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidewire.plans import trees as M
from tidewire.plans.stages import ExactScaler, TreeRegressor, model_pipeline
from tidewire.operators.dataset import apply_scaler, fit_scaler
from tidewire.session import materialise, written_so_far


def sample(n=240, seed=4, missing=0.1):
    """(split, a, b, c, y): few distinct values, some missing, more than one kind of signal."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randint(0, 9), rng.randint(0, 5) / 4, rng.choice([0, 1])
        y = 0.1 * a - 0.3 * b * c + (0.5 if a > 6 else 0) + rng.gauss(0, 0.05)
        seen = [None if rng.random() < missing else float(v) for v in (a, b, c)]
        rows.append(("train" if i % 5 < 3 else "val" if i % 5 == 3 else "test", *seen, y))
    return rows


def frame(spark, rows):
    return materialise(spark.createDataFrame(rows, "split string, a double, b double, c double, y_next double"), "rows")


def plain_score(residuals, p):
    total = sum(residuals)
    return max(abs(total) - p.l1, 0) ** 2 / (len(residuals) + p.l2)


def plain_tree(rows, depth, p):
    """Grow a tree over (features, residual) rows by trying every cut between distinct values."""
    residuals = [r for _, r in rows]
    best = None
    if depth:
        for f in range(3):
            for cut in sorted({x[f] for x, _ in rows if x[f] is not None}):
                for missing_left in (False, True):
                    left = [r for r in rows if (missing_left if r[0][f] is None else r[0][f] <= cut)]
                    right = [r for r in rows if not (missing_left if r[0][f] is None else r[0][f] <= cut)]
                    if min(len(left), len(right)) < p.min_rows:
                        continue
                    gain = plain_score([r for _, r in left], p) + plain_score([r for _, r in right], p) - plain_score(residuals, p)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, cut, missing_left, left, right)
    if best is None:
        total = sum(residuals)
        step = -p.rate * math.copysign(max(abs(total) - p.l1, 0), total) / (len(residuals) + p.l2)
        return lambda x: step, []
    gain, f, cut, missing_left, left, right = best
    (low, low_gains), (high, high_gains) = plain_tree(left, depth - 1, p), plain_tree(right, depth - 1, p)
    told = [(f, gain, len(rows)), *low_gains, *high_gains]
    return lambda x: low(x) if (missing_left if x[f] is None else x[f] <= cut) else high(x), told


@pytest.mark.parametrize("depth, l1, l2, min_rows", [(3, 0.0, 1.0, 1), (2, 0.4, 2.0, 15), (4, 0.0, 0.0, 3)])
def test_trees_equal_plain_growth(spark, depth, l1, l2, min_rows):
    p = M.TreePreset(3, 0.4, depth, min_rows, 1.0, 1.0, patience=9, l1=l1, l2=l2)
    rows = sample(seed=depth)
    df = frame(spark, rows)
    before = written_so_far()
    model = M.fit_trees(df, ["a", "b", "c"], p, "y_next")
    assert written_so_far() == before
    train = [(r[1:4], r[4]) for r in rows if r[0] == "train"]
    base = float(np.float32(sum(y for _, y in train) / len(train)))
    grown, gains = [], []
    for t in range(3):
        predict = lambda x, grown=tuple(grown): base + sum(g(x) for g in grown)
        tree, told = plain_tree([(x, predict(x) - y) for x, y in train], depth, p)
        grown.append(tree)
        gains += told
        errors = {part: [base + sum(g(r[1:4]) for g in grown) - r[4] for r in rows if r[0] == part] for part in ("train", "val")}
        for part, off in errors.items():
            _, _, rmse, mae = next(c for c in model.curve if c[:2] == (t + 1, part))
            assert rmse == pytest.approx(math.sqrt(sum(e * e for e in off) / len(off)), rel=1e-9)
            assert mae == pytest.approx(sum(map(abs, off)) / len(off), rel=1e-9)
    watched = [c[3] for c in model.curve if c[1] == "val"]
    assert model.best == 1 + watched.index(min(watched)) == 3
    got = {(r.a, r.b, r.c, r.y): r.y_hat for r in M.predict(model, df, label="y_next").collect()}
    for r in rows:
        assert got[r[1:]] == pytest.approx(base + sum(g(r[1:4]) for g in grown), abs=1e-9)
    mean = [sum(g for f, g, _ in gains if f == i) / max(sum(f == i for f, _, _ in gains), 1) for i in range(3)]
    for r in M.feature_importance(model, ["a"], news=["c"], latent=["b"]).collect():
        i = "bac".index(r.feature)
        # The names given here are in the order latent, technical, news.
        assert r.importance == pytest.approx(mean[i] / sum(mean), rel=1e-6)
        assert (r.splits, r.cover) == (sum(f == i for f, _, _ in gains), sum(n for f, _, n in gains if f == i))


def test_model_does_not_depend_on_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 16)
    monkeypatch.setattr(M, "TREES_PER_WRITE", 3)
    df = frame(spark, sample(400))
    p = M.preset("multi_hybrid", trees=10, rate=0.3, min_rows=3)
    one = M.fit_trees(df.coalesce(1), ["a", "b", "c"], p, "y_next")
    monkeypatch.setattr(M, "BLOCK_ROWS", 1 << 16)
    monkeypatch.setattr(M, "TREES_PER_WRITE", 50)
    other = M.fit_trees(df.repartition(7), ["a", "b", "c"], p, "y_next")
    assert len(one.trees) == 10 and one.trees == other.trees
    for a, b in zip(one.curve, other.curve, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)
    hybrid = M.fit_trees(df.withColumn("x", F.array("a", "b", "c")), "x", p, "y_next")
    assert hybrid.trees == one.trees and hybrid.names == ["x[0]", "x[1]", "x[2]"]


@pytest.mark.parametrize("name", sorted(M.PRESETS))
def test_presets_at_their_own_size_stop_on_noise(spark, name):
    rng = random.Random(8)
    p = M.preset(name)
    rows = [("train" if i % 2 else p.validation, rng.random(), rng.random(), rng.random(), rng.gauss(0, 0.02)) for i in range(120)]
    model = M.fit_trees(frame(spark, rows), ["a", "b", "c"], p, "y_next")
    watched = [c[3] for c in model.curve if c[1] == "val"]
    assert len(model.trees) == min(p.trees, model.best + p.patience) == len(watched) and model.best < p.trees
    assert model.best in (0, 1 + watched.index(min(watched)))


def test_tables_without_something(spark):
    rows = sample(60)
    p = M.preset("multi", trees=2, min_rows=1)
    none = M.fit_trees(frame(spark, rows).filter("split = 'test'"), ["a", "b", "c"], p, "y_next")
    assert none.trees == [] and M.predict(none, frame(spark, rows), ["a", "b", "c"], "y_next").filter("y_hat <> 0").count() == 0
    unwatched = M.fit_trees(frame(spark, rows).filter("split = 'train'"), ["a", "b", "c"], p, "y_next")
    assert unwatched.best == 2 and {c[1] for c in unwatched.curve} == {"train"}
    odd = [("train", None, math.nan, math.inf, 0.1), ("train", 1.0, 1.0, 1.0, None), ("train", 1.0, 2.0, 1.0, math.nan), ("val", 1.0, None, 0.0, 0.2)]
    model = M.fit_trees(frame(spark, odd), ["a", "b", "c"], p, "y_next")
    assert model.base == pytest.approx(0.1) and M.predict(model, frame(spark, odd), label="y_next").count() == 4
    assert sum(r.importance for r in M.feature_importance(model, ["a", "b", "c"]).collect()) == 0


def test_stored_pipeline_predicts_the_same(spark, tmp_path):
    df = frame(spark, sample(300)).withColumn("key", F.monotonically_increasing_id())
    p = M.preset("answer_sentiment", trees=8, rate=0.3, min_rows=2, column_sample=1.0)
    fitted = model_pipeline(p, ["a", "b", "c"], continuous=["a", "b"], label="y_next").fit(df)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    first, second = (m.transform(df).orderBy("key").select("a", "b", "c", "y_hat").collect() for m in (fitted, loaded))
    assert first == second and loaded.stages[1].trees == fitted.stages[1].trees
    scaled = apply_scaler(df, fit_scaler(df.filter("split = 'train'"), ["a", "b"]), ["a", "b"])
    direct = M.predict(M.fit_trees(materialise(scaled, "scaled"), ["a", "b", "c"], p, "y_next"), scaled, label="y_next")
    assert [r.y_hat for r in direct.orderBy("key").collect()] == [r.y_hat for r in first]
    assert len(fitted.stages[1].trees.trees) == 8
    ExactScaler(inputCols=["a"], method="standard").save(str(tmp_path / "scaler"))
    assert ExactScaler.load(str(tmp_path / "scaler")).getOrDefault("method") == "standard"
    TreeRegressor(inputCols=["a"], settings=p).save(str(tmp_path / "trees"))
    assert M.TreePreset(**__import__("json").loads(TreeRegressor.load(str(tmp_path / "trees")).getOrDefault("settings"))) == p
