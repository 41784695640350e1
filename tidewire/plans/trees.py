"""Gradient-boosted regression trees on histograms (M5, M7, M8).

Features are cut once into at most 255 bins at exact quantiles, and rows are packed into blocks of
bytes in a written table. One level of one tree is one pass over the blocks: each task adds up the
gradients of its drawn rows per (node, feature, bin), partial sums meet in a tree, and the driver
gets a few histograms, whose size is set by depth, features and bins. Nothing that grows with
the rows leaves the tasks. The errors on train and validation rows come out of the same passes,
so the training curve and early stopping cost nothing more.

Gradients are rounded to a grid on which sums of all rows are exact, and rows are drawn by a hash
of their values: a model does not depend on how rows are dealt over tasks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.expressions import finite
from tidewire.operators.features import TARGET
from tidewire.operators.quantiles import exact_quantiles
from tidewire.schemas import q
from tidewire.session import discard_materialised, materialise, written_so_far

SEED = 42
# Bin 0 holds missing values, the others are between exact quantiles of the train rows.
BINS = 255
BLOCK_ROWS = 1 << 16
# Rows per task of a pass, at most about; fewer where there are cores for more tasks of a block.
TASK_ROWS = 1 << 18
# Trees between two writes of the rows' predictions; passes in between apply the newer trees.
TREES_PER_WRITE = 50


@dataclass(frozen=True)
class TreePreset:
    """Settings of one boosted-tree model.

    ``validation`` names the split that early stopping watches, ``metric`` its error ("rmse" or
    "mae"), ``patience`` the rounds without gain after which it stops. Rows and columns are sampled
    per tree. ``l1`` and ``l2`` are penalties on leaf values.
    """

    trees: int
    rate: float
    depth: int
    min_rows: int
    row_sample: float
    column_sample: float
    validation: str = "val"
    patience: int = 30
    l1: float = 0.0
    l2: float = 1.0
    metric: str = "mae"


# The model settings, by name.
PRESETS = {
    "single": TreePreset(500, 0.06, 4, 1, 0.8, 0.7, "test", 20),
    "single_hybrid": TreePreset(500, 0.03, 4, 1, 0.8, 0.5, "test", 20),
    "multi": TreePreset(1000, 0.01, 3, 15, 0.3, 0.3),
    "multi_hybrid": TreePreset(1000, 0.01, 3, 15, 0.5, 0.5),
    "classifier_sentiment": TreePreset(1000, 0.01, 3, 15, 0.5, 0.5),
    "answer_sentiment": TreePreset(1000, 0.01, 3, 15, 0.5, 0.5, l1=0.1, l2=2.0),
}


def preset(name: str, **changes) -> TreePreset:
    return replace(PRESETS[name], **changes)


@dataclass
class Tree:
    """A tree of full depth: node i has the children 2 i + 1 and 2 i + 2.

    A node without a split sends every row left. ``gain`` and ``cover`` (rows) are 0 there.
    """

    feature: list[int]
    cut: list[int]
    missing_left: list[bool]
    value: list[float]
    gain: list[float]
    cover: list[float]


@dataclass
class BoostedTrees:
    """A fitted model. ``names`` are numeric columns, or the places of the array column ``array``."""

    names: list[str]
    array: str | None
    cuts: list[list[float]]
    base: float
    settings: TreePreset
    trees: list[Tree] = field(default_factory=list)
    # (round, part, rmse, mae) of every round that was fitted, also beyond the best one.
    curve: list[tuple[int, str, float, float]] = field(default_factory=list)
    best: int = 0

    def kept(self) -> list[Tree]:
        return self.trees[: self.best]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        made = json.loads(text)
        made["settings"] = TreePreset(**made["settings"])
        made["trees"] = [Tree(**t) for t in made["trees"]]
        made["curve"] = [tuple(c) for c in made["curve"]]
        return BoostedTrees(**made)


def routed(bins: np.ndarray, tree: Tree, levels: int, values: Sequence) -> np.ndarray:
    """For each row (column of ``bins``) the one of ``values`` that the tree's first levels lead it to.

    Works from the last level up: a node's rows take the left or the right child's result.
    """
    found = list(values)
    for level in reversed(range(levels)):
        first = (1 << level) - 1
        for i in range(1 << level):
            at = first + i
            left, right = found[2 * i : 2 * i + 2]
            own = bins[tree.feature[at]]
            goes_right = own > tree.cut[at]
            if not tree.missing_left[at]:
                goes_right |= own == 0
            found[i] = np.where(goes_right, right, left)
    return found[0] if levels else np.full(bins.shape[1], found[0])


def added(bins: np.ndarray, trees: Sequence[Tree], depth: int) -> np.ndarray:
    """What all trees together add to each row's prediction, in the order of the trees."""
    out = np.zeros(bins.shape[1])
    for tree in trees:
        out += routed(bins, tree, depth, tree.value)
    return out


def to_bins(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(features, rows) bytes: 0 for a missing value, else 1 + the number of cuts below it."""
    bins = np.zeros(values.shape[::-1], dtype=np.uint8)
    for i, own in enumerate(cuts):
        here = values[:, i]
        known = np.isfinite(here)
        bins[i, known] = 1 + np.searchsorted(own, here[known], side="left")
    return bins


def drawn(keys: np.ndarray, round_: int, share: float) -> np.ndarray:
    """Which rows a tree sees: a mix of the row's hash and the round, below the share."""
    if share >= 1:
        return np.ones(len(keys), dtype=bool)
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64) + np.uint64((SEED + round_ + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) < share * 2.0**53


# --- rows to blocks ---

_BLOCKS = "n int, bins binary, y binary, part binary, key binary, margin binary"


def _feature_columns(df: DataFrame, features: Sequence[str] | str) -> tuple[list[str], list[Column]]:
    if not isinstance(features, str):
        return list(features), [finite(q(c)) for c in features]
    width = df.agg(F.max(F.size(q(features)))).first()[0] or 0
    return [f"{features}[{i}]" for i in range(width)], [finite(F.get(q(features), i)) for i in range(width)]


def _cuts(train: DataFrame, names: list[str], columns: list[Column]) -> list[list[float]]:
    """Per feature the distinct exact quantiles of the train rows; their number is set by the schema."""
    wide = train.select(*[c.alias(f"f{i}") for i, c in enumerate(columns)])
    places = [i / BINS for i in range(1, BINS)]
    found = exact_quantiles(wide, wide.columns, places).groupBy("feature").agg(F.collect_set("value").alias("values"))
    by_name = {r.feature: sorted(r["values"]) for r in found.collect()}
    return [by_name.get(f"f{i}", []) for i in range(len(names))]


def _blocks(rows: DataFrame, cuts: list[list[float]], base: float) -> DataFrame:
    """Rows (features array, y, part, key) as a written table of byte blocks."""
    limits = [np.array(c) for c in cuts]
    schema = pa.schema([("n", pa.int32()), *[(c, pa.binary()) for c in ("bins", "y", "part", "key", "margin")]])

    def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bins, y, part, key = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True))
        held = [len(y), bins.tobytes(), y.tobytes(), part.tobytes(), key.tobytes(), np.full(len(y), base).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(held, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            n = batch.num_rows
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, len(limits))
            y, part, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "part", "key"))
            parts.append((to_bins(values, limits), y, part.astype(np.uint8), key))
            held += n
            if held >= BLOCK_ROWS:
                yield block(parts)
                parts, held = [], 0
        if held:
            yield block(parts)

    return materialise(rows.mapInArrow(run, _BLOCKS), "tree-blocks")


def _unpacked(row: tuple) -> tuple[np.ndarray, ...]:
    """(bins as a matrix, y, part, key, margin) of a block."""
    n, bins, y, part, key, margin = row
    matrix = np.frombuffer(bins, np.uint8).reshape(-1, n)
    return matrix, np.frombuffer(y), np.frombuffer(part, np.uint8), np.frombuffer(key, np.int64), np.frombuffer(margin)


def _tasks(spark: SparkSession, rows: int) -> int:
    few = min(-(-rows // BLOCK_ROWS), spark.sparkContext.defaultParallelism)
    return max(few, -(-rows // TASK_ROWS), 1)


def _placed(blocks: DataFrame, tasks: int) -> RDD:
    """Written blocks kept near the tasks of the passes to come; lost ones are read again.

    A pass is a function of whole blocks that gives one vector per task, which ``treeReduce``
    adds up in two steps. Hundreds of such passes make a model, and each starts sooner on an RDD
    than a query of its own would.
    """
    return blocks.coalesce(tasks).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


# --- one pass ---


@dataclass(frozen=True)
class _Pass:
    """What a pass over the blocks needs to know: the trees since the last write and the growing one."""

    newer: list[Tree]
    growing: Tree
    level: int
    picked: list[int]
    round_: int
    grid: float
    settings: TreePreset


def _histograms(blocks: RDD, now: _Pass):
    """(sums, counts, errors): gradients and rows per (node, picked feature, bin) of a level.

    Errors are (rows, squares, absolutes) of train and validation rows before this tree; they are
    worked out at level 0 only.
    """
    level, picked = now.level, now.picked
    nodes, bins = 1 << level, BINS + 1
    cells = nodes * len(picked) * bins
    chosen = np.array(picked, dtype=np.int64)
    offsets = np.arange(len(picked), dtype=np.int64) * bins

    def add_up(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = np.zeros(2 * cells + 6)
        for x, y, part, key, margin in map(_unpacked, rows):
            off = margin + added(x, now.newer, now.settings.depth) - y
            if level == 0:
                for p in (0, 1):
                    own = off[part == p]
                    total[2 * cells + 3 * p : 2 * cells + 3 * p + 3] += len(own), (own * own).sum(), np.abs(own).sum()
            use = (part == 0) & drawn(key, now.round_, now.settings.row_sample)
            node = routed(x, now.growing, level, range(nodes))[use]
            spot = (node * (len(picked) * bins) + offsets[:, None] + x[chosen][:, use]).ravel()
            gradient = np.rint(off[use] * now.grid)
            total[:cells] += np.bincount(spot, np.tile(gradient, len(picked)), cells)
            total[cells : 2 * cells] += np.bincount(spot, minlength=cells)
        yield total

    summed = blocks.mapPartitions(add_up).treeReduce(np.add)
    sums, counts = summed[: 2 * cells].reshape(2, nodes, len(picked), bins)
    return sums / now.grid, counts, summed[2 * cells :].reshape(2, 3)


# --- growing ---


def _score(sums: np.ndarray, counts: np.ndarray, p: TreePreset) -> np.ndarray:
    shrunk = np.maximum(np.abs(sums) - p.l1, 0.0)
    return np.divide(shrunk * shrunk, counts + p.l2, out=np.zeros_like(shrunk), where=counts + p.l2 > 0)


def leaf_value(total: float, rows: float, p: TreePreset) -> float:
    """The step of a leaf: its mean gradient, shrunk by ``l1`` and ``l2``, times the learning rate."""
    if rows + p.l2 <= 0:
        return 0.0
    return -p.rate * math.copysign(max(abs(total) - p.l1, 0.0), total) / (rows + p.l2)


def best_split(sums: np.ndarray, counts: np.ndarray, p: TreePreset):
    """Of one node's (feature, bin) sums: (gain, feature, cut, missing left, left sum, left rows), or None.

    Bins up to ``cut`` go left; missing values (bin 0) go to the side that gains more, the right one
    if equal. Ties go to the first feature, then the smallest cut.
    """
    whole, rows = sums[0].sum(), counts[0].sum()
    parent = _score(whole, rows, p)
    best = None
    for missing_left in (False, True):
        left_sum = np.cumsum(sums[:, 1:], axis=1)[:, :-1] + (sums[:, :1] if missing_left else 0.0)
        left_rows = np.cumsum(counts[:, 1:], axis=1)[:, :-1] + (counts[:, :1] if missing_left else 0.0)
        gain = _score(left_sum, left_rows, p) + _score(whole - left_sum, rows - left_rows, p) - parent
        allowed = (left_rows >= max(p.min_rows, 1)) & (rows - left_rows >= max(p.min_rows, 1))
        gain = np.where(allowed, gain, -np.inf)
        at = int(gain.argmax())
        feature, cut = divmod(at, gain.shape[1])
        if gain.flat[at] > 1e-12 * max(parent, 1e-300) and (best is None or gain.flat[at] > best[0]):
            best = (float(gain.flat[at]), feature, cut + 1, missing_left, float(left_sum.flat[at]), float(left_rows.flat[at]))
    return best


def _empty_tree(depth: int) -> Tree:
    inner, leaves = (1 << depth) - 1, 1 << depth
    return Tree([0] * inner, [BINS] * inner, [True] * inner, [0.0] * leaves, [0.0] * inner, [0.0] * inner)


def fit_trees(df: DataFrame, features: Sequence[str] | str, settings: TreePreset, label: str = TARGET) -> BoostedTrees:
    """M5: fit on the ``train`` rows, watch the validation rows, keep the best round.

    ``df`` has a ``split`` column. ``features`` is a list of numeric columns, or the name of one
    array column (hybrid rows). NULL, NaN and infinite features count as missing and go to the side
    of a split that gains more; rows without a finite label are left out. Fitting stops when the
    watched error has not fallen for ``patience`` rounds; without validation rows all trees are
    kept. Equal rows are drawn together. Without train rows the model has no trees and predicts 0.
    """
    p = settings
    spark = df.sparkSession
    names, columns = _feature_columns(df, features)
    known = df.filter(finite(q(label)).isNotNull())
    train = known.filter(F.col("split") == "train")
    rows, base, low, high = train.agg(F.count("*"), F.avg(q(label)), F.min(q(label)), F.max(q(label))).first()
    model = BoostedTrees(names, features if isinstance(features, str) else None, [], 0.0, p)
    if not rows or not names:
        model.base = float(base or 0.0)
        return model
    # A mean of few digits is the same however its parts were added up.
    model.base = base = float(np.float32(base))
    mark = written_so_far()
    wanted = known.filter(F.col("split").isin("train", p.validation)).select(
        F.array(*columns).alias("x"), q(label).cast("double").alias("y"), (F.col("split") != "train").cast("int").alias("part")
    )
    wanted = materialise(wanted.withColumn("key", F.xxhash64("x", "y", "part")), "tree-rows")
    plain = [F.get("x", i) for i in range(len(names))]
    model.cuts = _cuts(wanted.filter("part = 0"), names, plain)
    tasks = _tasks(spark, wanted.count())
    # Dealt in turn, not by a value: equal rows may be many.
    written = _blocks(wanted.repartition(tasks), model.cuts, base)
    blocks = _placed(written, tasks)
    # Room for residuals that grow to four times the labels' spread, summed over all rows.
    spread = max(high - low, abs(high - base), abs(low - base), 1e-300)
    grid = 2.0 ** (50 - math.ceil(math.log2(rows + 1)) - math.ceil(math.log2(spread)))
    rng = np.random.default_rng(SEED)
    picks = max(int(p.column_sample * len(names)), 1)
    newer: list[Tree] = []
    lowest, model.best = math.inf, 0
    while True:
        round_ = len(model.trees)
        picked = sorted(rng.choice(len(names), picks, replace=False).tolist())
        tree = _empty_tree(p.depth)
        last = round_ == p.trees
        for level in range(1 if last else p.depth):
            sums, counts, errors = _histograms(blocks, _Pass(newer, tree, level, picked, round_, grid, p))
            if level == 0:
                lowest = _watched(model, errors, round_, lowest)
                if last or (errors[1][0] and round_ - model.best >= p.patience):
                    last = True
                    break
                nodes = [(float(sums[0, 0].sum()), float(counts[0, 0].sum()))]
            nodes = _split_level(tree, level, nodes, sums, counts, picked, p)
        if last:
            break
        tree.value = [leaf_value(s, n, p) for s, n in nodes]
        model.trees.append(tree)
        newer.append(tree)
        if len(newer) == TREES_PER_WRITE:
            before = written_so_far()
            written = _with_margins(written, newer, p.depth)
            blocks.unpersist()
            blocks, newer = _placed(written, tasks), []
            discard_materialised(spark, mark, before)
    blocks.unpersist()
    discard_materialised(spark, mark)
    return model


def _digits(x: float) -> float:
    """Without the digits that the order of addition may change."""
    return float(f"{x:.11e}")


def _watched(model: BoostedTrees, errors: np.ndarray, round_: int, lowest: float) -> float:
    """Enter a round's errors in the curve and its number as the best, where it is."""
    n, squares, absolutes = errors[1]
    watched = math.inf if not n else math.sqrt(squares / n) if model.settings.metric == "rmse" else absolutes / n
    watched = _digits(watched)
    if round_ and n and watched < lowest:
        lowest, model.best = watched, round_
    elif not n:
        model.best = round_
    if round_:
        for part, (n, squares, absolutes) in zip(("train", "val"), errors, strict=True):
            if n:
                model.curve.append((round_, part, _digits(math.sqrt(squares / n)), _digits(absolutes / n)))
    return lowest


def _split_level(tree: Tree, level: int, nodes: list[tuple[float, float]], sums, counts, picked: list[int], p: TreePreset):
    """Split a level's nodes; returns (gradient sum, rows) of the next level's nodes."""
    after = []
    for i, (whole, rows) in enumerate(nodes):
        found = best_split(sums[i], counts[i], p) if rows else None
        if found is None:
            after += [(whole, rows), (0.0, 0.0)]
            continue
        gain, feature, cut, missing_left, left_sum, left_rows = found
        at = (1 << level) - 1 + i
        tree.feature[at], tree.cut[at], tree.missing_left[at] = picked[feature], cut, missing_left
        tree.gain[at], tree.cover[at] = gain, rows
        after += [(left_sum, left_rows), (whole - left_sum, rows - left_rows)]
    return after


def _with_margins(blocks: DataFrame, newer: list[Tree], depth: int) -> DataFrame:
    """The blocks with what newer trees add to their rows, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (_unpacked(tuple(row.values())) for row in batch.to_pylist())
            margins = [(margin + added(x, newer, depth)).tobytes() for x, _, _, _, margin in rows]
            at = batch.schema.get_field_index("margin")
            yield batch.set_column(at, "margin", pa.array(margins, pa.binary()))

    return materialise(blocks.mapInArrow(run, _BLOCKS), "tree-blocks")


# --- using a model ---


def predict(model: BoostedTrees, df: DataFrame, features: Sequence[str] | str | None = None, label: str = TARGET) -> DataFrame:
    """Predictions table: the rows with ``y`` and ``y_hat``; ``features`` may rename the model's inputs."""
    return with_prediction(model, df, features).withColumn("y", q(label))


def with_prediction(
    model: BoostedTrees, df: DataFrame, features: Sequence[str] | str | None = None, output: str = "y_hat"
) -> DataFrame:
    """Add the model's prediction of its best round as a column, in Arrow batches."""
    inputs = features if features is not None else model.array or model.names
    limits = [np.array(c) for c in model.cuts]
    base, trees, depth, width = model.base, model.kept(), model.settings.depth, len(model.cuts)
    if isinstance(inputs, str):
        vector = F.array(*[finite(F.get(q(inputs), i)) for i in range(len(model.names))])
    else:
        vector = F.array(*[finite(q(c)) for c in inputs])
    if not width:
        return df.withColumn(output, F.lit(base))

    @F.arrow_udf("double")
    def read(x: pa.Array) -> pa.Array:
        values = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), width)
        return pa.array(base + added(to_bins(values, limits), trees, depth), pa.float64())

    return df.withColumn(output, read(vector))


def feature_importance(
    model: BoostedTrees,
    technical: Sequence[str],
    news: Sequence[str] = (),
    latent: Sequence[str] = (),
) -> DataFrame:
    """M7: (feature, importance, grp, splits, total_gain, cover), the most important first.

    ``importance`` is the mean gain of a feature's splits over the best round's trees, as a share
    of the sum over features; all 0 where no tree splits. Names are in the order latent,
    technical, news.
    """
    names = [(n, "latent") for n in latent] + [(n, "technical") for n in technical]
    names += [(n, "news") for n in news]
    if len(names) != len(model.names):
        raise ValueError(f"{len(model.names)} features but {len(names)} names")
    splits, gains, covers = (np.zeros(len(names)) for _ in range(3))
    for tree in model.kept():
        for feature, gain, cover in zip(tree.feature, tree.gain, tree.cover, strict=True):
            if cover:
                splits[feature] += 1
                gains[feature] += gain
                covers[feature] += cover
    mean = np.divide(gains, splits, out=np.zeros(len(names)), where=splits > 0)
    shares = mean / (mean.sum() or 1.0)
    rows = [
        (n, float(w), g, int(s), float(t), float(c))
        for (n, g), w, s, t, c in zip(names, shares, splits, gains, covers, strict=True)
    ]
    schema = "feature string, importance double, grp string, splits long, total_gain double, cover double"
    return SparkSession.active().createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature")


def training_curve(model: BoostedTrees) -> DataFrame:
    """M8: RMSE and MAE after each boosting round, on the train and the validation rows.

    The errors were taken while fitting; rounds after the best one are there too.
    """
    return SparkSession.active().createDataFrame(model.curve, "iteration int, part string, rmse double, mae double")
