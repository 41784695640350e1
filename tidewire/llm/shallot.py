"""Exact k-means on integer vectors, each row searching a shrinking ball of centroids.

Every row keeps its nearest and second-nearest centroid with an upper bound on the distance to the
first and a lower bound on the distance to all others. Bounds that stay apart after the centroids
have moved settle a row without any distance. The others measure both remembered centroids, start
from the closer one, and walk its neighbours in order of distance from it: a centroid closer to
the row than its second-best lies within (distance to the start + second-best) of the start, a
ball that shrinks with each find. Bounds are doubles rounded to the safe side; the centroids left
over are compared by exact integer distance, ties going to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tidewire.llm.text import arrow_schema
from tidewire.session import discard_materialised, materialise, written_so_far

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SALT = "2"
# Components up to this size have squared distances below 2**62 in 64 dimensions.
LARGEST = 1 << 27
# Relative slack that covers the rounding of doubles in bounds.
SLACK = 1e-12


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, vec): the rows with exactly ``dims`` finite components, as integers floor(scale * x).

    A NULL vector, one with a NULL, NaN or infinite component, of another length, or with an
    integer beyond 2**27 (whose squared distances leave 64 bits) is not kept.
    """
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    fits = F.forall("scaled", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= F.lit(float(LARGEST))), F.lit(False)))
    rows = vectors.select(F.col(id_col).alias("id"), scaled.alias("scaled")).where(F.size("scaled") == dims).where(fits)
    return rows.select("id", F.transform("scaled", lambda x: F.floor(x).cast("int")).alias("vec"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, salt: str = SALT) -> np.ndarray:
    """The vectors with the smallest sha256 of ``salt:id`` in that order; ties by id, then vector.

    A NULL id counts as the empty text. Fewer rows than ``clusters`` give as many centroids.
    """
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.withColumn("mark", mark).orderBy("mark", "id", "vec").limit(clusters).select("vec").collect()
    return np.array([r.vec for r in rows], dtype=np.int64)


class Ball:
    """The centroids of one round: each one's neighbours by distance, and the search among them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        squared = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
        self.apart = np.sqrt(squared.astype(np.float64)) * (1 - SLACK)
        np.fill_diagonal(self.apart, -1.0)
        self.order = np.argsort(self.apart, axis=1, kind="stable")[:, 1:]
        others = np.take_along_axis(self.apart, self.order[:, :1], axis=1)[:, 0] if len(centroids) > 1 else np.array([np.inf])
        self.half_gap = others / 2 * (1 - SLACK)

    def squared(self, rows: np.ndarray, numbers: np.ndarray | int) -> np.ndarray:
        step = rows - self.centroids[numbers]
        return np.einsum("ij,ij->i", step, step)

    def search(self, rows: np.ndarray, near: np.ndarray, second: np.ndarray):
        """Exact (nearest, its squared distance, second, its squared distance) of every row."""
        near, second = near.copy(), second.copy()
        d1 = self.squared(rows, near)
        if len(self.centroids) == 1:
            return near, d1, second, np.full(len(rows), np.iinfo(np.int64).max)
        d2 = self.squared(rows, second)
        swap = (d2 < d1) | ((d2 == d1) & (second < near))
        near[swap], second[swap] = second[swap], near[swap]
        d1[swap], d2[swap] = d2[swap], d1[swap]
        reach = np.sqrt(d1.astype(np.float64))
        ball = (reach + np.sqrt(d2.astype(np.float64))) * (1 + SLACK)
        for start in np.unique(near):
            inside = np.flatnonzero(near == start)
            for j in self.order[start]:
                inside = inside[ball[inside] >= self.apart[start, j]]
                if not len(inside):
                    break
                d = self.squared(rows[inside], j)
                first = (d < d1[inside]) | ((d == d1[inside]) & (j < near[inside]))
                after = ~first & (j != second[inside]) & (d < d2[inside])
                found = inside[first]
                second[found], d2[found] = near[found], d1[found]
                near[found], d1[found] = j, d[first]
                found = inside[after]
                second[found], d2[found] = j, d[after]
                changed = inside[first | after]
                ball[changed] = (reach[changed] + np.sqrt(d2[changed].astype(np.float64))) * (1 + SLACK)
        return near, d1, second, d2

    def settle(self, rows, near, second, upper, lower):
        """Bring all bounds up to date; rows that bounds do not settle are searched."""
        open_ = np.flatnonzero(~(upper < np.maximum(lower, self.half_gap[near])))
        known = open_[np.isfinite(upper[open_])]
        upper[known] = np.sqrt(self.squared(rows[known], near[known]).astype(np.float64)) * (1 + SLACK)
        open_ = open_[~(upper[open_] < np.maximum(lower[open_], self.half_gap[near[open_]]))]
        if len(open_):
            near[open_], d1, second[open_], d2 = self.search(rows[open_], near[open_], second[open_])
            upper[open_] = np.sqrt(d1.astype(np.float64)) * (1 + SLACK)
            lower[open_] = np.sqrt(d2.astype(np.float64)) * (1 - SLACK)
        return len(open_)


def loosened(near: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray):
    """Bounds after every centroid has moved by at most ``moved``."""
    farthest = np.argsort(moved)
    most = moved[farthest[-1]]
    next_most = moved[farthest[-2]] if len(moved) > 1 else 0.0
    others = np.where(near == farthest[-1], next_most, most)
    return (upper + moved[near]) * (1 + SLACK), lower - np.abs(lower) * SLACK - others


def _round(centroids: np.ndarray, moved: np.ndarray | None, schema: pa.Schema, measure: bool):
    """Task function: rows out with new bounds; after them the task's sum per cluster.

    With ``measure`` set, rows get the exact squared distance instead and no sums follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(centroids)
        k, dims = centroids.shape
        sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vec = batch.column("vec")
            rows = vec.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dims)
            if moved is None:
                near, second = np.zeros(n, dtype=np.int32), np.full(n, min(1, k - 1), dtype=np.int32)
                upper, lower = np.full(n, np.inf), np.zeros(n)
            else:
                near, second = (batch.column(c).to_numpy().copy() for c in ("near", "second"))
                upper, lower = loosened(near, batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), moved)
            ball.settle(rows, near, second, upper, lower)
            if measure:
                found = {"id": batch.column("id"), "near": near, "distance": ball.squared(rows, near)}
            else:
                found = {"id": batch.column("id"), "vec": vec, "near": near, "second": second, "upper": upper, "lower": lower}
                order = np.argsort(near, kind="stable")
                present, first = np.unique(near[order], return_index=True)
                sums[present] += np.add.reduceat(rows[order], first, axis=0)
                counts += np.bincount(near, minlength=k)
            yield _batch(found, n, schema)
        if not measure and counts.any():
            used = np.flatnonzero(counts)
            yield _batch({"cluster": used, "n": counts[used], "sums": sums[used].tolist()}, len(used), schema)

    return run


def _batch(found: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for field in schema:
        made = found.get(field.name)
        if made is None:
            made = pa.nulls(n, field.type)
        elif not isinstance(made, pa.Array):
            made = pa.array(made, type=field.type)
        columns.append(made.cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each cluster's rows, in exact integers; an empty cluster stays.

    Tasks have added up their rows; what comes to the driver is one number per centroid component.
    """
    parts = state.where("cluster is not null").select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    wide = "decimal(38,0)"
    totals = parts.groupBy("cluster", "place").agg(F.sum(F.col("part").cast(wide)).alias("s"), F.sum("n").alias("n"))
    new = centroids.copy()
    for row in totals.collect():
        new[row.cluster, row.place] = int(row.s) // row.n
    return new


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = DIMS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``rounds`` times all vectors go to their nearest centroid and centroids to the floor of their
    mean, then vectors are assigned once more; distances are squared. Each round writes vectors
    and bounds to the shared folder and drops the round before. Repeated rows and ids are rows
    like any other and each is counted; equal vectors go to the same centroid, the smaller number
    where distances tie. A sum of distances beyond 64 bits is NULL. Rows that ``integer_vectors`` does not keep are in no result; an empty
    table gives an empty one. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, id_col, vector_col, dims)
    id_type = kept.schema["id"].dataType.simpleString()
    centroids = first_centroids(kept, clusters)
    out = f"id {id_type}, near int, distance long"
    if not len(centroids):
        nothing = spark.createDataFrame([], StructType.fromDDL(out))
        return _described(nothing, centroids, [])
    carried = f"id {id_type}, vec array<int>, near int, second int, upper double, lower double"
    ddl = f"{carried}, cluster int, n long, sums array<long>"
    state, moved, mark = kept, None, written_so_far()
    for _ in range(rounds):
        step = _round(centroids, moved, arrow_schema(state, ddl), False)
        before = written_so_far()
        written = materialise(state.mapInArrow(step, ddl), "shallot")
        discard_materialised(spark, mark, before)
        new = _moved_centroids(written, centroids)
        moved = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        centroids = new
        state = written.where("vec is not null").select("id", "vec", "near", "second", "upper", "lower")
    before = written_so_far()
    found = materialise(state.mapInArrow(_round(centroids, moved, arrow_schema(state, out), True), out), "shallot-found")
    discard_materialised(spark, mark, before)
    sums = found.groupBy("near").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    return _described(found, centroids, [(r.near, int(r.s)) for r in sums])


def _described(found: DataFrame, centroids: np.ndarray, inertias: list[tuple[int, int]]) -> DataFrame:
    """Rows with what holds for their cluster: one small row per centroid, by its number."""
    total = sum(s for _, s in inertias)
    held = lambda s: s if s < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(k, held(s), held(total), digests[k]) for k, s in inertias]
    told = found.sparkSession.createDataFrame(rows, "near int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "near").select(
        "id", F.col("near").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
