"""Centroid clustering of integer vectors with ns-bounds: distances are evaluated only where kept bounds cannot decide.

Every vector keeps an upper bound of the distance to its centroid and a lower bound for each other centroid, each with
the round in which it was evaluated. The centroids of all rounds are kept (rounds x clusters vectors), so
a bound from round r is loosened in round t by the norm of the total displacement c(t) - c(r); the sum of the drifts of single
rounds, never smaller, is not used. A vector whose loosened lower bounds all exceed its upper bound stays.
Else its own distance is evaluated, and then those of the centroids whose lower bound does not exceed it. Squared distances are
exact integers and ties go to the smaller number, so the result is that of comparing everything.

Bounds are kept as whole numbers, rounded away from the distance. Each round writes vectors and bounds to
the shared folder and drops the files of the round before; a lost executor costs its tasks. Only
sums per cluster reach the driver: k rows of one number per component.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import remove_settled, settle_at, settled_path

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
LARGEST = 1 << 27           # of a component: 64 squared differences of such still fit a long
SAFE = 1e-12                # relative error allowed for in square roots of exact numbers
STATE = ("v array<int>, cluster int, upper int, upper_at tinyint, lower array<int>, lower_at array<tinyint>, "
         "distance long, evaluated int")


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id and v: floor(scale * x) of each component. Vectors of another length, null or with null or non-finite components go."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return df.where((F.size(x) == dims) & finite).select(
        F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """Vectors of the k smallest hashes of ``2:<id>``, equal hashes by the vector; rows without an id are not drawn."""
    drawn = (vectors.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256).alias("h"), "v")
             .orderBy("h", "v").limit(k).collect())
    return _checked(np.array([r["v"] for r in drawn], dtype=np.int64))


def _checked(x: np.ndarray) -> np.ndarray:
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling: squared distances would not fit a long")
    return x


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the rows of c."""
    reach = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if x.shape[1] * 4 * float(reach) ** 2 < 2 ** 53:     # all sums are exact as doubles
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _below(d: np.ndarray) -> np.ndarray:
    return np.floor(np.sqrt(d.astype(np.float64)) * (1 - SAFE)).astype(np.int32)


def _above(d: np.ndarray) -> np.ndarray:
    return np.ceil(np.sqrt(d.astype(np.float64)) * (1 + SAFE)).astype(np.int32)


class Bounds:
    """Assignments of a block of vectors with their bounds and the rounds of these."""

    def __init__(self, cluster, upper, upper_at, lower, lower_at):
        self.cluster, self.upper, self.upper_at, self.lower, self.lower_at = cluster, upper, upper_at, lower, lower_at
        self.evaluated = np.zeros(len(cluster), np.int32)

    @classmethod
    def exact(cls, x: np.ndarray, centroids: np.ndarray) -> "Bounds":
        d = squared_distances(x, centroids)
        own = d.argmin(axis=1).astype(np.int32)
        out = cls(own, _above(d[np.arange(len(x)), own]), np.zeros(len(x), np.int8), _below(d), np.zeros(d.shape, np.int8))
        out.evaluated[:] = d.shape[1]
        return out

    def advance(self, x: np.ndarray, history: list[np.ndarray]) -> "Bounds":
        """Assignments to the last centroids of ``history``, given those made with earlier ones."""
        t, centroids = len(history) - 1, history[-1]
        clusters = np.arange(len(centroids))
        moved = np.stack([np.sqrt(((centroids - c).astype(np.float64) ** 2).sum(axis=1)) for c in history]) * (1 + SAFE)
        upper = self.upper + moved[self.upper_at, self.cluster]
        lower = self.lower - moved[self.lower_at, clusters]
        lower[np.arange(len(x)), self.cluster] = np.inf
        rows = np.nonzero((lower <= upper[:, None]).any(axis=1))[0]
        if not len(rows):
            return self
        own = self.cluster[rows]
        here = np.arange(len(rows))
        d = np.full((len(rows), len(clusters)), np.iinfo(np.int64).max)
        for j in clusters:
            at = np.nonzero(own == j)[0]
            if len(at):
                d[at, j] = squared_distances(x[rows[at]], centroids[j:j + 1])[:, 0]
        near = lower[rows] <= np.sqrt(d[here, own].astype(np.float64))[:, None] * (1 + SAFE)
        for j in clusters:
            at = np.nonzero(near[:, j])[0]
            if len(at):
                d[at, j] = squared_distances(x[rows[at]], centroids[j:j + 1])[:, 0]
        near[here, own] = True
        self.evaluated[rows] += near.sum(axis=1, dtype=np.int32)
        best = d.argmin(axis=1).astype(np.int32)
        r, j = np.nonzero(near)
        self.lower[rows[r], j], self.lower_at[rows[r], j] = _below(d[r, j]), t
        self.cluster[rows], self.upper[rows], self.upper_at[rows] = best, _above(d[here, best]), t
        return self


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def assign(state: DataFrame, history: list[np.ndarray], last: bool) -> DataFrame:
    """The state after assigning every vector to the last centroids; in the last round with the exact distance."""
    k, dims = history[-1].shape
    first = len(history) == 1
    kind = state.schema["id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column
            x = _checked(_matrix(col(1), dims, np.int64))
            if first:
                b = Bounds.exact(x, history[0])
            else:
                ints = lambda i: col(i).to_numpy(zero_copy_only=False).copy()
                b = Bounds(ints(2), ints(3), ints(4), _matrix(col(5), k, np.int32), _matrix(col(6), k, np.int8)).advance(x, history)
            distance = ((x - history[-1][b.cluster]) ** 2).sum(axis=1) if last else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays(
                [col(0), _lists(x, pa.int32()), pa.array(b.cluster, pa.int32()), pa.array(b.upper, pa.int32()),
                 pa.array(b.upper_at, pa.int8()), _lists(b.lower, pa.int32()), _lists(b.lower_at, pa.int8()),
                 pa.array(distance, pa.int64()), pa.array(b.evaluated, pa.int32())],
                names=["id", "v", "cluster", "upper", "upper_at", "lower", "lower_at", "distance", "evaluated"])

    return state.mapInArrow(work, f"id {kind}, {STATE}")


def next_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; empty clusters keep their centroid."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[
        F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]).collect()
    out = centroids.copy()
    for r in sums:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows of id, cluster, distance (squared) and evaluated (distances of the last round), and the centroids of all rounds.

    ``vectors`` holds id and v, integer arrays of one length. With fewer than k vectors that have an id there
    are fewer centroids; without any there is no row. Repeated rows and rows without an id are clustered like all others.
    """
    spark = vectors.sparkSession
    history = [first_centroids(vectors, k)]
    if not len(history[0]):
        return spark.createDataFrame([], f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long, evaluated int"), []
    state, before = vectors, None
    for t in range(rounds + 1):
        path = settled_path(spark, f"bounds{t}")
        state = settle_at(assign(state, history, t == rounds), path)
        if before:
            remove_settled(spark, before)
        before = path
        if t < rounds:
            history.append(next_centroids(state, history[-1]))
    return state.select("id", "cluster", "distance", "evaluated"), history


def clusters_report(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Vectors that are null, of another length than 64 or hold a null or non-finite component are not kept. Ties go to the smaller
    cluster number; repeated rows repeat and count as often in sums; a row with a null id is clustered but starts no
    cluster. An empty table gives an empty result. A component beyond 2**27 after scaling is an error: its squared distance is no long.
    """
    spark = embeddings.sparkSession
    rows, history = cluster_vectors(integer_vectors(embeddings, id_col, vec_col))
    # one row per cluster: at most CLUSTERS
    names = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(history[-1].tolist() if history else [])]
    known = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = F.lit(sum(sums.values())).cast("long")
    inertia = F.create_map(*chain.from_iterable((F.lit(j), F.lit(s).cast("long")) for j, s in sums.items())) if sums else F.create_map()
    found = rows.join(F.broadcast(known), "cluster")
    own = F.element_at(inertia, F.col("cluster")) if sums else F.lit(None).cast("long")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", own.alias("cluster_inertia"), total.alias("inertia"),
                        "centroid_sha256")
