"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Equal vectors are one class first (with its smallest ids), so that a vector held by many rows is
one candidate and one query. Maximum inner product becomes nearest Euclidean neighbour by one more
column, sqrt(M^2 - |x|^2), zero for queries. Vectors are rotated at random: after a
rotation every block of columns holds a fair sample of a distance, so after d of D columns a partial
distance above  tau * d / D * (1 + EPSILON / sqrt(d))^2  rejects the hypothesis that the full distance is
below the query's current k-th distance tau, and the candidate is abandoned. Survivors are scored in
double precision on the original vectors.

Lists come from k-means on a bounded sample; every vector is assigned to its list. How many of its
nearest lists a query probes is measured: for a bounded pilot of queries the exact neighbours among
all vectors are found, and the probes are the fewest that hold LIST_RECALL of them (and enough classes).
Vectors without clusters so cost more probes instead of recall. Lists are cut into chunks and
a list's queries into blocks, so a tile has a bounded number of each.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import settle

SAMPLE_ROWS = 20_000    # vectors that the lists are fitted on, at most (expected)
MAX_LISTS = 4096
PILOT_QUERIES = 128     # queries whose exact answers set the number of probes
LIST_RECALL = 0.97      # share of the pilot's true neighbours that the probed lists must hold
MIN_PROBES = 8
BLOCK = 16              # columns between two tests
EPSILON = 2.1
CHUNK = 2048            # classes of a list in one tile
QUERY_BLOCK = 1024
SEED = 7


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, vec, h1, h2) that take part: finite, not zero, of the commonest dimension, with an id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("vec") == (sizes["d"] if sizes else 0)).select(
        "id", "vec", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids (no query needs more) in order."""
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))     # repeated rows count once
    return (rows.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("h1", "h2")
            .agg(F.min_by("vec", "id").alias("vec"), F.sort_array(F.collect_set("id")).alias("ids")))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _rotated(x: np.ndarray, rotation: np.ndarray, top: float, query: bool) -> np.ndarray:
    """Extra column for inner product search, then the rotation."""
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0.0))
    return np.column_stack([x, extra]) @ rotation


def fit_lists(x: np.ndarray, n_lists: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids of the rows of x."""
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), n_lists, replace=False)]
    for _ in range(rounds):
        own = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=n_lists)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def adaptive_scan(x: np.ndarray, q: np.ndarray, k: int, epsilon: float = EPSILON) -> list[np.ndarray]:
    """For each query row, rows of x that the tests do not abandon (among them its k nearest, with high probability)."""
    dims, first = x.shape[1], min(len(x), 4 * k)
    near = (q * q).sum(axis=1)[:, None] + (x[:first] ** 2).sum(axis=1) - 2 * q @ x[:first].T
    tau = np.partition(near, min(k, first) - 1, axis=1)[:, min(k, first) - 1] if first >= k else np.full(len(q), np.inf)
    rest = x[first:]

    def passes(total, tau_, d):
        return total <= tau_ * (d / dims * (1 + (epsilon / np.sqrt(d) if d < dims else 0)) ** 2) + 1e-9

    total, d = np.zeros((len(q), len(rest))), 0
    alive = np.ones(total.shape, dtype=bool)
    while d < dims and alive.any() and alive.mean() > 0.2:      # dense while many are left
        stop = min(d + BLOCK, dims)
        u, v = q[:, d:stop], rest[:, d:stop]
        total += (u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * u @ v.T
        alive &= passes(total, tau[:, None], stop)
        d = stop
    a, b = np.nonzero(alive)
    total = total[a, b]
    for d in range(d, dims, BLOCK):
        stop = min(d + BLOCK, dims)
        total = total + ((q[a, d:stop] - rest[b, d:stop]) ** 2).sum(axis=1)
        keep = passes(total, tau[a], stop)
        a, b, total = a[keep], b[keep], total[keep]
    cuts = np.searchsorted(a, np.arange(len(q) + 1))
    return [np.concatenate([np.arange(first), first + b[cuts[i]:cuts[i + 1]]]) for i in range(len(q))]


def _tile(rotation, top: float, k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        x, q = _matrix(left.column("vec")), _matrix(right.column("vec"))
        ids = left.column("rep").to_numpy()
        h1, h2 = (right.column(c).to_numpy() for c in ("h1", "h2"))
        rows: list[list[np.ndarray]] = [[], [], [], []]
        if len(x) and len(q):
            xr, qr = _rotated(x, rotation, top, False), _rotated(q, rotation, top, True)
            found = (at for i in range(0, len(q), 64) for at in adaptive_scan(xr, qr[i:i + 64], k))
            for i, at in enumerate(found):
                score = (x[at] * q[i]).sum(axis=1)
                best = np.lexsort((ids[at], -score))[:k]
                for column, v in zip(rows, (np.full(len(best), h1[i]), np.full(len(best), h2[i]), score[best], ids[at][best])):
                    column.append(v)
        types = (np.int64, np.int32, np.float64, np.int64)
        return pa.table([pa.array(np.concatenate(c).astype(t) if c else np.zeros(0, t)) for c, t in zip(rows, types)],
                        names=["h1", "h2", "score", "rep"])

    return search


def _constant(values: list[int]):
    return F.from_json(F.lit(json.dumps(values)), "array<int>")


def _pilot_probes(indexed: DataFrame, pilot: np.ndarray, order: np.ndarray, k: int) -> int:
    """Fewest probes whose lists hold LIST_RECALL of the pilot's exact k nearest, over all vectors."""

    def exact(batches):
        for batch in batches:
            x, lists = _matrix(batch.column(0)), batch.column(1).to_numpy()
            if len(x):
                score = pilot @ x.T
                at = np.argpartition(-score, min(k, len(x)) - 1, axis=1)[:, :k]
                rows = np.repeat(np.arange(len(pilot)), at.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(score[rows, at.ravel()]),
                                                  pa.array(lists[at.ravel()], pa.int32())], names=["query", "score", "list"])

    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    truth = (indexed.select("vec", "list").mapInArrow(exact, "query int, score double, list int")
             .withColumn("r", best).where(F.col("r") <= k).select("query", "list").collect())
    place = np.argsort(order, axis=1)
    ranks = np.sort([place[r["query"], r["list"]] for r in truth])
    return max(MIN_PROBES, int(ranks[min(len(ranks) - 1, int(LIST_RECALL * len(ranks)))]) + 1)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            probes: int | None = None) -> DataFrame:
    """The k nearest rows of each query row by inner product: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``id``; ``probes`` None measures how many are needed. Ties go to the smaller id; a query's own row is no
    candidate (other rows of an equal vector are). Fewer than k candidates are returned all. Vectors that are null, zero, not
    finite, hold nulls or have another dimension than most take no part, nor do null ids. Repeated rows
    count once.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, id_col, vec_col)
    classes = settle(vector_classes(rows, k), "classes")
    n, top = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate(
        "vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, SAMPLE_ROWS / n)
    sample = _matrix(pa.array([r["vec"] for r in classes.where(
        F.pmod("h1", F.lit(1 << 20)) < share * (1 << 20)).select("vec").collect()] or [classes.first()["vec"]]))
    rotation = np.linalg.qr(np.random.default_rng(SEED).standard_normal((sample.shape[1] + 1,) * 2))[0]
    centres = fit_lists(_rotated(sample, rotation, top, False), int(min(MAX_LISTS, max(1, n ** 0.5), len(sample))))
    model = spark.sparkContext.broadcast((rotation, centres))       # at most MAX_LISTS centres

    def assign(batches):
        rotation_, centres_ = model.value
        for batch in batches:
            x = _rotated(_matrix(batch.column(2)), rotation_, top, False)
            own = ((centres_ * centres_).sum(axis=1) - 2 * x @ centres_.T).argmin(axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*batch.schema.names, "list"])

    named = classes.select("h1", "h2", "vec", F.col("ids")[0].alias("rep"))
    kind = classes.schema["vec"].dataType.simpleString()
    indexed = settle(named.mapInArrow(assign, f"h1 long, h2 int, vec {kind}, rep long, list int"), "lists")
    held = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([held.get(i, 0) for i in range(len(centres))])
    chunks = np.maximum(-(-sizes // CHUNK), 1)

    asked = rows.where(is_query).select("h1", "h2").distinct()
    questions = settle(named.join(asked, ["h1", "h2"], "left_semi").select("h1", "h2", "vec"), "queries")
    if probes is None:
        pilot = _matrix(pa.array([r["vec"] for r in questions.orderBy(F.xxhash64("h1", "h2"), "h1").limit(PILOT_QUERIES)
                                 .select("vec").collect()] or [classes.first()["vec"]]))
        q = _rotated(pilot, rotation, top, True)
        probes = _pilot_probes(indexed, pilot, ((centres * centres).sum(axis=1) - 2 * q @ centres.T).argsort(axis=1), k)

    def probe(batches):
        rotation_, centres_ = model.value
        for batch in batches:
            q = _rotated(_matrix(batch.column(2)), rotation_, top, True)
            if not len(q):
                continue
            order = ((centres_ * centres_).sum(axis=1) - 2 * q @ centres_.T).argsort(axis=1)
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            row, place = np.nonzero((np.arange(len(centres_)) < probes) | (before < 4 * (k + 1)))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns),
                                              pa.array(order[row, place], pa.int32())], names=["h1", "h2", "vec", "list"])

    probed = settle(questions.mapInArrow(probe, f"h1 long, h2 int, vec {kind}, list int"), "probes")
    loads = {r["list"]: r["n"] for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    blocks = [max(1, -(-loads.get(i, 0) // QUERY_BLOCK)) for i in range(len(centres))]
    n_chunks, n_blocks = _constant(chunks.tolist()), _constant(blocks)
    steps = lambda c: F.explode(F.sequence(F.lit(0), F.get(c, F.col("list")) - 1))
    left = indexed.select("list", F.pmod("h1", F.get(n_chunks, F.col("list"))).cast("int").alias("chunk"), steps(n_blocks).alias("block"), "rep", "vec")
    right = probed.select("list", steps(n_chunks).alias("chunk"),
                          F.pmod("h1", F.get(n_blocks, F.col("list"))).cast("int").alias("block"), "h1", "h2", "vec")
    tile = ["list", "chunk", "block"]
    hits = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(
        _tile(rotation, top, k + 1), "h1 long, h2 int, score double, rep long")
    best = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "rep"))
    kept = hits.withColumn("r", best).where(F.col("r") <= k + 1).drop("r")
    spread = kept.join(classes.select(F.col("ids")[0].alias("rep"), "ids"), "rep").select(
        "h1", "h2", "score", F.explode("ids").alias("vec_id"))
    queries = rows.where(is_query).select(F.col("id").alias("query_id"), "h1", "h2").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (queries.join(spread, ["h1", "h2"]).where("query_id <> vec_id").withColumn("rank", rank)
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
