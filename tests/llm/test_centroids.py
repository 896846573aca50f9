import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm.centroids import Bounds, cluster_vectors, clusters_report, integer_vectors, squared_distances
from cohortflow.llm.sql import centroid_clustering

SF = "/root/testdata/sf0.001"


def brute(ids, vectors, k=40, rounds=5):
    """Lloyd's rounds in Python integers."""
    order = sorted((i for i in range(len(ids)) if ids[i] is not None),
                   key=lambda i: (hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), vectors[i]))[:k]
    c = [list(vectors[i]) for i in order]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for v in vectors]
        for j in set(own):
            members = [v for v, o in zip(vectors, own) if o == j]
            c[j] = [sum(x) // len(members) for x in zip(*members)]
    return [nearest(v)[::-1] for v in vectors], c


def test_against_sql(spark):
    rows = clusters_report(spark.read.parquet(f"{SF}/embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cur = con.execute(centroid_clustering())
    names = [d[0] for d in cur.description]
    assert rows.columns == names and sorted(map(tuple, rows.collect())) == sorted(cur.fetchall())


def test_random_vectors_with_ties_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (700, 5)).tolist()
    ids = [None if i % 50 == 0 else i // 2 for i in range(700)]
    df = spark.createDataFrame([(i, x) for i, x in zip(ids, v)], "id long, v array<long>").repartition(5)
    got, history = cluster_vectors(df, k=12, rounds=6)
    rows, c = brute(ids, v, 12, 6)
    assert history[-1].tolist() == c and len(history) == 7
    assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in got.collect()) == sorted((str(i), *x) for i, x in zip(ids, rows))


@pytest.mark.parametrize("reach", [300, 1 << 26])
def test_bounds_give_what_comparing_everything_gives(reach):
    rng = np.random.default_rng(5)
    centres = rng.integers(-reach, reach, (9, 16))
    x = centres[rng.integers(0, 9, 3000)] + rng.integers(-reach // 20, reach // 20, (3000, 16))
    history = [x[:9].copy()]
    state = Bounds.exact(x, history[0])
    for t in range(1, 9):
        history.append(np.stack([x[state.cluster == j].sum(axis=0) // max(1, (state.cluster == j).sum()) for j in range(9)]))
        state.evaluated[:] = 0
        state.advance(x, history)
        d = squared_distances(x, history[-1])
        assert (d.argmin(axis=1) == state.cluster).all()
        assert (state.upper.astype(float) ** 2 * 1.0001 + 1 >= 0).all() and (d == ((x[:, None] - history[-1]) ** 2).sum(axis=2)).all()
    assert state.evaluated.mean() < 3       # of nine distances


def test_awkward_vectors(spark):
    good = [float(i) for i in range(64)]
    rows = [(1, good), (1, good), (2, None), (3, []), (4, good[:63]), (5, good[:63] + [None]), (6, good[:63] + [float("nan")]),
            (7, good[:63] + [float("inf")]), (None, good), (8, [0.0] * 64), (9, [-0.001] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {c: F.lit("x") for c in ("id", "v", "cluster", "distance", "upper", "lower")})
    out = clusters_report(df).collect()
    assert sorted(str(r["vec_id"]) for r in out) == ["1", "1", "8", "9", "None"]
    assert all(r["distance"] == r["inertia"] == r["cluster_inertia"] == 0 for r in out)
    assert integer_vectors(df, "vec_id", "embedding").where("id = 9").first()["v"] == [-1] * 64
    assert clusters_report(df.where("false")).count() == 0 and clusters_report(df.where("vec_id IS NULL")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        clusters_report(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>"))
