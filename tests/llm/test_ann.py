import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm.ann import adaptive_scan, nearest

SF = "/root/testdata/sf0.1"


def exact(ids, x, query, k):
    scores = x @ x[list(ids).index(query)]
    order = np.lexsort((ids, -scores))
    return [(int(ids[i]), scores[i]) for i in order if ids[i] != query][:k]


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=np.float32).astype(float)
    got = by_query(nearest(df, F.col("id") % 20 == 0).collect())
    assert sorted(got) == sorted(int(i) for i in ids if i % 20 == 0)
    hits = total = 0
    for q, found in got.items():
        best = exact(ids, x, q, 20)
        hits += len({v for v, _ in best} & {v for v, _ in found})
        total += len(best)
        at = {int(i): k for k, i in enumerate(ids)}
        assert all(abs(s - x[at[v]] @ x[at[q]]) < 1e-12 for v, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len(found) == 20
    assert hits / total >= 0.9


def test_unequal_norms_ties_copies_and_invalid_vectors(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((60, 5)) * rng.uniform(0.1, 9, (60, 1))).astype(np.float32)
    x[10:45] = x[10]                                        # more copies than are asked for
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    bad = [(100, None, "x"), (120, [0.0] * 5, "x"), (140, [1.0, None, 1.0, 1.0, 1.0], "x"), (160, [float("nan")] * 5, "x"),
           (180, [float("inf")] * 5, "x"), (200, [1.0, 2.0], "x"), (None, [9.0] * 5, "x"), (220, [], "x")]
    df = spark.createDataFrame(rows + rows[:25] + bad, "vec_id long, embedding array<float>, rank string")
    got = by_query(nearest(df, F.col("id") % 20 == 0, k=20).collect())
    ids, wide = np.arange(60), x.astype(float)
    assert sorted(got) == [0, 20, 40]
    for q, found in got.items():
        assert [v for v, _ in found] == [v for v, _ in exact(ids, wide, q, 20)]


def test_fewer_candidates_than_asked_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert by_query(nearest(df, F.col("id") == 0).collect()) == {0: [(1, 0.5), (2, -1.0)]}
    assert nearest(df.where("false"), F.col("id") == 0).count() == 0
    assert nearest(df.where("vec_id = 0"), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_scan_keeps_nearest_and_abandons(clustered):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64)) + (8 * rng.standard_normal((10, 64)))[rng.integers(0, 10, 1500)] * clustered
    q = x[:30] + 0.1 * rng.standard_normal((30, 64))
    rotation = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    found = adaptive_scan(x @ rotation, q @ rotation, 10)
    kept = np.mean([len(f) for f in found])
    best = [set(np.argsort(((x - v) ** 2).sum(axis=1))[:10]) for v in q]
    assert np.mean([len(b & set(f)) / 10 for b, f in zip(best, found)]) > 0.97 and kept < 1500
