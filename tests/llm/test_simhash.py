import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import cohortflow.llm.simhash as simhash
from cohortflow.llm.components import connected_components
from cohortflow.llm.simhash import grid_masks, links, near_duplicates, text_fingerprint, unary_counts


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids):
    """Smallest id reachable over links of at most three bits, by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def check(rows, texts):
    fps = [fingerprint(t) for t in texts]
    assert [int(r["fingerprint"], 16) for r in rows] == fps and all(len(r["fingerprint"]) == 16 for r in rows)
    assert [r["component_id"] for r in rows] == components(fps, [r["doc_id"] for r in rows])


def test_documents_against_all_pairs(documents, texts):
    rows = near_duplicates(documents).collect()
    assert len(rows) == len(texts)
    check(rows, [texts[r["doc_id"]] for r in rows])


def test_awkward_rows(awkward, no_documents):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == awkward.count() and near_duplicates(no_documents).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] == "0" * 16 and {by[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert by[6]["component_id"] == 1 and by[8]["component_id"] == 8 and by[None]["component_id"] is None


def test_spark_hash_is_the_shingle_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("é x y"))).first()[0] % 2 ** 64 == xxhash.xxh64_intdigest("é x y".encode(), 42)
    assert text_fingerprint("A b C") == text_fingerprint("a B c")


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1])
def test_links_on_planted_neighbourhoods(spark, monkeypatch, crowd):
    """Chains and balls of fingerprints, with ordinary cells and with every shared cell tiled."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(1)
    fps = set()
    for base in rng.integers(0, 2 ** 63, 30).tolist():
        for _ in range(12):
            fps.add(base)
            base ^= sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 5), replace=False))
    fps = sorted(fps)
    pairs = links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3).collect()
    assert all((r["a"] ^ r["b"]).bit_count() <= 3 for r in pairs)
    roots = {r["node"]: r["root"] for r in connected_components(
        spark.createDataFrame([(r["a"], r["b"]) for r in pairs], "a long, b long")).collect()}
    assert [roots.get(f, f) for f in fps] == components(fps, fps)


def test_counts_bound_the_distance_and_masks_cover(spark):
    x, y = 0x0123456789ABCDEF, 0x0123456789ABCDEF ^ 0b10110
    codes = spark.createDataFrame([(x,), (y,)], "fp long").select(unary_counts(F.col("fp"))).collect()
    assert ((codes[0][0] ^ codes[1][0]) % 2 ** 64).bit_count() <= (x ^ y).bit_count()
    for n in (0, 10, 10 ** 6, 10 ** 9):
        masks = [m % 2 ** 64 for m in grid_masks(n, 3)]
        for changed in ([0, 1, 2], [0, 20, 40], [61, 62, 63]):      # any three bits leave a mask untouched
            assert any(not any(m >> b & 1 for b in changed) for m in masks)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert set(roots.values()) == {0, 1000} and len(roots) == 301


def test_crowded_cells_of_several_tiles_against_brute_force(spark):
    # 20,000 fingerprints that differ in twenty weak bits only, thinned so that some are alone, and a distant group
    rng = np.random.default_rng(8)
    weak = np.sort(rng.choice(64, 20, replace=False))
    base = int(rng.integers(0, 2 ** 62))
    codes = np.unique(rng.integers(0, 2 ** 20, 6000))
    fps = [base ^ sum(1 << int(weak[b]) for b in range(20) if c >> b & 1) for c in codes.tolist()]
    fps += [(base ^ (0xFFFF << 20)) ^ (1 << b) for b in range(30)]
    signed = sorted({f - 2 ** 64 if f >= 2 ** 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = connected_components(links(df)).collect()
    root = {r["node"]: r["root"] for r in found}
    x = np.array(signed, dtype=np.int64).view(np.uint64)
    label = np.arange(len(x))
    while True:
        low = label.copy()
        for i in range(len(x)):
            near = np.bitwise_count(x[i] ^ x) <= 3
            low[i] = label[near].min()
        low = low[low]
        if (low == label).all():
            break
        label = low
    want = {}
    for f, k in zip(signed, label.tolist()):
        want.setdefault(k, []).append(f)
    groups = {}
    for f in signed:
        groups.setdefault(root.get(f, f), []).append(f)
    assert sorted(groups.values()) == sorted(want.values()) and max(map(len, want.values())) > 4000
