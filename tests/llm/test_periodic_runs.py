import hashlib
import random
import zlib

import numpy as np
import pytest

from cohortflow.llm.periodic_runs import lag_scan, periodic_runs, runs_report, split_by_frequency


def brute_runs(w, min_words=6, exponent=4):
    """All runs by the definition: every lag, every stretch, smallest period."""
    out, n = {}, len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_words, exponent * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in out.items())


def rewritten(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc_id, text):
    words = rewritten(doc_id, text)
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(kept))


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_documents_against_brute_force(documents, texts):
    short = {i for i, t in texts.items() if len((t or "").split()) < 1500}
    rows = runs_report(documents).collect()
    assert len(rows) == len(texts) and len(short) > 150
    for r in rows:
        if r["doc_id"] in short:
            assert tuple(r[c] for c in NAMES) == expected(r["doc_id"], texts[r["doc_id"]])
    assert any(r["n_runs"] for r in rows) and not all(r["n_runs"] for r in rows)


def scan(w, min_words=6, exponent=4):
    w = np.array(w, dtype=np.int64)
    begins, ends = split_by_frequency(w, np.array([0]), min_words, exponent)
    inner = np.concatenate([np.arange(a, b) for a, b in zip(begins, ends)] or [np.zeros(0, np.int64)])
    stops = np.cumsum(ends - begins)
    runs = lag_scan(w[inner], stops - (ends - begins), stops, min_words, exponent)
    return sorted((int(inner[s]), int(e - s), int(q)) for s, e, q in runs)


@pytest.mark.parametrize("exponent", [3, 4, 5])
def test_random_words_against_brute_force(exponent):
    rng = random.Random(7)
    for _ in range(400):
        w = []
        while len(w) < rng.randint(0, 120):
            block = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
            w += block * rng.choice([1, 1, 2, 4, 5, 7]) + block[:rng.randint(0, len(block))]
        assert scan(w, 6, exponent) == brute_runs(w, 6, exponent)


def test_hash_collisions_are_caught():
    # the Thue-Morse sequence collides under any prefix hash modulo 2**64
    word = [bin(i).count("1") & 1 for i in range(1 << 12)]
    assert scan(word * 5) == [(0, 5 << 12, 1 << 12)]


def test_segments_split_to_stability():
    w = np.array([1, 2, 1, 2, 1, 2, 1, 2, 9, 1, 1, 3, 3, 3, 3, 3, 3, 3])
    begins, ends = split_by_frequency(w, np.array([0, 11]), 6, 4)
    assert list(zip(begins, ends)) == [(0, 8), (11, 18)]


def test_very_long_texts_stay_fast(spark):
    texts = ["word " * 300000, "a b c " * 100000 + "x " + "a b " * 50000, " ".join(str(i % 701) for i in range(200000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periodic_runs(df).collect()}
    runs = {k: [tuple(x) for x in r["runs"]] for k, r in rows.items()}
    assert runs == {0: [(0, 300000, 1)], 1: [(0, 300000, 3), (300001, 100000, 2)], 2: [(0, 200000, 701)]}
    assert rows[1]["collapsed"] == "a b c x a b"


CASES = [None, "", " \n", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x a a a a a a y a a a a a a",
         "é é é é é é é", "a\x0ba\x0ca\ra\na\ta", "a a a a a a a", "a a b a a b a a b a a b a a", "p q r s " * 4]


def test_cases_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for r in runs_report(df).collect():
        assert tuple(r[c] for c in NAMES) == expected(r["doc_id"], CASES[r["doc_id"]])


def test_awkward_rows(awkward, no_documents):
    rows = runs_report(awkward).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == awkward.count() and runs_report(no_documents).count() == 0
    assert by[2]["n_runs"] == by[3]["n_runs"] == 0 and by[2]["start"] is None
    text = "word " * 30000
    assert tuple(by[7][c] for c in NAMES[:5]) == (1, 0, 30000, 1, 30000000) and len(rewritten(7, text)) == 30000
    assert sum(r["doc_id"] == 8 for r in rows) == 2 and None in by
