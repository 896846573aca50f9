import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import cohortflow.llm.suffix_dedup as suffix_dedup
from cohortflow.llm.suffix_dedup import remove_repeats, repeats_report


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, hash, kept bytes) of every text by counting all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i:i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        mask = np.zeros(len(x), dtype=bool)
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                mask[i:i + length] = True
        kept = bytes(b for b, m in zip(x, mask) if not m)
        spans = sum(bool(m) and not (i and mask[i - 1]) for i, m in enumerate(mask))
        out.append((len(x), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def synthetic():
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.choice([0, 30, 100, 400]))) for _ in range(40)]
    texts = ["".join(rng.choices(parts, k=3)) for _ in range(80)]
    return texts + [None, "", "a" * 900, "ab" * 300, "é" * 150, parts[5] * 7, "x" * 199, "y" * 200, "z" * 201]


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 2])
@pytest.mark.parametrize("length", [40, 200])
def test_synthetic_texts_against_brute_force(spark, monkeypatch, crowd, length):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    texts = synthetic()
    rows = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length, with_text=True).collect()
    expected = brute(texts, length)
    for r in rows:
        e = expected[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == e[:4]
        assert r["kept_text"] == e[4].decode("utf-8", "ignore")


@pytest.mark.parametrize("depth", [8, 9, 40, 64, 200])
def test_suffix_array_orders_by_bytes(depth):
    rng = random.Random(depth)
    for raw in (b"", b"a", bytes(300), b"ab" * 200, bytes(rng.choice(b"ab") for _ in range(700)),
                bytes(rng.randrange(256) for _ in range(500)) * 3):
        order, rank = suffix_dedup.suffix_array(np.frombuffer(raw, dtype=np.uint8), depth)
        inside = [i for i in order.tolist() if i + depth <= len(raw)]
        strings = [raw[i:i + depth] for i in inside]
        assert strings == sorted(strings) and sorted(order.tolist()) == list(range(len(raw)))
        for i, j, s, t in zip(inside, inside[1:], strings, strings[1:]):
            assert (rank[i] == rank[j]) == (s == t)


def test_documents_against_brute_force(documents, texts):
    ids = list(texts)
    expected = dict(zip(ids, brute([texts[i] for i in ids], 200)))
    rows = repeats_report(documents).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == {
        k: v[:4] for k, v in expected.items()}
    assert any(r["n_removed"] for r in rows)


def test_awkward_rows(awkward, no_documents):
    rows = repeats_report(awkward).collect()
    assert len(rows) == awkward.count() and repeats_report(no_documents).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_bytes"] == 0 and by[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[7]["n_removed"] == 150000 and by[1]["n_removed"] == 0


def test_short_windows_are_refused(documents):
    with pytest.raises(ValueError):
        remove_repeats(documents, 20)


def test_places_are_the_same_in_any_batch():
    """Phrases depend on the text alone, not on what lies before it in a batch."""
    text = ("".join(random.Random(5).choice("abcdefgh ") for _ in range(3000))).encode()
    alone = suffix_dedup._phrases([text], 200)
    among = suffix_dedup._phrases([b"q" * 777, b"", text, b"short"], 200)
    mine = among[1] == 2
    for a, b in zip(alone[2:5], among[2:5]):
        assert (a == b[mine] - 777).all()


def test_groups_are_cut_between_whole_kappas(monkeypatch):
    import pyarrow as pa

    from cohortflow.llm import suffix_dedup

    seen = []
    monkeypatch.setattr(suffix_dedup, "_runs_twice", lambda table, length: seen.append(table.column(0).to_pylist()))
    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64())], names=["kappa"]) for k in ([1, 1, 2], [2, 2], [2, 3, 3, 4], [5])]
    assert len(list(suffix_dedup._twice_in_groups(batches, 3))) == len(seen)
    assert seen == [[1, 1], [2, 2, 2, 2, 3, 3], [4], [5]]
