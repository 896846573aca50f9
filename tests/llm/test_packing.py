import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortflow.llm.packing import best_configuration, pack_documents, plan_sequences
from cohortflow.llm.word_ids import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, tokenizer, capacity):
    expected = Counter()
    for i, t in texts:
        ids = ids_of(tokenizer, t)
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            expected[(i, p, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def best_fit(lengths, capacity):
    """Number of sequences of ordinary best-fit decreasing."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_documents(documents, texts, tokenizer):
    rows = pack_documents(documents, PATH).collect()
    n = check(rows, texts.items(), tokenizer, 2048)
    assert -(-sum(r["length"] for r in rows) // 2048) <= n <= best_fit([r["length"] for r in rows], 2048) * 1.01 + 1


def test_small_capacity_and_awkward_rows(awkward, no_documents, tokenizer):
    rows = pack_documents(awkward, PATH, 16).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()], tokenizer, 16)
    assert pack_documents(no_documents, PATH).count() == 0


def test_word_table_gives_the_tokenizers_ids(tokenizer):
    texts = ["The the THE, the. (the) it's IT'S can't", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>.", "T̈ ẗ é İ İ",
             "a\x1cb\x85c\xa0d", "x" * 3000, "日本語 ひらがな 한국어 é,ñ.", "1,234.56 $5% &c #tag a|b *", "", "Σας ΣΑΣ", "́x ̸< ,́", "a!̸."]
    for limit in (1_000_000, 5):
        table = WordIds(PATH, max_chunks=limit)
        for t in texts:
            ids, counts = table.encode([t.encode()])
            assert ids.tolist() == ids_of(tokenizer, t) and counts.tolist() == [len(ids)]
        ids, counts = table.encode([t.encode() for t in texts])
        assert ids.tolist() == [i for t in texts for i in ids_of(tokenizer, t)]


def test_capital_i_with_dot_before_punctuation(tokenizer):
    """Its lower case ends in a mark, and the tokenizer keeps a mark and the punctuation behind it together."""
    for t in ["HAKKI VE DENİZİ, SON", "İ. İ, İ? aİ! xİ;.", "İ̇, É, é. ß!", "DENİZ, DENİZİ."]:
        ids, _ = WordIds(PATH).encode([t.encode()])
        assert ids.tolist() == ids_of(tokenizer, t), t


def test_a_batch_looks_up_each_chunk_once(monkeypatch):
    """Chunks that a batch repeats, or that differ only in punctuation behind a word, cost one lookup together."""
    table, asked = WordIds(PATH), []
    gather = table.table.gather
    monkeypatch.setattr(table.table, "gather", lambda chunks: (asked.extend(chunks), gather(chunks))[1])
    table.encode([b"The cat, the cat. THE\tCAT! dog,cat"] * 50)
    assert sorted(asked) == [b"", b"!", b",", b",cat", b".", b"cat", b"dog", b"the"]


def test_plain_words_skip_the_steps_before_the_model(monkeypatch, tokenizer):
    table, sent = WordIds(PATH), []
    whole = table.tokenizer

    class Spy:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    monkeypatch.setattr(table, "tokenizer", Spy())
    text = "plain words only and one née " + " ".join(f"unheard{'of' * k}" for k in range(200))
    assert table.encode([text.encode()])[0].tolist() == ids_of(tokenizer, text)
    assert sent == ["née"]


@pytest.mark.parametrize("seed", range(3))
def test_random_batches_give_the_tokenizers_ids(seed, tokenizer):
    rng = random.Random(seed)
    parts = ["a", "Zo", "the", "it's", "'LL", "'", "é", "İ", "Σ", "中", "7", "42", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\xa0",
             ".", ",", "!?", "*", "$", "#", "|", "(", "<", "-", "\x00"]
    odd = ["\u0308", "\u0338", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "\u0345"]
    texts = ["".join(rng.choices(parts + odd * (k % 3 == 0), k=rng.choice([0, 0, 1, 3, 40]))) for k in range(400)]
    for limits in ({}, {"max_chunks": 7}):
        ids, counts = WordIds(PATH, **limits).encode([t.encode() for t in texts])
        expected = [ids_of(tokenizer, t) for t in texts]
        assert counts.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]
    ids, counts = WordIds(PATH).encode([b"", b" \n", b""])
    assert ids.tolist() == [0, 0, 0] and counts.tolist() == [1, 1, 1]


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 30, 6))
        prices = rng.random(len(lengths))
        best = np.zeros(41)
        for c in range(1, 41):
            best[c] = max([best[c - 1], *(best[c - n] + p for n, p in zip(lengths, prices) if n <= c)])
        got = best_configuration(lengths, prices, 40)
        assert sum(lengths[k] * a for k, a in got.items()) <= 40
        assert abs(sum(prices[k] * a for k, a in got.items()) - best[40]) < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_once(seed):
    rng = random.Random(seed)
    lengths = [min(int(rng.expovariate(1 / 300)) + 1, 2048) for _ in range(4000 * (seed + 1))]
    histogram = Counter(lengths)
    plan = plan_sequences(dict(histogram), 2048)
    used = Counter()
    for copies, times in plan:
        assert times > 0 and sum(n * a for n, a in copies.items()) <= 2048
        for n, a in copies.items():
            used[n] += a * times
    assert used == histogram
    lower = -(-sum(lengths) // 2048)
    assert lower <= sum(t for _, t in plan) <= 1.01 * lower + 2
