import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cohortflow.llm.sentencepiece_codec import (BPE, Codec, Normaliser, ParityError, PieceModel, build_tokenizer, codec_report,
                                                decode_documents, encode_documents, read_model)
from cohortflow.llm.token_counts import Counter, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "  a  b ", "\n\n x\n y", "a\tb", "日本語 text é ñ 😀😀", "a▁b ▁ c", "<s> </s> <0x0A> <unk>", "aaaaaaaaaaaaaaaaaaaaaaaa aaaa",
        "hello   world\n\n\n   code(x)=>{ return 1; }", "x" * 2000, "\x00\x01", " \n ", "trailing  "]


@pytest.fixture(scope="module")
def peer():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []


def test_model_file(peer):
    m = read_model(PATH)
    assert len(m.pieces) == peer.get_piece_size() and m.kind == BPE and m.byte_fallback and m.by_words
    assert [m.pieces[i] for i in (0, 300, 31999)] == [peer.id_to_piece(i) for i in (0, 300, 31999)]
    assert all(abs(m.scores[i] - peer.get_score(i)) < 1e-6 for i in range(259, 32000, 97))


def test_ids_and_round_trip_against_the_library(peer, texts):
    own = [t.encode() for t in [*texts.values(), *HARD]]
    c = Codec(PATH)
    ids, counts = c.encode(own)
    assert split(ids, counts) == peer.encode([t.decode() for t in own])
    assert [b.decode() for b in c.decode(ids, counts)] == [t.decode().replace("▁", " ") for t in own]
    small = Codec(PATH, max_chunks=3)
    assert split(*small.encode(own[-14:])) == peer.encode(HARD)


def test_equal_scores_merge_leftmost(peer):
    """Runs of the space marker share one score; so do the cuts of a piece that stands at two places."""
    runs = [a + " " * n + b for n in range(2, 65) for a in ("", "x", "x\n") for b in ("", "x", "\n")]
    again = ["a" * n for n in range(2, 40)] + ["ab" * 9, "-=" * 20, "banana" * 3, "é日" * 9, "\t" * 9, "/" * 33 + "x"]
    c = Codec(PATH)
    assert split(*c.encode([t.encode() for t in runs + again])) == peer.encode(runs + again)


def test_every_word_is_compared(monkeypatch):
    c = Codec(PATH)
    monkeypatch.setattr(c, "_ties", lambda t: False)        # merges in list order, wrong on runs of 17 spaces
    with pytest.raises(ParityError):
        c.encode([b"first text", b"second", b"x" + b" " * 17])
    c = Codec(PATH)
    monkeypatch.setattr(c, "normalise", lambda t: t)        # no dummy prefix
    with pytest.raises(ParityError):
        c.encode([b"first text"])


def test_parity_check_notices(monkeypatch):
    c = Codec(PATH)
    c.verify([b"fine text"])
    c.table.add([b" wrong"], [[7]])
    with pytest.raises(ParityError):
        c.verify([b"wrong"])


def test_one_odd_text_does_not_end_the_others(peer):
    c = Codec(PATH)
    c.table.add([b" wrong"], [[7]])
    own = [b"fine text", b"wrong", b"", b"wrong again"]
    # a word that the table holds is not compared again: only whole texts are
    ids, counts, parity = c.encode_checked(own[1:2])
    assert parity == [False] and ids.tolist() == peer.encode("wrong") and counts.tolist() == [len(ids)]
    ids, counts, parity = c.encode_checked(own[1:])
    assert parity == [False, True, False] and split(ids, counts) == peer.encode([t.decode() for t in own[1:]])


def test_unigram_model_and_normaliser():
    m = PieceModel(["<unk>", "▁", "a", "b", "ab", "▁a"], [0.0, -3.0, -2.0, -2.5, -3.0, -2.2], [2, 1, 1, 1, 1, 1], squeeze_spaces=True)
    assert Normaliser(m)(b"  a   b ") == b" a b"
    assert build_tokenizer(m).encode("▁ab").tokens == ["▁a", "b"]


def test_documents(documents, texts, peer):
    rows = codec_report(documents, PATH).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows)
    for r in rows[:60]:
        ids = peer.encode(texts[r["doc_id"]])
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    back = decode_documents(encode_documents(documents, PATH), PATH).collect()
    assert {r["doc_id"]: r["text"] for r in back} == texts


def test_awkward_rows(awkward, no_documents):
    rows = codec_report(awkward, PATH).collect()
    assert len(rows) == awkward.count() and codec_report(no_documents, PATH).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_ids"] == 0 and by[2]["round_trip"] and by[7]["n_bytes"] == 150000
    assert encode_documents(awkward, PATH).where(F.size("ids") == 0).count() == 2
    counts = {r["doc_id"]: r["n_tokens"] for r in count_tokens(awkward, PATH).collect()}
    assert counts[2] == counts[3] == 0 and counts[7] > 0 and count_tokens(no_documents, PATH).count() == 0


def unigram(model):
    from tokenizers import Tokenizer, models, normalizers

    t = Tokenizer(models.Unigram(list(zip(model.pieces, model.scores)), unk_id=model.unknown_id, byte_fallback=model.byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def test_counts_against_the_unigram_tokenizer(documents, texts):
    reference = unigram(read_model(PATH))
    rows = count_tokens(documents, PATH).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {k: len(reference.encode(t).ids) for k, t in texts.items()}
    n, _ = Counter(read_model(PATH)).count([t.encode() for t in HARD])
    assert n.tolist() == [len(reference.encode(t).ids) for t in HARD]


@pytest.mark.parametrize("scores", [[0.0, -1.0, -2.0, -2.0, -4.0, -3.0, -6.0], [0.0, -1.1, -2.3, -2.3, -4.6, -3.4, -6.9]])
def test_ties_and_unknown_runs(scores):
    """Equal scores of different cuts, and unknown characters without byte fallback."""
    m = PieceModel(["<unk>", "▁", "a", "b", "ab", "▁a", "aba"], scores, [2, 1, 1, 1, 1, 1, 1], squeeze_spaces=False)
    reference, c = unigram(m), Counter(m)
    for t in ["ab", "aba abab", "xx a", "axxb\n\nxa", "ababab" * 5, "x", "a x x b"]:
        assert c.count([t.encode()])[0].tolist() == [len(reference.encode(t).ids)], t
