"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is read field by field and rebuilt: normaliser (character map, extra
spaces), space marker, unigram scores or the merges that a BPE model's scores stand for, and byte
fallback. If no piece continues behind a space marker, a text's ids are those of its words, so
words are encoded once, in batches, on several threads, and kept in a bounded table. Of pairs with equal
scores sentencepiece merges the leftmost, a list of merges cannot: words in which such pairs can meet are
merged here. While a job runs, the normalised form of every text and the ids of every word that
enters the table are compared with the sentencepiece library; a difference stops it.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.chunks import ChunkTable
from cohortflow.llm.common import bounded_batches, text_slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)     # fixed values: piece types
UNIGRAM, BPE = 1, 2                                                    # fixed values: model types
BATCH_BYTES = 2 << 20
THREADS = 2
# fixed value: appended to a model file it leaves out character map, dummy prefix and squeezing (fields of a repeated
# message merge, the last value counts)
NO_NORMALISER = b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x01"


class ParityError(RuntimeError):
    """The rebuilt tokenizer and the sentencepiece library disagree on a text."""


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def protobuf_fields(raw: bytes):
    """(number, value) of a message's fields; values are ints or bytes, undecoded."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at:at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at:at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True

    @property
    def unknown_id(self) -> int:
        return self.types.index(UNKNOWN)

    @property
    def by_words(self) -> bool:
        """No piece goes on behind a marker that follows other characters, and none crosses a line end."""
        return not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p, t in zip(self.pieces, self.types)
                       if t in (NORMAL, USER_DEFINED))


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        raw = f.read()
    m = PieceModel()
    for number, value in protobuf_fields(raw):
        if number == 1:
            piece = {1: b"", 2: b"\0" * 4, 3: NORMAL} | dict(protobuf_fields(value))
            m.pieces.append(piece[1].decode("utf-8"))
            m.scores.append(struct.unpack("<f", piece[2])[0])
            m.types.append(piece[3])
        elif number == 2:
            spec = dict(protobuf_fields(value))
            m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(protobuf_fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze_spaces = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    return m


def bpe_merges(m: PieceModel) -> list[tuple[str, str]]:
    """Merges of a BPE model in order: better score of the result first, then the parts' ids."""
    ids = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types)) if t == NORMAL}
    found = [(-m.scores[i], ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, i in ids.items()
             for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    return [(a, b) for *_, a, b in sorted(found)]


def leftmost_merges(text: str, scores: dict[str, float]) -> list[str]:
    """Symbols of a text as sentencepiece merges them: the best score first, of equal ones the leftmost pair."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(-scores[text[i:i + 2]], i, i + 1, text[i:i + 2]) for i in range(len(parts) - 1) if text[i:i + 2] in scores]
    heapify(heap)
    while heap:
        _, i, j, whole = heappop(heap)
        if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != whole:
            continue
        parts[i], parts[j], after[i] = whole, None, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and parts[a] + parts[b] in scores:
                heappush(heap, (-scores[parts[a] + parts[b]], a, b, parts[a] + parts[b]))
    return [p for p in parts if p is not None]


def build_tokenizer(m: PieceModel):
    """tokenizers.Tokenizer on texts whose spaces are already markers."""
    from tokenizers import Tokenizer, models

    if m.kind == BPE:
        vocab = {p: i for i, p in enumerate(m.pieces)}
        return Tokenizer(models.BPE(vocab, bpe_merges(m), unk_token=m.pieces[m.unknown_id], fuse_unk=True,
                                    byte_fallback=m.byte_fallback))
    return Tokenizer(models.Unigram(list(zip(m.pieces, m.scores)), unk_id=m.unknown_id, byte_fallback=m.byte_fallback))


class Normaliser:
    """The model's normaliser: character map, spaces, dummy prefix. Spaces stay spaces."""

    def __init__(self, m: PieceModel):
        self.model, self.map = m, None
        if m.charsmap:
            from tokenizers import normalizers

            self.map = normalizers.Precompiled(m.charsmap)

    def __call__(self, text: bytes) -> bytes:
        out = text.replace(MARK.encode(), b" ")
        if self.map:
            out = self.map.normalize_str(out.decode("utf-8", "replace")).encode()
        if self.model.squeeze_spaces:
            out = re.sub(rb" +", b" ", out).strip(b" ")
        return b" " + out if out and self.model.dummy_prefix else out


class Codec:
    def __init__(self, path: str, threads: int = THREADS, **limits):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.path, self.model = path, read_model(path)
        self.normalise = Normaliser(self.model)
        self.tokenizer = build_tokenizer(self.model)
        self.split = re.compile(rb" *[^ \n]+| +|\n").findall if self.model.by_words else (lambda t: [t] if t else [])
        self.merged = {p: (i, s) for i, (p, s, t) in enumerate(zip(self.model.pieces, self.model.scores, self.model.types))
                       if t == NORMAL} if self.model.kind == BPE else {}
        self.scores = {p: s for p, (_, s) in self.merged.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.model.pieces, self.model.types)) if t == BYTE}
        long = [p for p in self.merged if len(p) > 1]
        count = Counter(self.scores[p] for p in long)
        tied = sorted((p for p in long if count[self.scores[p]] > 1), key=len)
        self.tied = re.compile("|".join(map(re.escape, tied))).search if tied else lambda _: None
        self.table = ChunkTable(self._learn, "I", **limits)
        values = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, " ").encode()
                  for p, t in zip(self.model.pieces, self.model.types)]
        self.sizes = np.array([len(v) for v in values])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.values = np.frombuffer(b"".join(values), dtype=np.uint8)

    def _learn(self, chunks: list[bytes]) -> list[list[int]]:
        texts = [c.decode("utf-8", "replace").replace(" ", MARK) for c in chunks]
        out = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for k, t in enumerate(texts):
            if self.merged and self._ties(t):
                out[k] = self._leftmost(t)
        for t, mine, theirs in zip(texts, out, self.peers[1].encode(texts, num_threads=1)):
            if mine != theirs:
                raise ParityError(f"ids differ on a word of {len(t)} characters: {t[:80]!r}")
        return out

    def _ties(self, text: str) -> bool:
        """Whether equal scores can meet: pieces that share a score, or a piece of several cuts, hence of three characters
        or more, at two places (then three characters are)."""
        return len(text) > 3 and len(set(zip(text, text[1:], text[2:]))) < len(text) - 2 or self.tied(text) is not None

    def _leftmost(self, text: str) -> list[int]:
        ids: list[int] = []
        for p in leftmost_merges(text, self.scores):
            if p in self.merged:
                ids.append(self.merged[p][0])
            elif self.model.byte_fallback:
                ids += [self.bytes[b] for b in p.encode()]
            elif ids[-1:] != [self.model.unknown_id]:
                ids.append(self.model.unknown_id)
        return ids

    @cached_property
    def peers(self):
        """The sentencepiece library on the model file, and on texts that are normalised already."""
        import sentencepiece

        with open(self.path, "rb") as f:
            raw = f.read()
        return (sentencepiece.SentencePieceProcessor(model_proto=raw),
                sentencepiece.SentencePieceProcessor(model_proto=raw + NO_NORMALISER))

    def _normalised(self, texts: list[bytes]) -> list[bytes]:
        out = [self.normalise(t) for t in texts]
        for t, mine, theirs in zip(texts, out, self.peers[0].normalize([t.decode("utf-8", "replace") for t in texts])):
            if mine.decode("utf-8", "replace").replace(" ", MARK) != theirs:
                raise ParityError(f"normalised forms differ on a text of {len(t)} bytes: {t[:80]!r}")
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text."""
        chunks, counts = [], np.empty(len(texts), dtype=np.int64)
        for k, t in enumerate(self._normalised(texts)):
            own = self.split(t)
            counts[k] = len(own)
            chunks += own
        return self.table.gather_texts(chunks, counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts of consecutive id lists; bytes of byte pieces are joined, the dummy prefix is dropped."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + sizes, sizes)
        raw = self.values[source].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        drop = int(self.model.dummy_prefix)
        return [raw[a + drop if b > a and raw[a:a + 1] == b" " else a:b] for a, b in zip(cuts, cuts[1:])]

    def verify(self, texts: list[bytes]) -> None:
        """Raise ParityError unless the sentencepiece library gives the same ids."""
        ids, counts = self.encode(texts)
        own = np.split(ids, np.cumsum(counts)[:-1]) if texts else []
        for t, mine, theirs in zip(texts, own, self.peers[0].encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)):
            if mine.tolist() != theirs:
                raise ParityError(f"ids differ on a text of {len(t)} bytes: {t[:80]!r}")


    def encode_checked(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """As ``encode``, and whether each text agrees with the library; one that does not gets the library's ids."""
        try:
            self.verify(texts[:1])
            return *self.encode(texts), [True] * len(texts)
        except ParityError:
            pass
        lists, parity = [], []
        for t in texts:
            try:
                self.verify([t])
                lists.append(self.encode([t])[0])
                parity.append(True)
            except ParityError:
                lists.append(np.array(self.peers[0].encode(t.decode("utf-8", "replace")), dtype=np.uint32))
                parity.append(False)
        return np.concatenate(lists), np.array([len(x) for x in lists], dtype=np.int64), parity


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model_path: str, id_cols: tuple[str, ...] = ("doc_id",),
                     text_col: str = "text") -> DataFrame:
    """The id columns and ``ids`` (array of int) of every text; null texts have none."""
    schema = T.StructType([*(docs.schema[c] for c in id_cols), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            for first, texts in text_slices(batch.column(len(id_cols)), BATCH_BYTES):
                ids, counts = c.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                                 pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(texts)) for i in range(len(id_cols))), lists],
                                                 names=schema.names)

    bounded_batches(docs.sparkSession)
    return docs.select(*id_cols, F.col(text_col).cast("binary")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The id columns and ``text`` of every id list; null lists give empty texts."""
    schema = T.StructType([*(encoded.schema[c] for c in id_cols), T.StructField("text", T.StringType())])

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            lists = [np.array(x or [], dtype=np.int64) for x in batch.column(len(id_cols)).to_pylist()]
            texts = c.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64),
                             np.array([len(x) for x in lists], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(id_cols))),
                                              pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())],
                                             names=schema.names)

    return encoded.select(*id_cols, "ids").mapInArrow(run, schema)


def codec_report(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32 (little-endian uint32), n_bytes decoded, round_trip, parity.

    ``round_trip``: the decoded ids are the normalised text, byte for byte. Null texts count as empty: no ids,
    round trip true. Every text is compared with the sentencepiece library: its normalised form, and its words as
    they enter the table; one text of each batch of some megabytes also as a whole. A text that differs has ``parity`` false
    and the library's ids. An empty table gives an empty result, a very long text is worked on whole. Repeated rows repeat; only doc_id and text are read.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                           T.StructField("n_bytes", T.LongType()), T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())])

    def run(batches):
        c = codec(model_path)
        drop = int(c.model.dummy_prefix)
        for batch in batches:
            for first, own in text_slices(batch.column(1), BATCH_BYTES):
                ids, counts, parity = c.encode_checked(own)
                raw, ends = memoryview(ids.astype("<u4").view(np.uint8)), 4 * np.cumsum(counts)
                crc = [zlib.crc32(raw[e - 4 * n:e]) for e, n in zip(ends.tolist(), counts.tolist())]
                back = c.decode(ids, counts)
                same = [b == c.normalise(t)[drop:] for b, t in zip(back, own)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(own)), pa.array(counts), pa.array(crc, pa.int64()),
                     pa.array([len(b) for b in back], pa.int64()), pa.array(same), pa.array(parity)], names=schema.names)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)
