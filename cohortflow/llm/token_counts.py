"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists, for every end position, the vocabulary pieces that end there,
longest first. Dynamic programming carries only the best score and the number of pieces of the
best path to each position, no back pointers. Ties follow the tokenizer library's
unigram rule: positions are extended from left to right and a path replaces another only if it scores strictly
better, so the longest last piece wins; a character that no one-character piece
covers may be unknown, at the lowest score less 10, and comes after all pieces. Unknown characters count one
piece per UTF-8 byte (byte fallback) or one per run.

Pieces never cross from a word into the next one's space marker, so best paths run through every word start and
texts are counted word by word; a bounded table keeps words. Sums are exact for the integral scores of
the vocabulary; a vocabulary with other scores or with pieces across words is counted on whole texts.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.chunks import ChunkTable
from cohortflow.llm.common import bounded_batches, text_slices
from cohortflow.llm.sentencepiece_codec import MARK, Normaliser, PieceModel, read_model

UNKNOWN_PENALTY = 10.0
BATCH_BYTES = 2 << 20


class Counter:
    def __init__(self, model: PieceModel, **limits):
        self.model, self.normalise = model, Normaliser(model)
        self.automaton = ahocorasick.Automaton()
        for p, s in zip(model.pieces, model.scores):
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min(model.scores) - UNKNOWN_PENALTY
        pieces = set(model.pieces)
        self.bytes = model.byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        crossing = any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        exact = all(float(s).is_integer() for s in model.scores)
        # without byte fallback a run of unknown characters may go on behind a line end
        words = re.compile(rb" *[^ \n]+| +|\n" if self.bytes else rb" *[^ ]+| +")
        self.split = words.findall if not crossing and exact else lambda t: [t] if t else []
        self.table = ChunkTable(lambda chunks: [self.best(c.decode("utf-8", "replace").replace(" ", MARK)) for c in chunks],
                                "d", **limits)

    def best(self, text: str) -> tuple[float, float]:
        """Number of pieces and score of the best path."""
        n = len(text)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        top, pieces, single, at = None, 0, False, 1     # best piece that ends at ``at``, so far

        def unknown_before(e: int) -> None:
            """Settle position e where no one-character piece ends: the character may be unknown."""
            last = score[e - 1] + self.unknown
            if top is None or last > top:
                size = len(text[e - 1].encode("utf-8", "replace")) if self.bytes else not unknown[e - 1]
                score[e], count[e], unknown[e] = last, count[e - 1] + size, True
            else:
                score[e], count[e] = top, pieces

        for last, (size, s) in self.automaton.iter(text):       # by end, then longest first
            while at <= last:
                if single:
                    score[at], count[at] = top, pieces
                else:
                    unknown_before(at)
                at, top, single = at + 1, None, False
            start = last + 1 - size
            gain = score[start] + s
            if top is None or gain > top:
                top, pieces = gain, count[start] + 1
            if size == 1:
                single = True
        while at <= n:
            if single:
                score[at], count[at] = top, pieces
            else:
                unknown_before(at)
            at, top, single = at + 1, None, False
        return float(count[n]), score[n]

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and best score of every text."""
        chunks, counts = [], np.empty(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            own = self.split(self.normalise(t))
            counts[k] = len(own)
            chunks += own
        numbers, _ = self.table.gather(chunks)
        sums = np.concatenate([np.zeros((1, 2)), np.cumsum(numbers.reshape(-1, 2), axis=0)])
        cuts = np.concatenate([[0], np.cumsum(counts)])
        out = np.diff(sums[cuts], axis=0)
        return out[:, 0].astype(np.int64), out[:, 1]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter of a model file."""
    if path not in _counters:
        _counters[path] = Counter(read_model(path))
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, n_tokens and path_score of every text.

    Null and empty texts have no tokens and score 0. Repeated rows repeat; other columns are not read.
    """

    bounded_batches(docs.sparkSession)
    @F.arrow_udf("struct<n_tokens:bigint,path_score:double>")
    def count(texts: pa.Array) -> pa.Array:
        parts = [counter(model_path).count(part) for _, part in text_slices(texts, BATCH_BYTES)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[i] for p in parts]) if parts else [], t)
                                           for i, t in ((0, pa.int64()), (1, pa.float64()))], names=["n_tokens", "path_score"])

    return docs.select(F.col(id_col), count(F.col(text_col).cast("binary")).alias("c")).select(id_col, "c.*")
