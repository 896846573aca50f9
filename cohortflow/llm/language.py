"""Language identification of whole texts, with spans for texts that mix languages.

A word's script (by Unicode range) narrows its candidate languages to those whose training
texts use the script; hashed character n-grams give it a log-probability under each
candidate. Viterbi over the words, with a constant penalty for changing the language, labels spans. The
text's language is the one that holds most letters; its score is the share of letters it holds.

Most texts are in one language. There the best constant labelling is proved optimal without
dynamic programming: if no run of words gains more than the penalty by any other labels, no
path with a switch is better.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import bounded_batches, release_memory, text_slices

TRAIN_DOCS = 5000       # labelled documents of one language that the model is fitted on, at most (expected)
BUCKETS = 1 << 15       # hashed n-grams of one language
ORDERS = (2, 3, 4)
PENALTY = 15.0          # nats that a change of language costs
SCRIPT_SHARE = 0.001    # share of a language's letters from which it counts as written in a script
MAX_WORDS = 60_000      # scored words of one generation; a worker keeps two
UNKNOWN = "und"
BATCH_BYTES = 1 << 19

WORD = re.compile(r"[^\W\d_]+")
# first code points of the ranges that tell scripts apart; a range ends where the next begins
SCRIPTS = np.array([0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xB00, 0xC00, 0xD00, 0xE00, 0xF00,
                    0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xAC00, 0xD7B0,
                    0xF900, 0x10000, 0x20000])


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(words: list[str]):
    """For each order: bucket and word number of every character n-gram, word borders included."""
    codes = _codes(words).astype(np.uint64)
    space = codes == 32
    word = np.cumsum(space) - 1
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        inner, h = np.ones(m, dtype=bool), np.full(m, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[k:k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            if 0 < k < n - 1:
                inner &= ~space[k:k + m]
        owner = np.where(space[1:m + 1], word[:m], word[1:m + 1]) if n == 2 else word[1:m + 1]
        yield (h[inner] >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), owner[inner]


def word_scripts(words: list[str]) -> np.ndarray:
    return np.searchsorted(SCRIPTS, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), side="right") - 1


@dataclass
class LanguageModel:
    """Languages (sorted), log-probabilities (language x bucket) and scripts (language x script) in use."""

    languages: list[str]
    logp: np.ndarray
    scripts: np.ndarray
    penalty: float = PENALTY
    _known: dict = field(default_factory=dict, repr=False)
    _scores: list = field(default_factory=list, repr=False)
    _old: tuple | None = field(default=None, repr=False)

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for bucket, owner in _grams(words):
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(owner, weights=self.logp[k][bucket], minlength=len(words))[:len(words)]
        allowed = self.scripts[:, word_scripts(words)].T
        out -= out.max(axis=1, keepdims=True)
        # a script that no language uses says nothing; otherwise only its languages are candidates
        return np.where(allowed, out, np.where(allowed.any(axis=1, keepdims=True), -50.0, 0.0)) \
            if len(words) else out

    def _lookup(self, words: list[str]) -> np.ndarray:
        missing = list(set(words) - self._known.keys())
        if missing and len(self._known) + len(missing) > MAX_WORDS:
            # words met again move on to the next generation, the others are forgotten with the old one
            self._old = (self._known, np.concatenate(self._scores)) if self._scores else None
            self._known, self._scores, missing = {}, [], list(set(words))
        if missing:
            if self._old:
                again = [w for w in missing if w in self._old[0]]
                self._add(again, self._old[1][np.fromiter(map(self._old[0].__getitem__, again), np.int64, len(again))])
                missing = [w for w in missing if w not in self._known]
            self._add(missing, self.word_scores(missing).astype(np.float32))
            if len(self._scores) > 8:
                self._scores = [np.concatenate(self._scores)]
        at = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
        return np.concatenate(self._scores)[at].astype(np.float64) if self._scores else np.zeros((0, len(self.languages)))

    def forget(self) -> None:
        """Drop the scored words."""
        self._known, self._scores, self._old = {}, [], None

    def _add(self, words: list[str], scores: np.ndarray) -> None:
        base = len(self._known)
        self._known.update(zip(words, range(base, base + len(words))))
        self._scores.append(scores)

    def label(self, word_lists: list[list[str]]) -> list[np.ndarray]:
        """Language number of every word of every text (texts without words: empty)."""
        sizes = np.array([len(w) for w in word_lists], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        out: list[np.ndarray] = [np.zeros(n, dtype=np.int64) for n in sizes]
        full = np.nonzero(sizes)[0]
        if not len(full) or len(self.languages) < 2:
            return out
        scores = self._lookup([w for ws in word_lists for w in ws])
        main = np.add.reduceat(scores, starts[full], axis=0).argmax(axis=1)
        of = np.repeat(main, sizes[full])
        rest = scores.copy()
        rest[np.arange(len(of)), of] = -np.inf
        gain = rest.max(axis=1) - scores[np.arange(len(of)), of]
        # best run of gains in each text: running sums that fall by a large step where a text begins
        marks = starts[full] + np.arange(len(full))
        path = np.cumsum(np.insert(gain, starts[full], -1e8))
        runs = np.maximum.reduceat(path - np.minimum.accumulate(path), marks)
        for k, main_k, run in zip(full, main, runs):
            out[k][:] = main_k
        self._viterbi([k for k, run in zip(full, runs) if run > self.penalty], scores, starts, sizes, out)
        return out

    def _viterbi(self, texts: list[int], scores, starts, sizes, out) -> None:
        texts = sorted(texts, key=lambda k: -sizes[k])
        labels = len(self.languages)
        while texts:
            # texts of falling length, as many as fit a table of eight million cells
            longest = int(sizes[texts[0]])
            group, texts = texts[:max(1, 8_000_000 // (longest * labels))], texts[max(1, 8_000_000 // (longest * labels)):]
            n, at = sizes[group], starts[group]
            back = np.zeros((longest, len(group), labels), dtype=np.int16)
            value = scores[at].copy()
            final = np.zeros(len(group), dtype=np.int64)
            alive = len(group)
            own = np.arange(labels)
            for t in range(1, longest + 1):
                ended = alive
                while alive and n[alive - 1] <= t:
                    alive -= 1
                if ended > alive:
                    final[alive:ended] = value[alive:ended].argmax(axis=1)
                if not alive:
                    break
                v = value[:alive]
                best = v.argmax(axis=1)
                switch = (v[np.arange(alive), best] - self.penalty)[:, None]
                stay = v >= switch
                back[t, :alive] = np.where(stay, own, best[:, None])
                value[:alive] = np.where(stay, v, switch) + scores[at[:alive] + t]
            for j, k in enumerate(group):
                state = final[j]
                for t in range(int(n[j]) - 1, -1, -1):
                    out[k][t] = state
                    state = back[t, j, state]


def is_held_out(id_col: str) -> Column:
    """Remainder 2 of crc32 of the id's text by 4; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(labelled: DataFrame, train_docs: int = TRAIN_DOCS, penalty: float = PENALTY) -> LanguageModel:
    """Fit on rows (key, text, lang) without null texts or labels: about ``train_docs`` rows of each language.

    The rows of a language are drawn by a hash of ``key``; counts are summed by Spark, and only
    ``BUCKETS`` counts of each language reach the driver.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    scripts = np.zeros((len(languages), len(SCRIPTS)))
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, train_docs / sizes[k]))]),
                             F.col("lang"))
        drawn = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

        def count(batches):
            for rows in batches:
                for lang, texts in rows.groupby("lang")["text"]:
                    words = pd.Series([w for t in texts for w in WORD.findall(t.lower())], dtype=object).value_counts()
                    if not len(words):
                        continue
                    names, times = list(words.index), words.to_numpy()
                    total = sum(np.bincount(b, weights=times[w], minlength=BUCKETS) for b, w in _grams(names))
                    script = np.bincount(word_scripts(names), weights=times, minlength=len(SCRIPTS))
                    at, sc = np.nonzero(total)[0], np.nonzero(script)[0]
                    yield pd.DataFrame({"lang": lang, "slot": np.concatenate([at, BUCKETS + sc]),
                                        "n": np.concatenate([total[at], script[sc]]).astype(np.int64)})

        for r in (drawn.mapInPandas(count, "lang string, slot long, n long")
                  .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toLocalIterator()):
            k = languages.index(r["lang"])
            if r["slot"] < BUCKETS:
                counts[k, r["slot"]] = r["n"]
            else:
                scripts[k, r["slot"] - BUCKETS] = r["n"]
    logp = np.log(counts + 0.5) - np.log((counts + 0.5).sum(axis=1, keepdims=True))
    used = scripts >= SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True)
    return LanguageModel(languages, logp.astype(np.float32), used & (scripts > 0), penalty)


def detect(texts: list[str | None], model: LanguageModel) -> list[tuple[str, float]]:
    """Language and score of each text; ``und`` and 0 for null texts and texts without a letter."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    words = [w if any(c.isalpha() for x in w for c in x) else [] for w in words]
    out = []
    for own, labels in zip(words, model.label(words)):
        if not own or not model.languages:
            out.append((UNKNOWN, 0.0))
            continue
        letters = np.bincount(labels, weights=[len(w) for w in own], minlength=len(model.languages))
        best = int(letters.argmax())
        out.append((model.languages[best], float(letters[best] / letters.sum())))
    return out


def language_spans(text: str | None, model: LanguageModel) -> list[tuple[int, int, str]]:
    """Maximal runs of words in one language: (start, stop, language) in code points."""
    found = list(WORD.finditer(text.lower() if text and len(text.lower()) == len(text) else text or ""))
    labels = model.label([[m[0].lower() for m in found]])[0]
    out: list[list] = []
    for m, label in zip(found, labels if model.languages else []):
        if out and out[-1][2] == model.languages[label]:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end(), model.languages[label]])
    return [tuple(x) for x in out]


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The input with lang_pred and score added (columns of these names must not exist)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)     # BUCKETS numbers of each language

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        try:
            for texts in batches:
                found = [x for _, part in text_slices(texts, BATCH_BYTES) for x in detect([t.decode("utf-8", "replace") for t in part], own)]
                yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()),
                                                  pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])
        finally:
            own.forget()
            release_memory()

    return docs.withColumn("__found", predict(F.col(text_col).cast("binary"))).withColumns(
        {"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}).drop("__found")


def fit_on_documents(docs: DataFrame) -> LanguageModel:
    """Model of the labelled documents that are not held out; null ids, texts and labels teach nothing."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                       & ~is_held_out("doc_id"))
    return fit_languages(learn.select(F.col("doc_id").alias("key"), "text", "lang"))


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could be
    learned. Ties go to the language that sorts first. Repeated rows repeat, an empty table gives an empty result; other columns are not
    read. Very long texts are labelled whole, in one task.
    """
    model = fit_on_documents(docs)
    found = predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
