"""Periodic runs of words: stretches that repeat one block four times or more, found exactly.

Recursive frequency splitting: a run of exponent e holds each of its words e times or more, so a word that occurs
less often in its segment is in no run and splits the segment there. Segments are counted and split
again until nothing changes; those left are short or truly repetitive. A lag scan then looks
for runs in them. A run of period q and length 4q covers three whole blocks of q words at multiples of q, so
lag q compares only neighbouring blocks, by differences of a prefix hash (m log m comparisons for a
segment of m words); the ends of a run are found by bisection on the same hash, and every run found is checked
word by word. If a check fails, the segment is scanned again without hashes.

A run lies inside one surviving segment and no neighbouring word extends it across the segment's border: such a
word would be part of a longer run, and had not split the segment.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import NON_SPACE, bounded_batches, text_slices

MIN_WORDS = 6
MIN_EXPONENT = 4            # three at least, see the block comparison
BATCH_BYTES = 2 << 20       # text that a task holds as Python objects, but for a longer single text
PAIRS = 1 << 20             # block pairs compared at once
BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"


def split_by_frequency(words: np.ndarray, starts: np.ndarray, min_words: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable segments (first word, end) of texts that lie one after the other; ``starts`` are the texts' first words.

    In a stable segment every word occurs ``need`` times or more.
    """
    at = np.arange(len(words))
    segment = np.searchsorted(starts, at, side="right")
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        # segments are consecutive in `at`; short ones hold no run
        borders = np.nonzero(np.diff(segment))[0] + 1
        first = np.concatenate([[0], borders])
        sizes = np.diff(np.concatenate([first, [len(at)]]))
        long_enough = np.repeat(sizes >= min_words, sizes)
        at, segment = at[long_enough], np.repeat(np.arange(len(sizes)), sizes)[long_enough]
        if not len(at):
            break
        _, inverse, counts = np.unique(segment * np.int64(words.max() + 1) + words[at], return_inverse=True, return_counts=True)
        rare = counts[inverse] < need
        split = np.bincount(segment, weights=rare, minlength=segment[-1] + 1) > 0
        stable = ~split[segment]
        if stable.any():
            own, place = segment[stable], at[stable]
            begin = np.concatenate([[True], own[1:] != own[:-1]])
            done.append((place[begin], place[np.concatenate([begin[1:], [True]])] + 1))
        left = ~stable & ~rare
        at, segment = at[left], segment[left]
        if len(at):
            segment = np.cumsum(np.concatenate([[True], (segment[1:] != segment[:-1]) | (np.diff(at) > 1)]))
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(begins)
    return begins[order], ends[order]


def _prefix_hash(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of hashed words times powers of BASE (modulo 2**64), and the powers."""
    power = np.full(len(words) + 1, BASE)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    x = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((x ^ (x >> np.uint64(32))) * power[:-1], dtype=np.uint64)]), power


def _plain_scan(w: np.ndarray, min_words: int, exponent: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of one segment by comparing it with itself at every lag."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // exponent + 1):
        equal = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edges = np.nonzero(equal[1:] != equal[:-1])[0]
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b + q - a >= max(min_words, exponent * q):
                found.setdefault((a, b + q), q)
    return [(a, b, q) for (a, b), q in found.items()]


def lag_scan(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS,
             exponent: int = MIN_EXPONENT) -> np.ndarray:
    """All runs in the segments: rows (start, end, period), by start, then period."""
    lags = (ends - begins) // exponent
    owner = np.repeat(np.arange(len(begins)), lags)
    q_all = np.arange(len(owner)) - np.repeat(np.cumsum(lags) - lags, lags) + 1
    pairs = (ends - begins)[owner] // q_all - 1 if len(owner) else np.zeros(0, np.int64)
    total = np.cumsum(pairs)
    prefix, power = _prefix_hash(words)

    def equal(a, q, n):
        """Whether n words from a are those from a + q."""
        return (prefix[a + n] - prefix[a]) * power[q] == prefix[a + q + n] - prefix[a + q]

    def furthest(fits, most):
        """Largest n up to ``most`` for which ``fits``; it holds for 0 and for all below the largest."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            ok = fits(middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low

    rows = []
    first = 0
    while first < len(owner):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS, side="right")))
        n = pairs[first:last]
        lag = np.repeat(np.arange(first, last), n)
        q = q_all[lag]
        a = begins[owner[lag]] + (np.arange(len(lag)) - np.repeat(np.cumsum(n) - n, n)) * q
        hit = equal(a, q, q)
        for _ in range(exponent - 3):       # as many neighbouring pairs as a run covers
            hit[:-1] &= hit[1:] & (lag[1:] == lag[:-1])
            hit[-1:] = False
        # one candidate for consecutive hits of a lag
        hit[1:] &= ~(hit[:-1] & (lag[1:] == lag[:-1]))
        a, q, own = a[hit], q[hit], owner[lag[hit]]
        if len(a):
            right = furthest(lambda m: equal(a, q, m), ends[own] - q - a)
            left = furthest(lambda m: equal(a - m, q, m), a - begins[own])
            start, end = a - left, a + q + right
            good = end - start >= np.maximum(min_words, exponent * q)
            rows.append(_shortest_periods(np.stack([start[good], end[good], q[good], own[good]], axis=1)))
        first = last
    if not rows:
        return np.zeros((0, 3), np.int64)
    runs = _shortest_periods(np.concatenate(rows))
    bad = {int(o) for s, e, q, o in runs.tolist()
           if not np.array_equal(words[s:e - q], words[s + q:e])
           or (s > begins[o] and words[s - 1] == words[s - 1 + q]) or (e < ends[o] and words[e] == words[e - q])}
    if bad:
        again = [(begins[o] + s, begins[o] + e, q) for o in bad
                 for s, e, q in _plain_scan(words[begins[o]:ends[o]], min_words, exponent)]
        runs = runs[~np.isin(runs[:, 3], list(bad))][:, :3]
        runs = np.concatenate([runs, np.array(again, dtype=np.int64).reshape(-1, 3)])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))][:, :3]


def _shortest_periods(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period, ...) with one start and end that with the shortest period: the others are its multiples."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def _scan_texts(texts: list[bytes], min_words: int, exponent: int) -> tuple[list[list[dict]], list[bytes], list[int]]:
    """Runs, collapsed text and number of words of each text."""
    split = [t.split() for t in texts]
    sizes = [len(s) for s in split]
    stops = np.cumsum(sizes)
    starts = stops - sizes
    numbers: dict[bytes, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for s in split for w in s), np.int64, int(stops[-1]))
    full = starts[np.array(sizes) > 0]
    begins, ends = split_by_frequency(words, full, min_words, exponent)
    # only the segments are hashed
    inner = np.repeat(begins - np.cumsum(ends - begins) + (ends - begins), ends - begins) + np.arange((ends - begins).sum())
    offsets = np.cumsum(ends - begins)
    runs = lag_scan(words[inner], offsets - (ends - begins), offsets, min_words, exponent)
    runs[:, :2] += (inner[runs[:, 0]] - runs[:, 0])[:, None]
    text_of = np.searchsorted(stops, runs[:, 0], side="right")
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 1], -1)
    keep = np.cumsum(covered[:-1]) == 0
    found: list[list[dict]] = [[] for _ in texts]
    for k, (s, e, q) in zip(text_of.tolist(), runs.tolist()):
        found[k].append({"start": s - int(starts[k]), "length": e - s, "period": q})
    collapsed = [b" ".join(compress(s, keep[a:a + len(s)].tolist()) if f else s) for s, a, f in zip(split, starts.tolist(), found)]
    return found, collapsed, sizes


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", min_words: int = MIN_WORDS,
                  min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Columns ``keep``, n_words, runs (array of start, length, period by start, then period) and collapsed text.

    Words are separated by ASCII white space. A run is a stretch of words with smallest period q and a length of
    at least max(min_words, min_exponent * q) that no neighbouring word extends. The collapsed text keeps
    each run's first q words only, joined by single spaces. Null and empty texts have no words and no runs;
    repeated rows repeat; an empty table gives an empty result. One narrow stage: a text is worked on whole in
    one task, in memory proportional to it; other columns are not read.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent is three at least")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep"), F.col(text_col).cast("binary").alias("text"))

    def scan(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column(1), BATCH_BYTES):
                runs, collapsed, sizes = _scan_texts(texts, min_words, min_exponent)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(sizes, pa.int64()),
                     pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                     pa.array(collapsed, pa.binary())], names=["keep", "n_words", "runs", "collapsed"])

    schema = f"keep {rows.schema['keep'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed binary"
    return rows.mapInArrow(scan, schema).select("keep.*", "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents (by the checksum of doc_id) repeat a block of words to their end.

    With h the checksum and g = h div 10, words from a = g mod n on repeat with period
    1 + (n - a) div (3 + g mod 8) where h mod 10 = 0. Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, 1, a), F.slice(tail, 1, n - a)))

    # the words are bound once, as the element of a one-element array
    words = F.array(F.regexp_extract_all("text", F.lit(NON_SPACE), F.lit(0)))
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(F.transform(words, planted)[0], "text")).otherwise(
        F.col("text")).alias("text"))


def runs_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, the strongest run and hashes of all runs and of the collapsed text.

    Documents are those of ``with_planted_repeats``. The strongest run has the greatest length / period, ties to the
    smallest start, then period; without runs its four columns are null and the hash of runs is the empty string's. Null
    and empty texts have no words; a row without doc_id is not rewritten; repeated rows repeat.
    """
    found = periodic_runs(with_planted_repeats(docs.select("doc_id", "text")))
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"),
                       lambda a, r: F.when(better(a, r), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", "best.start", "best.length", "best.period",
             F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
             "runs_sha256", "collapsed_sha256")
