"""Monte-Carlo p-value of Pearson's chi-square for level x 2 tables.

Under the null with both margins fixed, the first group's column of a random
table is a multivariate hypergeometric draw (Patefield's conditional tables); for
a single-level table (goodness of fit to equal shares) the two cells are a fair
binomial split.

    p = (1 + #{replicates with X2* >= X2_obs * (1 - 64 eps)}) / (B + 1)

Levels with one row total are exchangeable, so a table is its classes (row total, number of
levels): at most sqrt(2 N) of them, however many levels there are. Replicates are cut into a
fixed number of chunks, one small row each; a chunk simulates the classes in order of their
row total, vectorised over its replicates: a draw for the class as a whole, then halving its levels until they
are alone, all halves of a depth at once and no more than CELLS of them. All levels of row total one (an ID-like
covariate) are a single draw. Streams are seeded by (seed, covariate, chunk), so the p-value
does not depend on partitions, executors or the number of levels.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Fixed value: replicates per table.
DEFAULT_REPLICATES = 5000
ALMOST_ONE = 1 - 64 * 2.220446049250313e-16
CHUNKS = 64
CELLS = 1 << 21             # numbers (replicates times levels) that a task holds at once
# numpy's exact sampler takes arguments below this
SAMPLER_LIMIT = 10 ** 9


def _rng(seed: int, covariate: str, chunk: int) -> np.random.Generator:
    key = zlib.crc32(str(covariate).encode("utf-8"))
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, key, chunk])))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: np.ndarray) -> np.ndarray:
    """Good items among ``draws`` items taken from ``good + bad``, at any size.

    Beyond the exact sampler's range: few good items are a binomial of the sampling fraction
    (total variation at most good / total, kept below 1e-4); otherwise the variance is large and a rounded
    normal is used (error of the order of one over the standard deviation).
    """
    total = good + bad
    if good < SAMPLER_LIMIT and bad < SAMPLER_LIMIT:
        return rng.hypergeometric(good, bad, draws)
    share = draws / total
    if good <= 1e-4 * total:
        x = rng.binomial(good, share)
    elif bad <= 1e-4 * total:
        x = draws - rng.binomial(bad, share)
    else:
        spread = np.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1)))
        x = np.rint(rng.normal(draws * (good / total), spread)).astype(np.int64)
    return np.clip(x, np.maximum(0, draws - bad), np.minimum(good, draws))


def simulate(rng: np.random.Generator, totals: list[int], levels: list[int], c1: int, n: int, replicates: int) -> np.ndarray:
    """Pearson statistics of random tables with row-total classes (totals, levels) and group-1 total c1."""
    c2 = n - c1
    if sum(levels) == 1:                                # goodness of fit: fair split of all n observations
        y = rng.binomial(n, 0.5, size=replicates)
        return 2 * (y - n / 2.0) ** 2 / (n / 2.0)
    stat = np.zeros(replicates)
    left, rest = np.full(replicates, c1, dtype=np.int64), n
    for t, m in zip(totals, levels):
        e1, e2 = t * c1 / n, t * c2 / n
        if t == 1:
            x = hypergeometric(rng, m, rest - m, left) if rest > m else left
            stat += x * ((1 - e1) ** 2 / e1 + e2) + (m - x) * (e1 + (1 - e2) ** 2 / e2)
            left, rest = left - x, rest - m
            continue
        x = hypergeometric(rng, t * m, rest - t * m, left) if rest > t * m else left
        for level in halved(rng, t, m, x):
            stat += ((level - e1) ** 2 / e1 + (t - level - e2) ** 2 / e2).sum(axis=1)
        left, rest = left - x, rest - t * m
    return stat


def halved(rng: np.random.Generator, t: int, m: int, drawn: np.ndarray):
    """Deal ``drawn`` items (one number per replicate) to m levels of t items: arrays (replicate, level) of blocks of levels.

    A block of levels is halved by one hypergeometric draw per replicate, so m levels take log m steps; blocks of more
    than CELLS numbers are dealt one half after the other.
    """
    if m > 1 and m * len(drawn) > CELLS:
        first = m // 2
        x = hypergeometric(rng, t * first, t * (m - first), drawn)
        yield from halved(rng, t, first, x)
        yield from halved(rng, t, m - first, drawn - x)
        return
    sizes, items = np.array([m]), drawn[:, None]
    while (sizes > 1).any():
        halves, dealt = [], []
        for size in np.unique(sizes):          # two sizes at most
            own = items[:, sizes == size]
            if size == 1:
                halves.append(np.ones(own.shape[1], dtype=np.int64))
                dealt.append(own)
                continue
            a, b = int(size) // 2, int(size) - int(size) // 2
            x = hypergeometric(rng, t * a, t * b, own)
            halves += [np.full(own.shape[1], a), np.full(own.shape[1], b)]
            dealt += [x, own - x]
        sizes, items = np.concatenate(halves), np.concatenate(dealt, axis=1)
    yield items


def _chunk_hits(it, seed: int, replicates: int):
    """Rows (covariate, totals, levels, C1, N, stat, chunk) -> (covariate, hits)."""
    for pdf in it:
        hits = []
        for r in pdf.itertuples(index=False):
            k = replicates * (r.chunk + 1) // CHUNKS - replicates * r.chunk // CHUNKS
            sims = simulate(_rng(seed, r.covariate, r.chunk), [int(t) for t in r.totals], [int(m) for m in r.levels],
                            int(r.C1), int(r.N), k)
            hits.append(int((sims >= ALMOST_ONE * r.stat).sum()))
        yield pd.DataFrame({"covariate": pdf["covariate"], "hits": hits})


def monte_carlo_p(ct: DataFrame, tests: DataFrame, replicates: int = DEFAULT_REPLICATES, seed: int = 42) -> DataFrame:
    """``covariate, p_mc`` for covariates whose ``test`` is ``chisq_mc``.

    ``ct``: ``covariate, level, n1, n2``; ``tests``: ``covariate, test, stat, r, C1, C2``
    (one row per covariate).
    """
    sel = materialize(tests.where(F.col("test") == "chisq_mc").select(
        "covariate", "stat", "C1", (F.col("C1") + F.col("C2")).alias("N")))
    classes = (ct.join(sel.select("covariate"), "covariate", "left_semi")
               .groupBy("covariate", (F.col("n1") + F.col("n2")).alias("total")).agg(F.count(F.lit(1)).alias("levels")))
    # one row per covariate: its distinct row totals
    per_cov = (classes.groupBy("covariate").agg(F.sort_array(F.collect_list(F.struct("total", "levels"))).alias("c"))
               .join(sel, "covariate")
               .select("covariate", F.col("c.total").alias("totals"), F.col("c.levels").alias("levels"), "C1", "N", "stat",
                       F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("chunk")))
    hits = (per_cov.repartition(CHUNKS, "covariate", "chunk")
            .mapInPandas(lambda it: _chunk_hits(it, seed, replicates), "covariate string, hits long")
            .groupBy("covariate").agg(F.sum("hits").alias("hits")))
    return hits.select("covariate", ((F.col("hits") + 1) / F.lit(float(replicates + 1))).alias("p_mc"))
