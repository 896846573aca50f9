"""Quality rules: counts per text and a short-circuit cascade of rejection rules.

The cascade is one CASE expression: a text leaves it at the first rule that rejects it, so
the order of the rules decides what it costs and not what it answers. The order comes from a
sample: each rule is timed on its own over the same cached rows (cost), the share it rejects
is counted (selectivity), and rules run by rejection per cost, best first.

DataFrame expressions only. Null and empty texts have no words and are not kept; repeated rows
give repeated rows; only the id and text columns are read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import NON_SPACE

SAMPLE_ROWS = 2000         # rows that the order of the rules is estimated on, about
REPEATS = 3                # timed runs of a rule; the fastest counts
WINDOW = 5
SYMBOLS = "#*$%&|<>"       # fixed values
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


@dataclass(frozen=True)
class QualityRule:
    name: str
    rejects: Column


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, rf"[^{SYMBOLS}]+", ""))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NON_SPACE))
    return F.aggregate(F.array(lines), F.lit(0), lambda _, x: F.size(x) - F.size(F.array_distinct(x)))


def window_hashes(words: Column) -> Column:
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.aggregate(
        F.array(hashed), F.array().cast("array<bigint>"),
        lambda _, h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
                                 lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])))


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside a five-word window that stands at least twice in the text.

    Distinct hashes rule out most texts in linear time. The rest is decided on the windows'
    words: windows sorted with their positions stand next to their equals, and the union of
    the repeated windows is measured by the gaps between their positions.
    """
    at = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
                     lambda w, i: F.struct(F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, WINDOW)])
                                           .alias("w"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.aggregate(
        F.array(F.sort_array(at)), F.lit(0), lambda _, s: _covered(F.array_sort(F.transform(
            F.filter(s, lambda x, i: (x["w"] == F.get(s, i - 1)["w"]) | (x["w"] == F.get(s, i + 1)["w"])),
            lambda x: x["i"]))))).otherwise(0)


def _covered(starts: Column) -> Column:
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                       lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"),
                                             (p + WINDOW).alias("end")), lambda a: a["n"])


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word, symbol, line and repetition counts of whole texts, with ``text`` and ``words`` kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(id_col, text.alias("text"),
                        F.regexp_extract_all(text, F.lit(NON_SPACE), F.lit(0)).alias("words"))
    hashed = words.withColumn("hashes", window_hashes(F.col("words")))
    return hashed.select(
        id_col, "text", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        n_symbols(F.col("text")).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("hashes")).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def default_rules() -> tuple[QualityRule, ...]:
    """Rejection rules over ``text_counts`` columns; thresholds leave ordinary prose alone."""
    n, text = F.col("n_words"), F.col("text")
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    digits = F.length(F.regexp_replace(text, r"[^0-9]+", ""))
    lines = F.size(F.split(text, "\n", -1))
    longest = F.array_max(F.transform("words", F.length))
    bullets = F.regexp_count(text, F.lit(r"(?m)^\s*[•●▪‣*-]\s"))
    dots = F.regexp_count(text, F.lit(r"(?m)(?:\.\.\.|…)\s*$"))
    braces = F.length(text) - F.length(F.regexp_replace(text, r"[{}]+", ""))
    bangs = F.length(text) - F.length(F.regexp_replace(text, "!+", ""))
    return (
        QualityRule("mean_word_length", (F.col("word_chars") < 1.5 * n) | (F.col("word_chars") > 25 * n)),
        QualityRule("symbols", F.col("n_symbols") > 0.4 * n),
        QualityRule("duplicate_lines", F.col("n_dup_lines") > 0.3 * lines),
        QualityRule("capitals", capitals > 0.7 * letters),
        QualityRule("few_letters", letters < 0.4 * F.col("word_chars")),
        QualityRule("digits", digits > 0.3 * F.col("word_chars")),
        QualityRule("longest_word", longest > 1000),
        QualityRule("bullets", bullets > 0.9 * lines),
        QualityRule("ellipses", dots > 0.3 * lines),
        QualityRule("braces", braces > 0.2 * n),
        QualityRule("exclamation", bangs > 0.4 * n),
    )


def draw_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """About ``rows`` documents drawn by a hash of id and text, from all partitions alike; all, if there are fewer."""
    share = min(1.0, rows / max(docs.count(), 1))
    return docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < int(share * (1 << 30)))


def plan_cascade(sample: DataFrame, rules: tuple[QualityRule, ...], repeats: int = REPEATS) -> list[dict]:
    """Cost and selectivity of each rule on counted sample rows, best rejection per cost first.

    A rule's cost is its fastest run of ``repeats``, less that of an empty rule. The sample decides the order of the rules and nothing else.
    """
    sample = sample.persist()
    try:
        total = max(sample.count(), 1)

        def timed(column: Column) -> tuple[float, int]:
            runs = []
            for _ in range(repeats):
                start = time.perf_counter()
                n = sample.agg(F.coalesce(F.sum(F.when(column, 1)), F.lit(0))).first()[0]
                runs.append(time.perf_counter() - start)
            return min(runs), n

        idle = timed(F.lit(False))[0]
        measured = []
        for r in rules:
            seconds, rejected = timed(r.rejects)
            measured.append({"rule": r, "cost": max(seconds - idle, 1e-4), "selectivity": rejected / total})
    finally:
        sample.unpersist()
    return sorted(measured, key=lambda m: (-m["selectivity"] / m["cost"], m["cost"], m["rule"].name))


def cascade(rules: list[QualityRule]) -> Column:
    """Name of the first rule that rejects, null for a kept text; later rules are not evaluated."""
    verdict = F.when(base_failed(), "base")
    for r in rules:
        verdict = verdict.when(r.rejects, r.name)
    return verdict.otherwise(F.lit(None))


def judge_quality(docs: DataFrame, rules: tuple[QualityRule, ...] | None = None,
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts and verdict per document: doc_id, counts, base_failed, kept, rejected_by."""
    order = [m["rule"] for m in plan_cascade(text_counts(draw_sample(docs, sample_rows)), rules or default_rules())]
    counted = text_counts(docs)
    return (counted.withColumn("rejected_by", cascade(order))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base_failed().alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by"))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept.

    Null texts have no words and fail the base rule, as do empty ones; repeated rows repeat; an empty table gives an empty result; other
    columns are not read. Rules of equal rejection per cost run by cost, then name. A very long text is counted whole, in one task.
    """
    # which rule rejected first depends on the measured order, so it is left out here
    return judge_quality(docs).drop("rejected_by")
