"""Per-subject merge of flat entity tables (left joins with suffix rules) and the
column classification that runs on the merged table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import df_num

# Columns never offered for analysis. Distribution and Table 1
# card candidates drop names *starting with* a prefix; the refreshed Table 1
# list drops exact names.
DISTRIBUTION_PREFIXES = ["id", "dst_id", "dst_name", "created_datetime", "updated_datetime"]
CARD_PREFIXES = ["id", "dst_id", "dst_name"]
IGNORED_COVARIATES = ["id", "dst_id", "dst_name", "created_datetime", "updated_datetime"]
# Fixed value: share of parseable values from which a column counts as numeric.
NUMERIC_SHARE = 0.9


def _q(n: str):
    return F.col(f"`{n}`")


def left_join_suffixed(x: DataFrame, y: DataFrame, x_key: str, y_key: str,
                       suffix: tuple[str, str], link: str | None = None, how: str = "left") -> DataFrame:
    """``x`` LEFT JOIN ``y`` ON x_key <=> y_key, naming like a dplyr left join.

    The left key survives, the right key is dropped; a left non-key column that
    clashes with a right non-key column gets ``suffix[0]``; a right non-key column
    that clashes with any left column gets ``suffix[1]``. NULL keys match NULL keys.
    Rows fan out when a subject has several right rows. ``link`` names a column of both sides that stands for
    their keys and is never null; it is joined on instead and kept once.
    """
    y_aux = [c for c in y.columns if c not in (y_key, link)]
    xa, ya = x.alias("_x"), y.alias("_y")
    x_out = [F.col(f"_x.`{c}`").alias(c if (c == x_key or c not in y_aux) else c + suffix[0]) for c in x.columns]
    y_out = [F.col(f"_y.`{c}`").alias(c + suffix[1] if c in x.columns else c) for c in y_aux]
    cond = (F.col(f"_x.`{x_key}`").eqNullSafe(F.col(f"_y.`{y_key}`")) if link is None
            else F.col(f"_x.`{link}`") == F.col(f"_y.`{link}`"))
    return xa.join(ya, cond, how).select(*x_out, *y_out)


def merge_entities(subject: DataFrame, person: DataFrame,
                   entities: Sequence[tuple[str, DataFrame]] = ()) -> DataFrame:
    """subject LEFT JOIN person, then LEFT JOIN each selected entity on its relation."""
    merged = left_join_suffixed(subject, person, "dst_id", "id", ("_subject", "_person"))
    return reduce(lambda acc, ne: left_join_suffixed(acc, ne[1], "id", "dst_id", ("", f"_{ne[0]}")),
                  entities, merged)


def card_candidates(columns: Sequence[str]) -> list[str]:
    """Columns that a Table 1 card may be opened for (C3: by name prefix)."""
    return analysis_columns(columns, CARD_PREFIXES)


def covariate_candidates(columns: Sequence[str]) -> list[str]:
    """Columns of the refreshed Table 1 list (C4: by exact name)."""
    return analysis_columns(columns, IGNORED_COVARIATES, mode="exact")


def analysis_columns(columns: Sequence[str], names: Sequence[str] = DISTRIBUTION_PREFIXES,
                     mode: str = "prefix") -> list[str]:
    """Columns left after dropping ignored ones (by name prefix or exact name)."""
    if mode == "prefix":
        return [c for c in columns if not any(c.startswith(p) for p in names)]
    return [c for c in columns if c not in names]


def column_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric-or-categorical decision for each column, on the (fanned-out) merged rows.

    Share = parseable values / max(1, rows whose value is not the empty string);
    NULL rows stay in the denominator, so a numeric column with over 10% missing
    counts as categorical. One aggregate computes every column's counts in a
    single scan; the result has one row per column.
    """
    cols = list(columns) if columns is not None else analysis_columns(df.columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_numeric bigint, n_nonempty bigint, "
                                                   "numeric_share double, is_numeric boolean")
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.count(df_num(df, c)).alias(f"n{i}"))
        aggs.append(F.count_if(_non_empty(c)).alias(f"d{i}"))
    return _typed(df.agg(*aggs), cols)


def _non_empty(c: str) -> Column:
    return _q(c).isNull() | (_q(c).cast("string") != "")


def _typed(row: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column from one row of counts (n0, d0, n1, ...)."""
    stacked = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_numeric"), F.col(f"d{i}").alias("n_nonempty"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")
    share = F.col("n_numeric") / F.greatest(F.lit(1), F.col("n_nonempty"))
    return stacked.select("column", "n_numeric", "n_nonempty", share.alias("numeric_share"),
                          (share >= NUMERIC_SHARE).alias("is_numeric"))


def dataset_shape(df: DataFrame) -> DataFrame:
    """Row and column counts of the merged table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"))


@dataclass(frozen=True)
class Merge:
    """The merged table as its parts, for counts over its rows without building them.

    A subject's merged rows are the product of its person rows and its rows of every entity. So a count
    over merged rows is a sum over subject rows of products: what one part counts for the subject times the
    numbers of rows of the other parts. Each part is aggregated by its key first (one row per key, partial sums before the
    shuffle), and the joins to the subjects are one to one: no subject's records multiply.
    """

    subject: DataFrame
    person: DataFrame
    entities: Sequence[tuple[str, DataFrame]] = field(default_factory=tuple)

    def frame(self) -> DataFrame:
        return merge_entities(self.subject, self.person, self.entities)

    def sources(self) -> list[tuple[str, int, str]]:
        """(name in the merged table, part, column of the part); part 0 is the subject, 1 the person, then the entities."""
        out = [(c, 0, c) for c in self.subject.columns]
        joins = [(self.person, "dst_id", "id", ("_subject", "_person")),
                 *((e, "id", "dst_id", ("", f"_{n}")) for n, e in self.entities)]
        for k, (y, x_key, y_key, suffix) in enumerate(joins, 1):
            aux, names = [c for c in y.columns if c != y_key], {n for n, _, _ in out}
            out = ([(n if n == x_key or n not in aux else n + suffix[0], i, c) for n, i, c in out]
                   + [(c + suffix[1] if c in names else c, k, c) for c in aux])
        return out

    @property
    def columns(self) -> list[str]:
        return [n for n, _, _ in self.sources()]

    def _counted(self, wanted: Sequence[tuple[int, str]]) -> tuple[DataFrame, list[Column], list[tuple[Column, Column]]]:
        """Subject rows with one row of counts of every other part, the number of merged rows that each part gives
        a subject row, and the (parseable, non-empty) counts of the ``wanted`` (part, column) within a part."""
        frames = [self.subject, self.person, *(e for _, e in self.entities)]
        base = self.subject.select(F.col("id").alias("_id"), F.col("dst_id").alias("_dst"), *[
            expr.alias(f"_0_{i}{kind}") for i, (k, c) in enumerate(wanted) if k == 0
            for kind, expr in (("n", df_num(self.subject, c).isNotNull().cast("long")), ("d", _non_empty(c).cast("long")))])
        for k, frame in enumerate(frames[1:], 1):
            key, own = ("id", "_dst") if k == 1 else ("dst_id", "_id")
            counts = frame.groupBy(F.col(key).alias(f"_k{k}")).agg(F.count(F.lit(1)).alias(f"_w{k}"), *[
                expr.alias(f"_{k}_{i}{kind}") for i, (part, c) in enumerate(wanted) if part == k
                for kind, expr in (("n", F.count(df_num(frame, c))), ("d", F.count_if(_non_empty(c))))])
            base = base.join(counts, F.col(own).eqNullSafe(F.col(f"_k{k}")), "left").drop(f"_k{k}")
        # a subject without rows in a part has one merged row of nulls there, which counts as non-empty
        rows = [F.lit(1).cast("long"), *[F.coalesce(f"_w{k}", F.lit(1)) for k in range(1, len(frames))]]
        values = [(F.coalesce(f"_{k}_{i}n", F.lit(0)), F.coalesce(f"_{k}_{i}d", F.lit(1))) for i, (k, _) in enumerate(wanted)]
        return base, rows, values

    def shape(self) -> DataFrame:
        """Row and column counts of the merged table."""
        base, rows, _ = self._counted([])
        n = F.coalesce(F.sum(reduce(lambda a, b: a * b, rows)), F.lit(0))
        return base.agg(n.alias("n_rows")).select("n_rows", F.lit(len(self.columns)).alias("n_columns"))

    def column_types(self, columns: Sequence[str] | None = None) -> DataFrame:
        """``column_types`` of the merged table, from the parts."""
        places = {n: (k, c) for n, k, c in self.sources()}
        cols = list(columns) if columns is not None else analysis_columns(self.columns)
        base, rows, values = self._counted([places[c] for c in cols])
        aggs = []
        for i, (c, (num, den)) in enumerate(zip(cols, values)):
            others = [r for k, r in enumerate(rows) if k != places[c][0]]
            for kind, own in (("n", num), ("d", den)):
                aggs.append(F.coalesce(F.sum(reduce(lambda a, b: a * b, others, own)), F.lit(0)).alias(f"{kind}{i}"))
        return _typed(base.agg(*aggs), cols) if cols else column_types(self.subject, [])


def subject_pairs(subjects: DataFrame, source: DataFrame, columns: str | Sequence[str], via: str = "id",
                  on: str = "dst_id", subject_key: str = "id") -> DataFrame:
    """Distinct ``(id, covariate, value)`` for every subject and each of ``columns``,
    read from the frame that holds them instead of from the merged table.

    ``via``/``on`` give the link: an entity pointing at subjects is ``via="id",
    on="dst_id"`` (the default); the person frame is ``via="dst_id", on="id"``; a
    subject column is ``source=subjects, via="id", on="id"``. Subjects without a
    linked row get a NULL value. The pairs equal the distinct (id, column) pairs of
    the merged table - its left joins only duplicate rows - but the per-subject
    product of several entities is never built, and the value side is de-duplicated
    (with map-side partial aggregation) before the one join per source, so a subject
    with very many records costs its distinct values only.
    """
    cols = [columns] if isinstance(columns, str) else list(columns)
    vals = (source.select(F.col(f"`{on}`").cast("string").alias("_k"),
                          *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
            .unpivot(["_k"], cols, "covariate", "value").distinct())
    subj = subjects.select(F.col(f"`{subject_key}`").cast("string").alias("id"),
                           F.col(f"`{via}`").cast("string").alias("_v")).distinct()
    j = subj.join(vals, subj["_v"].eqNullSafe(vals["_k"]), "left")
    matched = j.where(F.col("covariate").isNotNull()).select("id", "covariate", "value")
    unmatched = j.where(F.col("covariate").isNull()).select(
        "id", F.explode(F.array(*[F.lit(c) for c in cols])).alias("covariate"),
        F.lit(None).cast("string").alias("value"))
    return matched.unionByName(unmatched)


def union_pairs(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
