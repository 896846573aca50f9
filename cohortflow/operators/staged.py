"""Merges of entities staged in buckets of their link key.

A merge that is read again and again pays for its shuffles once: ``stage_merge`` writes the subjects (with their
person columns) bucketed by subject id, and every entity bucketed by the subject it points to, with one number of buckets.
``StagedMerge.frame`` then joins bucket by bucket, without an exchange.

A bucket is read by one task, so a subject with very many records must not lie in one. Keys that hold more rows of a
part than a mean bucket of it (at most ``buckets`` keys a part, so their list is small) are staged apart, without buckets, and
joined by an ordinary shuffle whose hot partitions the adaptive join splits. Nothing depends on which keys these are.

Null keys match null keys, as in ``merge_entities``: the buckets are cut by a text of the key that is never null.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .merge import left_join_suffixed

# rows of a key from which it may be staged apart; smaller ones fit any task
HEAVY_ROWS = 100_000


def _link_name(frames: Sequence[DataFrame]) -> str:
    taken = {c.lower() for f in frames for c in f.columns}
    name = "_link"
    while name in taken:
        name += "_"
    return name


def _link(key: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{key}`").cast("string")), F.lit(""))


def heavy_keys(df: DataFrame, link: str, buckets: int, least: int = HEAVY_ROWS) -> list[str]:
    """Keys with at least ``least`` rows and more than a mean bucket's; there are fewer than ``buckets`` of them."""
    total = Observation()
    counts = df.groupBy(link).agg(F.count(F.lit(1)).alias("n")).observe(total, F.sum("n").alias("rows"))
    # the largest ``buckets`` counts hold every key above the mean
    top = counts.orderBy(F.desc("n"), link).limit(buckets).collect()
    mean = (total.get["rows"] or 0) / buckets
    return [r[link] for r in top if r["n"] >= least and r["n"] > mean]


@dataclass(frozen=True)
class StagedMerge:
    """Staged parts of a merge: tables of the light keys, paths of the heavy ones (None without heavy keys)."""

    spark: SparkSession
    link: str
    names: Sequence[str]
    tables: Sequence[str]
    heavy: Sequence[str] | None

    def _light(self) -> DataFrame:
        base, *entities = (self.spark.table(t) for t in self.tables)
        return reduce(lambda acc, ne: left_join_suffixed(acc, ne[1], "id", "dst_id", ("", f"_{ne[0]}"), link=self.link),
                      zip(self.names, entities), base)

    def _heavy(self) -> DataFrame:
        def joined(x: DataFrame, name: str, y: DataFrame) -> DataFrame:
            # an inner join may be split on both sides where a key is hot, an outer one only on the left
            to = lambda a, b, how: left_join_suffixed(a, b, "id", "dst_id", ("", f"_{name}"), link=self.link, how=how)
            lone = x.join(y.select(self.link).distinct(), self.link, "left_anti").select(*[F.col(f"`{c}`") for c in x.columns])
            return to(x, y, "inner").unionByName(to(lone, y.where(F.lit(False)), "left"))

        base, *entities = (self.spark.read.parquet(p) for p in self.heavy)
        return reduce(lambda acc, ne: joined(acc, *ne), zip(self.names, entities), base)

    def frame(self) -> DataFrame:
        """The rows of ``merge_entities`` over what was staged."""
        out = self._light()
        if self.heavy is not None:
            out = out.unionByName(self._heavy())
        return out.drop(self.link)

    def drop(self) -> None:
        """Forget the tables; the files stay in the shared folder."""
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")


def stage_merge(subject: DataFrame, person: DataFrame, entities: Sequence[tuple[str, DataFrame]] = (),
                buckets: int | None = None, path: str | None = None, heavy_rows: int = HEAVY_ROWS) -> StagedMerge:
    """Write the parts of ``merge_entities(subject, person, entities)`` in buckets of the subject.

    ``buckets`` is the session's number of shuffle partitions if not given; ``path`` is a new folder on storage that the driver
    and all executors share (by default below the checkpoint folder). The tables belong to this session's catalogue.
    """
    spark = subject.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or shared_path(spark, "merge")
    base = left_join_suffixed(subject, person, "dst_id", "id", ("_subject", "_person"))
    link = _link_name([base, *(e for _, e in entities)])
    parts = [base.withColumn(link, _link("id")), *(e.withColumn(link, _link("dst_id")) for _, e in entities)]
    hot = sorted({k for p in parts for k in heavy_keys(p, link, buckets, heavy_rows)})
    tables, apart = [], []
    for i, part in enumerate(parts):
        is_hot = F.col(link).isin(hot) if hot else F.lit(False)
        table = f"staged_{uuid.uuid4().hex}"
        # one file a bucket: the exchange cuts by the same hash as the buckets
        (part.where(~is_hot).repartition(buckets, link).write.bucketBy(buckets, link).sortBy(link).format("parquet")
         .option("path", f"{path}/{i}/light").saveAsTable(table))
        tables.append(table)
        if hot:
            part.where(is_hot).write.parquet(f"{path}/{i}/heavy")
            apart.append(f"{path}/{i}/heavy")
    return StagedMerge(spark, link, [n for n, _ in entities], tables, apart if hot else None)
