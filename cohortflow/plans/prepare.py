"""The preparation flow as one call: scan -> validate -> flatten -> merge -> column typing.

Everything returned is lazy except the small metadata jobs (entity catalogue, union
member detection per entity, and the column-typing aggregate when requested).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MissingEntity
from ..operators.flatten import flatten_entity, union_members
from ..operators.merge import DISTRIBUTION_PREFIXES, Merge, analysis_columns
from ..sources.envelope import (CORE_ENTITIES, IGNORED_ENTITIES, entity_names, read_entities,
                                require_entities)


@dataclass
class Prepared:
    entity_types: list[str]
    flattened: dict[str, DataFrame] = field(default_factory=dict)
    parts: Merge | None = None
    merged: DataFrame | None = None
    categorical: list[str] = field(default_factory=list)   # distribution candidates
    numeric: list[str] = field(default_factory=list)

    @property
    def optional_entities(self) -> list[str]:
        return sorted(n for n in self.entity_types if n not in CORE_ENTITIES + IGNORED_ENTITIES)


def prepare(spark: SparkSession, source: str | DataFrame, selected: Sequence[str] = (),
            classify: bool = True) -> Prepared:
    """Flatten subject, person, timing, survival_characteristic and the ``selected``
    optional entities; merge subject, person and the selected entities per subject."""
    env = read_entities(spark, source) if isinstance(source, str) else source
    names = entity_names(env)
    require_entities(names)
    unknown = [s for s in selected if s not in names]
    if unknown:
        raise MissingEntity(f"Selected entities not found: {unknown}")
    out = Prepared(entity_types=names)
    members = union_members(env)       # one job for all entities
    for n in ["subject", "person", "timing", "survival_characteristic", *selected]:
        if n in names and n not in out.flattened:
            out.flattened[n] = flatten_entity(env, n, members=members)
    out.parts = Merge(out.flattened["subject"], out.flattened["person"], [(n, out.flattened[n]) for n in selected])
    out.merged = out.parts.frame()
    if classify:
        cols = analysis_columns(out.merged.columns, DISTRIBUTION_PREFIXES)
        kinds = out.parts.column_types(cols).select("column", "is_numeric").collect()  # one row per column
        out.categorical = sorted(r["column"] for r in kinds if not r["is_numeric"])
        out.numeric = [r["column"] for r in kinds if r["is_numeric"]]
    return out


def status_text(prep: Prepared) -> str:
    """Size of the merged table in a sentence (one count job over the parts)."""
    shape = prep.parts.shape().first()
    return f"Merged dataset rows: {shape['n_rows']} | columns: {shape['n_columns']}"
