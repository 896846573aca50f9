"""cohortflow: cohort analytics over graph-shaped entity records, as Spark jobs.

Pipeline: envelope scan -> per-entity flatten -> per-subject merge ->
percentage distributions, overall / event-free Kaplan-Meier survival, and a
grouped summary table with group-comparison tests. Every step is a function
from DataFrame to DataFrame; the caller owns the SparkSession.
"""

from .errors import CohortError, InvalidEnvelope, MissingColumn, MissingEntity, NoMatchingIds, NoValidRows
from .operators.distribution import (covariate_kind, covariate_values, distribution_export,
                                     percentage_distribution)
from .operators.flatten import flatten_entity, flatten_status, flatten_summary
from .operators.groups import assign_groups, mark_groups
from .operators.merge import (Merge, analysis_columns, column_types, dataset_shape, left_join_suffixed, merge_entities,
                              subject_pairs, union_pairs)
from .operators.slices import first_per_key, latest_per_key, top1_per_key
from .operators.staged import StagedMerge, stage_merge
from .operators.survival import (diagnosis_age, event_free_survival, kaplan_meier, km_curve_points,
                                 km_median, km_risk_table, last_known_status, latest_subject,
                                 overall_survival, restrict_to_ids, valid_survival_rows)
from .operators.table1 import Covariate, table1
from .sources.envelope import (entity, entity_names, entity_types, optional_entities, read_entities,
                               read_staged, require_entities, stage_envelope, validate_envelope)
from .plans.prepare import Prepared, prepare, status_text
from .sources.sinks import write_distribution, write_report, write_table
from .sources.subject_ids import group_label, read_subject_ids, subject_id_upload

__all__ = [n for n in dir() if not n.startswith("_")]
