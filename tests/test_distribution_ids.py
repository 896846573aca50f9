import os

from cohortflow.operators.distribution import (covariate_kind, covariate_values, distribution_export,
                                               percentage_distribution)
from cohortflow.sources.sinks import write_distribution
from cohortflow.sources.subject_ids import group_label, read_subject_ids, subject_id_upload


def test_percentage_distribution_counts_pairs_and_null(spark, tmpdir_path):
    rows = [("1", "a"), ("1", "a"), ("1", "b"), ("2", "a"), ("3", None), ("4", "None"), ("5", "")]
    df = spark.createDataFrame(rows, "id string, v string")
    d = percentage_distribution(df, "v")
    got = {r.v: (r.n, r.Percentage, r.Label) for r in d.collect()}
    assert got == {"a": (2, 33.33, "33.33%"), "b": (1, 16.67, "16.67%"), None: (1, 16.67, "16.67%"),
                   "None": (1, 16.67, "16.67%"), "": (1, 16.67, "16.67%")}
    assert d.first().v == "a"
    exp = {r.v: r.Percentage for r in distribution_export(d).collect()}
    assert exp["N/A"] == 16.67
    write_distribution(d, os.path.join(tmpdir_path, "dist"))
    assert [r.v for r in covariate_values(df, "v").collect()] == ["", "None", "a", "b"]
    assert covariate_kind(df, "v").first().numeric is False


def test_read_subject_ids(spark, tmpdir_path):
    txt = os.path.join(tmpdir_path, "my_ids.txt")
    with open(txt, "w") as f:
        f.write(" a1 \n\n a2\na1\n   \n")
    assert sorted(r.id for r in read_subject_ids(spark, txt).collect()) == ["a1", "a2"]
    csv = os.path.join(tmpdir_path, "grp.csv")
    with open(csv, "w") as f:
        f.write("x,SubjectID\n 7 ,s1\n8,s2\n,s3\n")
    assert sorted(r.id for r in read_subject_ids(spark, csv).collect()) == ["7", "8"]
    assert sorted(r.id for r in read_subject_ids(spark, csv, first_column=False).collect()) == ["s1", "s2", "s3"]
    tsv = os.path.join(tmpdir_path, "t.tsv")
    with open(tsv, "w") as f:
        f.write("id\tother\nq\t1\n")
    assert [r.id for r in read_subject_ids(spark, tsv).collect()] == ["q"]
    empty = os.path.join(tmpdir_path, "none.txt")
    with open(empty, "w") as f:
        f.write("\n  \n")
    assert subject_id_upload(spark, empty) == (None, None)
    assert group_label("/x/y/my_ids.txt") == "my_ids"


def test_distribution_input_checks_and_flatten_status(spark):
    import pytest
    from cohortflow.errors import CohortError, MissingColumn
    from cohortflow.operators.flatten import flatten_status
    df = spark.createDataFrame([("1", 2.0)], "id string, x double")
    with pytest.raises(MissingColumn):
        percentage_distribution(df, "nope")
    with pytest.raises(CohortError):
        percentage_distribution(df, "x")
    assert flatten_status(df, ["person"]) == "Flattened 1 records for person"
