import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cohortflow.errors import InvalidEnvelope, MissingEntity
from cohortflow.operators.flatten import flatten_entity, flatten_summary, union_members
from cohortflow.operators.merge import Merge, analysis_columns, column_types, dataset_shape, left_join_suffixed, merge_entities
from cohortflow.sources.envelope import (entity_names, optional_entities, read_entities, require_entities,
                                         stage_envelope, read_staged, validate_envelope)

SCHEMA = ("id string, name string, "
          "object struct<member0: struct<name: string, age: double, flag: boolean, tags: array<string>, "
          "state: struct<member0: string, member1: int>, created_datetime: string>, "
          "member1: struct<diagnosis: string, score: bigint>>, "
          "relations array<struct<dst_id: string, dst_name: string>>")


def _envelope(spark):
    rows = [
        ("s1", "subject", ({"name": "Pat_20_One", "age": 23.0, "flag": True, "tags": ["a", None, "b"],
                           "state": {"member0": "ok", "member1": None}, "created_datetime": "2020-01-01 00:00:00"},
                           None), [{"dst_id": "p1", "dst_name": "person"}, {"dst_id": "p9", "dst_name": "x"}]),
        ("s2", "subject", ({"name": None, "age": 1e20, "flag": False, "tags": [],
                           "state": {"member0": None, "member1": 7}, "created_datetime": None}, None), []),
        ("e1", "lab", (None, {"diagnosis": "A_2d_1", "score": 5}), [{"dst_id": "s1", "dst_name": "subject"}]),
        ("e2", "lab", (None, {"diagnosis": None, "score": None}), None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_flatten_typed_union(spark):
    env = _envelope(spark)
    sub = flatten_entity(env, "subject")
    assert sub.columns == ["id", "name", "age", "flag", "tags", "state", "created_datetime", "subject_name",
                           "dst_id", "dst_name"]
    rows = {r.id: r for r in sub.collect()}
    assert rows["s1"].subject_name == "Pat One" and rows["s1"].age == "23" and rows["s1"].flag == "TRUE"
    assert rows["s1"].tags == "a;b" and rows["s1"].state == "ok" and rows["s1"].dst_id == "p1"
    assert rows["s2"].tags is None and rows["s2"].state == "7" and rows["s2"].dst_id is None
    assert rows["s2"].age == "1e+20" and rows["s2"].flag == "FALSE"
    lab = {r.id: r for r in flatten_entity(env, "lab").collect()}
    assert lab["e1"].diagnosis == "A-1" and lab["e1"].score == "5" and lab["e2"].dst_id is None
    assert {r.name: r.n_records for r in flatten_summary(env).collect()} == {"subject": 2, "lab": 2}


def test_flatten_json_text_payload(spark):
    df = spark.createDataFrame([("1", "person", json.dumps({"sex": "F", "name": "Ann"}), None),
                                ("2", "person", json.dumps({"race": "x"}), None)],
                               "id string, name string, object string, relations array<struct<dst_id:string>>")
    out = flatten_entity(df, "person")
    assert out.columns == ["id", "name", "race", "sex", "person_name", "dst_id", "dst_name"]
    assert {r.id: (r.sex, r.person_name) for r in out.collect()} == {"1": ("F", "Ann"), "2": (None, None)}


def test_envelope_validation_catalogue_and_staging(spark, tmpdir_path):
    env = _envelope(spark)
    with pytest.raises(InvalidEnvelope):
        validate_envelope(env.drop("relations"))
    assert entity_names(env) == ["lab", "subject"]
    with pytest.raises(MissingEntity):
        require_entities(entity_names(env))
    assert [r.name for r in optional_entities(env).collect()] == ["lab"]
    path = os.path.join(tmpdir_path, "staged")
    stage_envelope(env, path)
    staged = read_staged(spark, path)
    assert flatten_entity(staged, "lab").count() == 2
    js = os.path.join(tmpdir_path, "env.json")
    env.write.json(js)
    assert read_entities(spark, js, "json").where(F.col("name") == "subject").count() == 2


def test_merge_suffixes_null_keys_and_fanout(spark):
    subject = spark.createDataFrame([("s1", "subject", "p1", "person"), ("s2", "subject", None, "person")],
                                    "id string, name string, dst_id string, dst_name string")
    person = spark.createDataFrame([("p1", "person", "F", "x", "y"), (None, "person", "M", None, None)],
                                   "id string, name string, sex string, dst_id string, dst_name string")
    ent = spark.createDataFrame([("e1", "lab", "1", "s1", "subject"), ("e2", "lab", "2", "s1", "subject")],
                                "id string, name string, v string, dst_id string, dst_name string")
    m = merge_entities(subject, person, [("lab", ent)])
    assert m.columns == ["id", "name_subject", "dst_id", "dst_name_subject", "name_person", "sex",
                         "dst_id_person", "dst_name_person", "id_lab", "name", "v", "dst_name"]
    rows = m.orderBy("id", "v").collect()
    assert [(r.id, r.sex, r.v) for r in rows] == [("s1", "F", "1"), ("s1", "F", "2"), ("s2", "M", None)]
    assert analysis_columns(m.columns) == ["name_subject", "name_person", "sex", "name", "v"]
    assert analysis_columns(["id", "dst_id", "identity", "x"], ["id", "dst_id"], mode="exact") == ["identity", "x"]


def test_column_types_keeps_nulls_in_denominator(spark):
    rows = [(str(i), str(i) if i < 8 else None, str(i) if i < 9 else "") for i in range(10)]
    df = spark.createDataFrame(rows, "id string, a string, b string")
    got = {r.column: (r.n_numeric, r.n_nonempty, r.is_numeric) for r in column_types(df, ["a", "b"]).collect()}
    assert got == {"a": (8, 10, False), "b": (9, 9, True)}


def test_left_join_suffixed_right_key_dropped(spark):
    x = spark.createDataFrame([("1", "a")], "id string, v string")
    y = spark.createDataFrame([("1", "b", "z")], "k string, v string, id string")
    out = left_join_suffixed(x, y, "id", "k", (".x", ".y"))
    assert out.columns == ["id", "v.x", "v.y", "id.y"]


def test_subject_pairs_equal_merged_distinct_pairs(spark):
    from cohortflow.operators.merge import subject_pairs
    from cohortflow.operators.stats import covariate_pairs
    subject = spark.createDataFrame([("s1", "p1"), ("s2", "p2"), ("s3", None)], "id string, dst_id string")
    person = spark.createDataFrame([("p1", "F"), ("p2", None)], "id string, sex string")
    lab = spark.createDataFrame([("l1", "s1", "a"), ("l2", "s1", "b"), ("l3", "s1", "a"), ("l4", "s2", None)],
                                "id string, dst_id string, v string")
    vis = spark.createDataFrame([("v1", "s1", "x"), ("v2", "s1", "y"), ("v3", "s3", "z")],
                                "id string, dst_id string, w string")
    merged = merge_entities(subject, person, [("lab", lab), ("vis", vis)])
    want = {tuple(r) for r in covariate_pairs(merged, ["sex", "v", "w"]).collect()}
    got = set()
    for col, src, via, on in [("sex", person, "dst_id", "id"), ("v", lab, "id", "dst_id"), ("w", vis, "id", "dst_id")]:
        got |= {tuple(r) for r in subject_pairs(subject, src, col, via=via, on=on).collect()}
    assert got == want
    both = merge_entities(subject, person, [("lab", lab.withColumn("u", lab.v))])
    want2 = {tuple(r) for r in covariate_pairs(both, ["v", "u"]).collect()}
    got2 = {tuple(r) for r in subject_pairs(subject, lab.withColumn("u", lab.v), ["v", "u"]).collect()}
    assert got2 == want2


def test_json_and_typed_payloads_flatten_alike(spark):
    record = {"d": 23.0, "b": True, "n": [{"a": 1}, {"b": [2, 3.5, None]}], "s": 'q"u\\o, [x] {y}: true', "t": "true", "e": "",
              "z": None, "l": [], "i": 7, "x": 1e-9, "state": {"member0": "a", "member1": "b"}}
    typed = spark.createDataFrame([Row(id="1", name="lab", relations=None)], "id string, name string, relations string").selectExpr(
        "id", "name", "named_struct('d', 23.0D, 'b', true, 'n', array(named_struct('a', 1, 'b', cast(null as array<double>)),"
        " named_struct('a', cast(null as int), 'b', array(2D, 3.5D, null))), 's', 'q\"u\\\\o, [x] {y}: true', 't', 'true', 'e', '',"
        " 'z', cast(null as string), 'l', cast(array() as array<int>), 'i', 7, 'x', 1e-9D, 'state',"
        " named_struct('member0', 'a', 'member1', 'b')) AS object", "relations")
    text = spark.createDataFrame([("1", "lab", json.dumps(record), None)], "id string, name string, object string, relations string")
    a, b = (flatten_entity(x, "lab").first().asDict() for x in (typed, text))
    assert a == b
    assert (b["d"], b["b"], b["n"], b["t"], b["z"], b["l"], b["state"]) == ("23", "TRUE", "1;2;3.5", "true", None, None, "a")


def test_json_columns_may_first_appear_in_late_records(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "late.json")
    rows = [{"name": "x", "object": {"a": 1}} for _ in range(1500)] + [{"id": "1", "name": "x", "relations": []}]
    with open(path, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    assert read_entities(spark, path).where("id = '1'").count() == 1


def test_json_files_keep_each_entitys_own_columns(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "own.json")
    with open(path, "w") as f:
        for n, o in (("subject", {"a": 1}), ("person", {"p": "x", "q": [1, 2]}), ("lab", {"v": 2.0})):
            f.write(json.dumps({"id": n, "name": n, "object": o, "relations": [{"dst_id": "1", "dst_name": "m"}]}) + "\n")
    env = read_entities(spark, path)
    assert flatten_entity(env, "subject").columns == ["id", "name", "a", "dst_id", "dst_name"]
    assert flatten_entity(env, "person").first().q == "1;2" and flatten_entity(env, "lab").first().v == "2"
    with open(path, "w") as f:
        f.write('{"id": "1", "name": "x"}\n')
    with pytest.raises(InvalidEnvelope):
        read_entities(spark, path)


def test_union_members_is_one_job_for_all_entities(spark):
    env = spark.range(2).selectExpr(
        "cast(id as string) id", "if(id = 0, 'person', 'lab') name", "array(named_struct('dst_id', '1', 'dst_name', 'm')) relations",
        "named_struct('member0', if(id = 0, named_struct('p', 1), null), 'member1', if(id = 1, named_struct('v', 2), null)) object")
    members = union_members(env)
    assert members == {"person": ["member0"], "lab": ["member1"]}
    for n in members:
        assert flatten_entity(env, n, members=members).collect() == flatten_entity(env, n).collect()


def test_card_and_covariate_candidates():
    from cohortflow.operators.merge import card_candidates, covariate_candidates
    names = ["id", "identity", "dst_id_lab", "created_datetime", "created_datetime_x", "sex"]
    assert card_candidates(names) == ["created_datetime", "created_datetime_x", "sex"]
    assert covariate_candidates(names) == ["identity", "dst_id_lab", "created_datetime_x", "sex"]


def test_json_values_of_several_types_and_odd_keys(spark):
    rows = [{"m": 1, "k.x": "a", "Sex": 1, "big": 12345678901234567890123, "f": 0.1, "o": {"p": 1}, "st": "x"},
            {"m": "one_20_two", "k.x": None, "big": 3, "f": 2, "o": {"p": "y", "q": [True]}, "st": ""},
            {"m": [1, {"z": 2.50}], "f": 1e300, "o": {}, "dup": {"A": 1, "a": 2}, "wide": {f"k{i:03d}": i for i in range(250)}}]
    df = spark.createDataFrame([(str(i), "lab", json.dumps(r), None) for i, r in enumerate(rows)]
                               + [("3", "lab", "no json {", None), ("4", "lab", None, None), ("5", "other", '{"v": [[1, 2], [3]]}', None),
                                  ("6", "void", "[1]", None)],
                               "id string, name string, object string, relations string")
    members = union_members(df)
    lab = flatten_entity(df, "lab", members=members)
    assert lab.columns == ["id", "name", "m", "f", "k.x", "Sex", "big", "o", "dup", "wide", "st", "dst_id", "dst_name"]
    assert lab.collect() == flatten_entity(df, "lab").collect()
    r = {x["id"]: x.asDict() for x in lab.collect()}
    assert [r[i]["m"] for i in "01234"] == ["1", "one two", "1;2.5", None, None]
    assert [r[i]["big"] for i in "012"] == ["12345678901234567890123", "3", None]
    assert [r[i]["f"] for i in "012"] == ["0.1", "2", "1e+300"] and r["0"]["k.x"] == "a" and r["1"]["st"] == ""
    assert [r[i]["o"] for i in "012"] == ["1", "y;TRUE", None] and r["2"]["dup"] == "1;2"
    assert r["2"]["wide"] == ";".join(str(i) for i in range(250)) and r["0"]["Sex"] == "1"
    assert flatten_entity(df, "other", members=members).first()["v"] == "1;2;3"
    assert flatten_entity(df, "void", members=members).columns == ["id", "name", "dst_id", "dst_name"]
    twins = df.where("id = '0'").withColumn("object", F.lit('{"Sex": 1, "sex": 2}'))
    assert tuple(flatten_entity(twins, "lab").first())[2:4] == ("1", "2")


def test_json_payload_is_parsed_once(spark):
    df = spark.createDataFrame([(str(i), "lab", json.dumps({"a": i, "b": [i], "c": "x"}), None) for i in range(3)],
                               "id string, name string, object string, relations string")
    plan = flatten_entity(df, "lab")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "parse_json" not in plan


def test_counts_from_parts_equal_those_over_the_merged_table(spark):
    # repeated subjects, persons and null keys; subjects without rows in a part; names that clash three times
    subject = spark.createDataFrame([("s1", "p1", "1", "x"), ("s1", "p2", "", None), ("s2", None, "2", "3"), ("s3", "p9", None, "4"),
                                     (None, "p1", "5", "")], "id string, dst_id string, v string, name string")
    person = spark.createDataFrame([("p1", "7", "n"), ("p1", "8", ""), ("p2", None, "5"), (None, "9", "6")], "id string, v string, name string")
    lab = spark.createDataFrame([("l1", "s1", "1", None), ("l2", "s1", "a", ""), ("l3", "s2", "", "2"), ("l4", None, "3", "3"),
                                 ("l5", "s1", "4", "4")], "id string, dst_id string, v string, u string")
    scan = spark.createDataFrame([("s1", 1.5), ("s1", None), ("s2", 2.0)], "dst_id string, u double")
    for entities in ([], [("lab", lab)], [("lab", lab), ("scan", scan)], [("a", lab), ("b", lab), ("c", lab)]):
        parts, frame = Merge(subject, person, entities), merge_entities(subject, person, entities)
        assert parts.columns == frame.columns
        assert parts.shape().collect() == dataset_shape(frame).collect()
        for cols in (None, [c for c in frame.columns if frame.columns.count(c) == 1]):
            assert sorted(parts.column_types(cols).collect()) == sorted(column_types(frame, cols).collect())
    assert Merge(subject.where("false"), person).shape().first()["n_rows"] == 0
    plan = Merge(subject, person, [("lab", lab)]).column_types()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.count("Aggregate") == 3
