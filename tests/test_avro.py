"""Avro container round trip: written with the Avro classes Spark ships, read by read_entities."""

import os

import pytest

from cohortflow.errors import InvalidEnvelope
from cohortflow.operators.flatten import flatten_entity
from cohortflow.sources.envelope import entity_names, read_entities

SCHEMA = """{"type":"record","name":"Entity","fields":[
 {"name":"id","type":"string"},{"name":"name","type":"string"},
 {"name":"object","type":[
   {"type":"record","name":"subject","fields":[{"name":"age","type":["null","double"]},
     {"name":"state","type":["null","string"]},{"name":"tags","type":{"type":"array","items":"string"}},
     {"name":"created_datetime","type":["null","string"]}]},
   {"type":"record","name":"person","fields":[{"name":"sex","type":["null","string"]},
     {"name":"name","type":["null","string"]}]}]},
 {"name":"relations","type":{"type":"array","items":{"type":"record","name":"Relation","fields":[
   {"name":"dst_id","type":"string"},{"name":"dst_name","type":"string"}]}}}]}"""


def _write(spark, path, schema_json, records):
    jvm = spark.sparkContext._jvm
    schema = jvm.org.apache.avro.Schema.Parser().parse(schema_json)
    writer = jvm.org.apache.avro.file.DataFileWriter(jvm.org.apache.avro.generic.GenericDatumWriter(schema))
    writer.create(schema, jvm.java.io.File(path))
    for r in records(jvm, schema):
        writer.append(r)
    writer.close()


def _records(jvm, schema):
    GR = jvm.org.apache.avro.generic.GenericData.Record
    types = schema.getField("object").schema().getTypes()
    rel_s = schema.getField("relations").schema().getElementType()

    def env(id_, name, obj, rels):
        r = GR(schema)
        r.put("id", id_)
        r.put("name", name)
        r.put("object", obj)
        lst = jvm.java.util.ArrayList()
        for d, n in rels:
            rr = GR(rel_s)
            rr.put("dst_id", d)
            rr.put("dst_name", n)
            lst.add(rr)
        r.put("relations", lst)
        return r

    out = []
    for i in range(12):
        s = GR(types.get(0))
        s.put("age", jvm.java.lang.Double(20.5 + i))
        s.put("state", "Initial_20_Diagnosis")
        tags = jvm.java.util.ArrayList()
        for t in (["a", "b"] if i % 2 else []):
            tags.add(t)
        s.put("tags", tags)
        out.append(env(f"s{i}", "subject", s, [(f"p{i}", "person")]))
    p = GR(types.get(1))
    p.put("sex", "F")
    p.put("name", "Ann")
    out.append(env("p0", "person", p, []))
    return out


def test_avro_round_trip(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "cohort.avro")
    _write(spark, path, SCHEMA, _records)
    env = read_entities(spark, path)
    assert entity_names(env) == ["person", "subject"]
    plan = env._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan
    sub = flatten_entity(env, "subject")
    assert sub.columns == ["id", "name", "age", "state", "tags", "created_datetime", "dst_id", "dst_name"]
    rows = {r.id: r for r in sub.collect()}
    assert len(rows) == 12
    assert rows["s1"].state == "Initial Diagnosis" and rows["s1"].tags == "a;b" and rows["s0"].tags is None
    assert rows["s1"].age == "21.5" and rows["s1"].dst_id == "p1" and rows["s1"].created_datetime is None
    per = flatten_entity(env, "person").collect()
    assert [(r.sex, r.person_name, r.dst_id) for r in per] == [("F", "Ann", None)]


def test_avro_missing_envelope_column(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "bad.avro")
    bad = """{"type":"record","name":"E","fields":[{"name":"id","type":"string"},{"name":"name","type":"string"}]}"""

    def recs(jvm, schema):
        r = jvm.org.apache.avro.generic.GenericData.Record(schema)
        r.put("id", "1")
        r.put("name", "x")
        return [r]

    _write(spark, path, bad, recs)
    with pytest.raises(InvalidEnvelope):
        read_entities(spark, path)
