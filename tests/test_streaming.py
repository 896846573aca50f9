import os

from pyspark.sql import functions as F

from cohortflow.operators.flatten import flatten_entity
from cohortflow.sources.envelope import read_staged
from cohortflow.streaming.staging import envelope_stream, stage_stream

SCHEMA = ("id string, name string, object struct<member0: struct<sex: string>, member1: struct<v: double>>, "
          "relations array<struct<dst_id: string, dst_name: string>>")


def test_stream_staging_is_incremental_and_exactly_once(spark, tmpdir_path):
    landing, target, ckpt = (os.path.join(tmpdir_path, x) for x in ("landing", "staged", "ckpt"))
    first = spark.createDataFrame([("p1", "person", ({"sex": "F"}, None), []),
                                   ("l1", "lab", (None, {"v": 1.5}), [{"dst_id": "s1", "dst_name": "subject"}])],
                                  SCHEMA)
    first.write.parquet(os.path.join(landing, "batch1"))
    schema = first.schema
    stage_stream(envelope_stream(spark, os.path.join(landing, "*"), schema), target, ckpt).awaitTermination()
    assert sorted(os.listdir(target))[:2] == ["_spark_metadata", "name=lab"]
    second = spark.createDataFrame([("l2", "lab", (None, {"v": 2.0}), [])], SCHEMA)
    second.write.parquet(os.path.join(landing, "batch2"))
    stage_stream(envelope_stream(spark, os.path.join(landing, "*"), schema), target, ckpt).awaitTermination()
    staged = read_staged(spark, target)
    assert staged.where(F.col("name") == "lab").count() == 2          # batch1 not staged twice
    lab = {r.id: r.v for r in flatten_entity(staged, "lab").collect()}
    assert lab == {"l1": "1.5", "l2": "2"}
