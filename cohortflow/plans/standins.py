"""Entity frames derived from the driver's star-schema tables.

The clinical inputs (subject, person, timing, survival_characteristic, optional
entities, uploaded subject-ID lists) have no public sample data, so the queries
run on tables Spark derives from the TPC-H-like tables. The mapping:

* person  <- customer (id = c_custkey)
* subject <- orders (id = o_orderkey, relation to person = o_custkey)
* entity ``lineitem`` <- lineitem (relation to subject = l_orderkey), fans out
* timing  <- orders; the diagnosis phase is status 'F', create date o_orderdate,
  age = days since 1990-01-01, ties broken by o_orderkey
* survival_characteristic <- orders with status 'P', dead = priority '1-URGENT'
* EFS subject <- orders with status 'O' keyed by customer, event = priority '2-HIGH'
* uploaded ID list <- the customers of region 0 (a semi-join through nation)

Every frame is a projection/filter of a full table, so its size grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flatten import fmt_double
from ..operators.merge import left_join_suffixed
from ..operators.survival import DIAGNOSIS_PHASE, EVENT_STATUS, valid_survival_rows

EPOCH = "1990-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _age_days(c: str):
    return F.datediff(F.col(c), F.to_date(F.lit(EPOCH)))


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("dst_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit(DIAGNOSIS_PHASE))
        .otherwise(F.col("o_orderstatus")).alias("disease_phase"),
        _age_days("o_orderdate").alias("age_at_disease_phase"),
        F.col("o_orderdate").alias("created_datetime"))


def survival_characteristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("dst_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Dead")).otherwise(F.lit("Alive")).alias("lkss"),
        _age_days("o_orderdate").alias("age_at_lkss"),
        F.col("o_orderdate").alias("created_datetime"))


def efs_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject records keyed by customer; the latest order carries the censor status."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderkey").alias("record_key"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.lit(EVENT_STATUS))
        .otherwise(F.lit("Subject has not had an event")).alias("censor_status"),
        _age_days("o_orderdate").alias("age_at_censor_status"),
        F.col("o_orderdate").alias("created_datetime"))


def ship_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line item: years from order to shipment, event = returned ('R')."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return valid_survival_rows(j.select(
        (F.datediff("l_shipdate", "o_orderdate") / F.lit(365.25)).alias("time_years"),
        (F.col("l_returnflag") == "R").cast("int").alias("event")))


def region_ids(spark: SparkSession, sf_dir: str, region: int = 0) -> DataFrame:
    """The 'uploaded' subject-ID list: customers of one region, as text ids."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").where(F.col("n_regionkey") == region).select("n_nationkey")
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left_semi")
            .select(F.col("c_custkey").cast("string").alias("id")))


# ---------------------------------------------------------------- entity envelope
def encode_tokens(c):
    """Inverse of the decoding for the characters present in the source values."""
    return F.replace(F.replace(c, F.lit("-"), F.lit("_2d_")), F.lit(" "), F.lit("_20_"))


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph envelope of person (customer), subject (orders) and lineitem records.

    ``object`` is a three-member union of typed records, as an Avro union of
    records reads in Spark; ``relations`` holds one edge per node.
    """
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    person_rec = F.struct(F.col("c_name").alias("name"), "c_nationkey", "c_acctbal", "c_mktsegment")
    subject_rec = F.struct("o_orderstatus", "o_totalprice", "o_orderdate",
                           encode_tokens(F.col("o_orderpriority")).alias("o_orderpriority"),
                           F.struct(F.col("o_orderstatus").alias("member0")).alias("state"))
    line_rec = F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
                        "l_shipdate", F.array("l_returnflag", "l_linestatus").alias("flags"))
    p = c.select(F.col("c_custkey").cast("string").alias("id"), F.lit("person").alias("name"),
                 person_rec.alias("r"),
                 F.array(F.struct(F.col("c_nationkey").cast("string").alias("dst_id"),
                                  F.lit("nation").alias("dst_name"))).alias("relations"))
    s = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("subject").alias("name"),
                 subject_rec.alias("r"),
                 F.array(F.struct(F.col("o_custkey").cast("string").alias("dst_id"),
                                  F.lit("person").alias("dst_name"))).alias("relations"))
    e = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("lineitem").alias("name"),
                  line_rec.alias("r"),
                  F.array(F.struct(F.col("l_orderkey").cast("string").alias("dst_id"),
                                   F.lit("subject").alias("dst_name"))).alias("relations"))
    types = [p.schema["r"].dataType, s.schema["r"].dataType, e.schema["r"].dataType]

    def wrap(df, k):
        members = [(F.col("r") if i == k else F.lit(None).cast(t)).alias(f"member{i}") for i, t in enumerate(types)]
        return df.select("id", "name", F.struct(*members).alias("object"), "relations")

    return wrap(p, 0).unionByName(wrap(s, 1)).unionByName(wrap(e, 2))


def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same envelope with the payload as JSON text, as JSON files and Avro text give it."""
    env = envelope(spark, sf_dir)
    options = {"timestampFormat": "yyyy-MM-dd HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    members = env.schema["object"].dataType.fieldNames()
    return env.withColumn("object", F.coalesce(*[F.to_json(F.col("object")[m], options) for m in members]))


# ---------------------------------------------------------------- Table 1 cohorts
def txt(c: str):
    """A numeric column as flattened text."""
    return fmt_double(F.col(c).cast("double"))


def customer_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects = customers (text columns, as after flattening), left-joined to their
    orders, so order-level covariates fan out per subject."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    subj = c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").cast("string").alias("id"), txt("c_acctbal").alias("c_acctbal"),
        "c_mktsegment", F.col("n_name").alias("nation"))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("dst_id"),
        "o_orderpriority", "o_orderstatus", txt("o_totalprice").alias("o_totalprice"))
    return left_join_suffixed(subj, o, "id", "dst_id", ("", "_orders"))


def labels_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects = labelled documents; text-valued quality and toxicity labels."""
    lb = table(spark, sf_dir, "labels")
    return lb.select(F.col("doc_id").cast("string").alias("id"),
                     F.when(F.col("quality") == 1, "high").otherwise("low").alias("quality_label"),
                     F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("toxicity"))


def language_ids(spark: SparkSession, sf_dir: str, lang: str = "es") -> DataFrame:
    """'Uploaded' document ids: all documents in one language."""
    d = table(spark, sf_dir, "documents").where(F.col("lang") == lang)
    return d.select(F.col("doc_id").cast("string").alias("id"))
