"""Entity envelopes: one row per graph node ``id, name, object, relations``.

Sources: Avro containers (the spark-avro reader when it is on the classpath, else
the Avro JSON text reader that ships with Spark's bundled avro-mapred jar),
Parquet, or JSON lines with the same four columns. For repeated analysis, stage
once to Parquet partitioned by entity name so every later entity read prunes
to its own directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidEnvelope, MissingEntity
from ..session import shared_path

# Envelope columns, entity types handled by the fixed analyses,
# and entity types never offered as optional joins.
ENVELOPE_COLUMNS = ["id", "name", "object", "relations"]
CORE_ENTITIES = ["subject", "person", "timing", "survival_characteristic"]
IGNORED_ENTITIES = ["Metadata", "program", "project"]
REQUIRED_ENTITIES = ["subject", "person"]


# Envelope schema of JSON text (files, or the Avro fallback): the record payload stays raw JSON
# text, so each record carries exactly its own fields, and is parsed per entity by the flatten.
TEXT_SCHEMA = ("id string, name string, object string, "
                    "relations array<struct<dst_id: string, dst_name: string>>")


def _avro_field_names(spark: SparkSession, path: str) -> list[str]:
    """Top-level field names from the container header (reads only the header)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(hpath).isDirectory():
        files = [st.getPath() for st in fs.listStatus(hpath) if st.getPath().getName().endswith(".avro")]
        if not files:
            return []
        hpath = files[0]
    stream = jvm.org.apache.avro.mapred.FsInput(hpath, spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.org.apache.avro.file.DataFileReader(stream, jvm.org.apache.avro.generic.GenericDatumReader())
    try:
        return [f.name() for f in reader.getSchema().getFields()]
    finally:
        reader.close()


def _read_avro(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.format("avro").load(path)
    except Exception as e:  # noqa: BLE001 - the data source is optional
        if "avro" not in str(e).lower():
            raise
    # Fallback: Avro records rendered as JSON text by the avro-mapred input format bundled with Spark (splittable,
    # one JSON document per record). The text is staged on shared storage by the JVM and read by Spark's JSON reader.
    missing = [c for c in ENVELOPE_COLUMNS if c not in _avro_field_names(spark, path)]
    if missing:
        raise InvalidEnvelope(missing)
    staged = shared_path(spark, "avro-text")
    _stage_avro_text(spark, path, staged)
    return spark.read.schema(TEXT_SCHEMA).json(staged)


def _stage_avro_text(spark: SparkSession, path: str, out: str) -> None:
    """Write the records of an Avro file as JSON lines, without a Python worker."""
    jvm = spark.sparkContext._jvm
    of = lambda name: jvm.java.lang.Class.forName(name, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    text = of("org.apache.hadoop.io.Text")
    records = spark.sparkContext._jsc.hadoopFile(path, of("org.apache.avro.mapred.AvroAsTextInputFormat"), text, text)
    records.keys().saveAsTextFile(out)


# records that are tried first: if they hold every column, the rest need not be read for the check
HEADER_RECORDS = 1000


def _missing_keys(lines: DataFrame) -> list[str]:
    """Envelope columns that no JSON line holds (writers leave null fields out of single records)."""
    keys = lines.select(F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("k"))
    found = {r["k"] for r in keys.where(F.col("k").isin(ENVELOPE_COLUMNS)).distinct().collect()}
    return [c for c in ENVELOPE_COLUMNS if c not in found]


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the payload as text; a column is missing if no record of the file holds it."""
    lines = spark.read.text(path)
    missing = _missing_keys(lines.limit(HEADER_RECORDS)) and _missing_keys(lines)
    if missing:
        raise InvalidEnvelope(missing)
    return spark.read.schema(TEXT_SCHEMA).json(path)


def read_entities(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Load an envelope table; ``fmt`` defaults from the path's extension."""
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt == "avro":
        df = _read_avro(spark, path)
    elif fmt in ("json", "jsonl", "ndjson"):
        df = _read_json(spark, path)
    else:
        df = spark.read.parquet(path)
    return validate_envelope(df)


def validate_envelope(df: DataFrame) -> DataFrame:
    """Raise unless all four envelope columns exist (schema only, no job)."""
    missing = [c for c in ENVELOPE_COLUMNS if c not in df.columns]
    if missing:
        raise InvalidEnvelope(missing)
    return df


def entity_types(df: DataFrame) -> DataFrame:
    """Distinct entity names (the catalogue)."""
    return df.select("name").distinct()


def entity_names(df: DataFrame) -> list[str]:
    """Catalogue as a Python list (a one-column distinct: bounded by #entity types)."""
    return sorted(r["name"] for r in entity_types(df).collect() if r["name"] is not None)


def entity(df: DataFrame, name: str) -> DataFrame:
    """Rows of one entity type; a partition filter when the source is staged by name."""
    return df.where(F.col("name") == name)


def require_entities(names: list[str], needed: list[str] = REQUIRED_ENTITIES) -> None:
    missing = [n for n in needed if n not in names]
    if missing:
        raise MissingEntity("the envelope holds no subject or no person records"
                            if set(missing) & set(REQUIRED_ENTITIES) else f"Missing entities: {missing}")


def optional_entities(df: DataFrame) -> DataFrame:
    """Entity types a user may add to the merge: all but the core and ignored ones, sorted."""
    return (entity_types(df).where(~F.col("name").isin(*CORE_ENTITIES, *IGNORED_ENTITIES)
                                   & F.col("name").isNotNull())
            .orderBy("name"))


def stage_envelope(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the envelope as Parquet partitioned by entity name (one scan, later pruned reads)."""
    df.write.mode(mode).partitionBy("name").parquet(path)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    return validate_envelope(spark.read.parquet(path))
