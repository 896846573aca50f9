"""Helpers shared by the text operators: whole-table readers and settled intermediates."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH_CONF, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
# white space of the word rules, for Java and Python regular expressions alike
NON_SPACE = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizer files are, for callers that name no path of their own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share. A session on one machine that has none gets a fresh one; a cluster must name it."""
    known = ensure_checkpoint_dir(spark)
    if not known and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return known or ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="cohortflow-", dir="/tmp"))


def settled_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_settled(spark: SparkSession, path: str) -> None:
    """Delete files of ``settled_path`` that no later job reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later jobs read the files, so a lost executor costs the tasks it ran and not the plan
    above, and rows numbered or hashed once keep their numbers on every later read.
    """
    return settle_at(df, settled_path(df.sparkSession, name))


def settle_at(df: DataFrame, path: str) -> DataFrame:
    spark, schema = df.sparkSession, df.schema
    df.write.parquet(path)
    del df
    gc.collect()        # executors drop a plan's shuffle files once the driver has collected it
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes, not only the rows, that go to a Python worker at once, unless the session does so already.

    Ten thousand long texts in one Arrow batch are held by the task, by the worker and by the buffers between them.
    """
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(ARROW_BYTES))


def release_memory() -> None:
    """Give memory that a worker has freed back to the machine: idle workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):       # another C library
        pass


def trimmed(work):
    """``work`` over a task's batches, after which the worker's freed memory is released."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            release_memory()

    return run


def text_slices(column, most: int):
    """Consecutive slices of an Arrow column of text or bytes: (first row, list of bytes), each of about ``most`` bytes.

    Only one slice at a time becomes Python objects; nulls are empty.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("int64")
    group = sizes.cumsum() // most
    first = 0
    while first < len(sizes):
        stop = int(group.searchsorted(group[first], side="right"))
        yield first, [t.encode() if isinstance(t, str) else t or b"" for t in column.slice(first, stop - first).to_pylist()]
        first = stop


def scan_array(items: Column, zero: Column, move, out, kind: str) -> Column:
    """Array of ``out(state, item)`` (type ``kind``) along ``items``, with ``move(state, item)`` as the next state; null if empty.

    Results are gathered 256 at a time, so that a text with very many items is not copied once per item.
    """
    nothing = lambda deep: F.array().cast(f"array<{deep}>")
    step = lambda a, x: F.struct(move(a["at"], x).alias("at"), F.concat(a["out"], F.array(out(a["at"], x))).alias("out"))
    begin = lambda at: F.struct(at.alias("at"), nothing(kind).alias("out"))

    def whole(own):
        def chunk(a, c):
            done = F.aggregate(F.slice(own, c * 256 + 1, 256), begin(a["at"]), step)
            return F.aggregate(F.array(done), a, lambda b, d: F.struct(
                d["at"].alias("at"), F.concat(b["out"], F.array(d["out"])).alias("out")))

        chunks = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / 256).cast("int"))
        nested = F.aggregate(chunks, F.struct(zero.alias("at"), nothing(f"array<{kind}>").alias("out")), chunk,
                             lambda a: F.flatten(a["out"]))
        return F.when(F.size(own) > 256, nested).when(F.size(own) > 0, F.aggregate(own, begin(zero), step, lambda a: a["out"]))

    # bound as the element of an array, the items are computed once and not once per chunk
    return F.transform(F.array(items), whole)[0]


def running_spans(steps: Column) -> Column:
    """Spans from steps (gap before, size) of consecutive pieces: array of (start, stop), from 0; null if there are none."""
    start = lambda at, s: at + s["gap"]
    return scan_array(steps, F.lit(0), lambda at, s: start(at, s) + s["size"], lambda at, s: F.struct(
        start(at, s).alias("start"), (start(at, s) + s["size"]).alias("stop")), "struct<start:int,stop:int>")
