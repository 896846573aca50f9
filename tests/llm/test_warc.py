import base64
import gzip
import hashlib
import os
import random
import tempfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortflow.llm.sql import archived_pages
from cohortflow.llm.warc import MAGIC, archive_records, archive_report, read_archives, record_bytes, write_archives

SF = "/root/testdata/sf0.001"
RANGE = "spark.sql.files.maxPartitionBytes"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows):
    """(page_id, html) to the report's rows."""
    least = {}
    for i, html in rows:
        key = (html or "").encode()
        if i is not None and (key not in least or i < least[key]):
            least[key] = i
    out = []
    for i, html in rows:
        body = (html or "").encode()
        first = least.get(body)
        response = first is None or i == first
        out.append((i, len(body), digest(body), "response" if response else "revisit", None if response else first))
    return sorted(out, key=str)


@pytest.fixture()
def small_ranges(spark):
    old = spark.conf.get(RANGE)
    spark.conf.set(RANGE, "700")
    yield
    spark.conf.set(RANGE, old)


def test_pages_against_brute_force_and_sql(spark, small_ranges):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    copies = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000)
    pages = pages.unionAll(copies).repartition(3)
    got = archive_report(pages)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    cur = con.execute(archived_pages())
    assert got.columns == [d[0] for d in cur.description]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == expected([(r["page_id"], r["html"]) for r in pages.collect()]) == sorted(cur.fetchall(), key=str)
    assert any(r[3] == "revisit" for r in rows)


def test_awkward_pages(spark):
    rows = [(5, "http://x/ä\r\nEvil: 1", "same"), (3, None, "same"), (3, "u", "same"), (4, "u", None), (2, "u", ""), (None, "u", "same"),
            (None, "u", "alone"), (None, "u", "alone"), (9, "u", "\x00\r\n\r\nWARC/1.1\r\n" * 50), (10, "u", "é😀" * 400000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("x") for c in ("id", "uri", "key", "member", "original", "path", "record", "payload", "record_id")})
    got = sorted(map(tuple, archive_report(df).collect()), key=str)
    assert got == expected([(r[0], r[2]) for r in rows])
    assert archive_report(df.where("false")).count() == 0


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = tempfile.mkdtemp(dir="/tmp") + "/a"
    write_archives(archive_records(df, least_bytes=3), path)
    kinds = {r["record_id"]: (r["record_type"], r["refers_to"], r["payload"]) for r in read_archives(spark, path).collect()}
    assert kinds == {"urn:page:1": ("response", None, b"ab"), "urn:page:2": ("response", None, b"ab"),
                     "urn:page:3": ("response", None, b"abcd"), "urn:page:4": ("revisit", "urn:page:3", None)}
    packed = b"".join(open(os.path.join(path, f), "rb").read() for f in os.listdir(path) if f.startswith("part"))
    assert gzip.decompress(packed).count(b"WARC/1.1\r\n") == 4


def member(i, payload, level=0):
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    raw = record_bytes("response", f"r{i}", "u", "2020-01-01T00:00:00Z", digest(payload), len(payload), payload)
    return z.compress(raw) + z.flush()


def write(packed, name="x.warc"):
    folder = tempfile.mkdtemp(dir="/tmp")
    with open(f"{folder}/{name}", "wb") as f:
        f.write(packed)
    return folder


def payloads(spark, folder):
    return sorted((r["record_id"], r["payload"], r["digest_ok"]) for r in read_archives(spark, folder).collect())


def test_magic_bytes_inside_records(spark, small_ranges):
    # stored members, so that the payload's magics are in the file; ranges end between them
    rng = random.Random(1)
    bodies = [b"".join(rng.choice([MAGIC, MAGIC + b"\x00", b"x" * 90, b"\x1f", bytes([rng.randrange(256)])]) for _ in range(rng.randint(0, 200)))
              for _ in range(60)]
    folder = write(b"".join(member(i, b, rng.choice([0, 0, 6])) for i, b in enumerate(bodies)))
    for size in ("300", "700", "5000", "100000"):
        spark.conf.set(RANGE, size)
        assert payloads(spark, folder) == sorted((f"r{i}", b, True) for i, b in enumerate(bodies))


def test_damaged_members_cost_only_themselves(spark, small_ranges):
    bodies = [bytes([97 + i]) * 500 + MAGIC * 5 for i in range(12)]
    parts = [member(i, b, 0) for i, b in enumerate(bodies)]
    parts[2] = parts[2][:400]                            # cut off
    parts[5] = parts[5][:-8] + b"\0" * 8                 # wrong checksum
    parts[7] = MAGIC + os.urandom(300) + b"garbage"
    folder = write(b"".join(parts))
    for size in ("400", "900", "100000"):
        spark.conf.set(RANGE, size)
        assert payloads(spark, folder) == sorted((f"r{i}", b, True) for i, b in enumerate(bodies) if i not in (2, 5, 7))


def test_files_named_gz_and_wrong_digests(spark):
    raw = record_bytes("response", "r", "u", "d", digest(b"other"), 3, b"abc")
    packed = gzip.compress(raw) + member(2, b"q")
    assert payloads(spark, write(packed)) == [("r", b"abc", False), ("r2", b"q", True)]
    with pytest.raises(ValueError, match="named .gz"):
        read_archives(spark, write(packed, "x.warc.gz"))


def test_magic_at_the_very_end_of_a_file(spark, small_ranges):
    # the last four bytes of a member are the record's size: here three of them look like a member's beginning
    size = 0x088B1F00
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nContent-Length: 0\r\n\r\n"
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    packed = z.compress(raw + b" " * (size - len(raw))) + z.flush()
    assert packed.endswith(MAGIC)
    spark.conf.set(RANGE, "30000")
    assert [r[0] for r in payloads(spark, write(packed))] == ["r"]
