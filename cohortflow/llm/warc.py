"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

Archives are files of gzip members, one record a member, written by Spark's own file writer (so that commits, retries
and any Hadoop file system are its business). Between records it puts a separator, which here is the gzip member
of nothing: readers of concatenated members see only the records.

The reader lets Spark deal out byte ranges of the files. A task scans its range for the three bytes that begin a gzip
member; what follows each of them, up to the next, is a row, owned by the range it starts in. A row is a record's
beginning if unpacking its first bytes gives a WARC version line. The three bytes can also occur inside a member: an unfinished
member goes on in the rows after it. If that happens across the end of a range, the task hands on the unfinished
member, and the next range the rows before its first record; these few pieces are put together per file. Limit of
the method: a record stored without compression that itself holds a whole gzipped WARC record, cut by a range's end before the
inner one, would show the inner one as well.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import settle, settled_path

MAGIC = b"\x1f\x8b\x08"
NOTHING = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"     # gzip member of no bytes
GZIP = 31               # window bits of zlib for gzip members
LEVEL = 6
HEAD = 512              # packed bytes that are unpacked to see whether a member is a record
SEEN = 100_000          # payloads that a writing task remembers
RECORD = ("record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
          "payload_bytes long, digest_ok boolean, payload binary")
PIECE = "path string, range_start long, place int, open boolean, piece binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return z.compress(record) + z.flush()


def record_bytes(kind: str, record_id: str, uri: str | None, date: str, digest: str, size: int, payload: bytes = b"",
                 refers_to: str | None = None) -> bytes:
    """A response or revisit record, unpacked. The HTTP header of both tells the size of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {quote(uri, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: <{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def archive_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                    date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """One packed record (column ``member``, binary) per row of ``pages``.

    Of rows with equal payloads of ``least_bytes`` or more, those with the smallest id are responses and the others revisits of
    it; smaller payloads are all responses. Null payloads are empty; a null id is never smaller than another. Payloads travel
    packed, and a task sends none of which it has sent a copy with a smaller id: a payload that a third of
    all rows share moves a few times a task.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    kind = rows.schema["id"].dataType.simpleString()
    least = (rows.where(F.length("payload") >= least_bytes).groupBy(F.sha1("payload").alias("key"))
             .agg(F.min("id").alias("original")))
    name = lambda i: f"urn:page:{'' if i is None else quote(str(i))}"

    def pack(batches):
        seen: dict[str, object] = {}
        for batch in batches:
            out = []
            ids, uris, column = batch.column(0), batch.column(1), batch.column(2)
            for k in range(batch.num_rows):
                i, body = ids[k].as_py(), column[k].as_py()
                key = hashlib.sha1(body).hexdigest()
                copied = i is not None and len(body) >= least_bytes and key in seen and seen[key] < i
                if i is not None and not copied:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[key] = i
                member = None if copied else _member(record_bytes(
                    "response", name(i), uris[k].as_py(), date, payload_digest(body), len(body), body))
                out.append((key, len(body), member))
            yield pa.RecordBatch.from_arrays(
                [ids, uris, *[pa.array([o[c] for o in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.binary()))]],
                names=["id", "uri", "key", "size", "member"])

    def revisits(batches):
        for batch in batches:
            members = batch.column(4).to_pylist()
            for k, m in enumerate(members):
                if m is None:
                    i, uri, key, size, _, first = (batch.column(c)[k].as_py() for c in range(6))
                    members[k] = _member(record_bytes("revisit", name(i), uri, date, base64.b32encode(bytes.fromhex(key)).decode(),
                                                      size, refers_to=name(first)))
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])

    packed = rows.mapInArrow(pack, f"id {kind}, uri string, key string, size long, member binary")
    response = F.col("original").isNull() | (F.col("id") == F.col("original"))
    known = packed.join(least, "key", "left").select(
        "id", "uri", "key", "size", F.when(F.coalesce(response, F.lit(False)), F.col("member")).alias("member"), "original")
    return known.mapInArrow(revisits, "member binary")


def write_archives(records: DataFrame, path: str) -> None:
    """Write packed records (column ``member``) as archives under ``path``, one file per partition."""
    (records.select(F.col("member").cast("string").alias("value")).write
     .option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1").text(path))


def _begins_record(packed: bytes) -> bool:
    try:
        return zlib.decompressobj(GZIP).decompress(packed[:HEAD], 16).startswith(b"WARC/")
    except zlib.error:
        return False


def _is_member(packed: bytes) -> bool:
    z = zlib.decompressobj(GZIP)
    try:
        z.decompress(packed)
    except zlib.error:
        return False
    return z.eof


class _Unpacking:
    """A record that is being unpacked from its member's pieces."""

    def __init__(self, piece: bytes):
        self.pieces, self.parts, self.z, self.damaged = [], [], zlib.decompressobj(GZIP), False
        self.add(piece)

    def add(self, piece: bytes) -> bool:
        """Whether the member is complete with this piece."""
        self.pieces.append(piece)
        try:
            self.parts.append(self.z.decompress(piece))
        except zlib.error:
            self.damaged = True
        return self.z.eof

    def record(self, with_payload: bool) -> tuple:
        return parse_record(b"".join(self.parts), with_payload)


def _fields(header: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in header.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(record: bytes, with_payload: bool) -> tuple:
    """The fields of RECORD. The digest of a response is that of the payload read, that of a revisit the one recorded."""
    header, _, rest = record.partition(b"\r\n\r\n")
    own = _fields(header)
    length = own.get("content-length", "")
    block = rest[:int(length)] if length.isdecimal() else rest
    http, payload = {}, block
    if own.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(head)
    digest = own.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size, ok = len(payload), None
    if own.get("warc-type") == "revisit":
        size = int(http["content-length"]) if http.get("content-length", "").isdecimal() else None
        payload = None
    else:
        seen = payload_digest(payload)
        digest, ok = seen, digest == seen if digest else None
    bare = lambda k: re.sub("^<|>$", "", own[k]) if k in own else None
    return (bare("warc-record-id"), own.get("warc-type"), own.get("warc-target-uri"), own.get("warc-date"), bare("warc-refers-to"),
            digest, size, ok, payload if with_payload else None)


def _scan(rows, with_payload: bool):
    """Records and pieces from rows (path, range start, bytes after a magic) in file order.

    Yields (record fields, None) or (None, piece fields).
    """
    at, unpacking, place, leading = None, None, 0, True
    for path, start, value in rows:
        if (path, start) != at:
            if unpacking:
                yield None, (*at, place, True, b"".join(unpacking.pieces))
            at, unpacking, place, leading = (path, start), None, 0, True
            if not start:
                continue            # what stands before the file's first magic
        todo = [MAGIC + value]
        while todo:
            piece = todo.pop()
            if unpacking:
                if unpacking.add(piece):
                    yield unpacking.record(with_payload), None
                    unpacking = None
            elif _begins_record(piece):
                leading, unpacking = False, _Unpacking(piece)
                if unpacking.z.eof:
                    yield unpacking.record(with_payload), None
                    unpacking = None
            elif leading and start and not _is_member(piece):
                yield None, (path, start, place, False, piece)
                place += 1
            if unpacking and unpacking.damaged:     # a broken member is given up; what it took in may hold others
                todo += unpacking.pieces[:0:-1]
                unpacking = None
    if unpacking:
        yield None, (*at, place, True, b"".join(unpacking.pieces))


def _joined(pieces, with_payload: bool) -> list[tuple]:
    """Records from a file's pieces (range start, place, open, bytes): open members go on in the next ranges' pieces."""
    out: list[tuple] = []
    held: list[bytes] = []          # an open member and what may continue it

    def give_up():
        # it ends with the file, in these three bytes, or never: then its later pieces may hold records
        whole = _Unpacking(b"".join(held) + MAGIC)
        rows = [("", 1, x) for p in held for x in p.split(MAGIC)[1:]][1:]
        out.extend([whole.record(with_payload)] if whole.z.eof else [r for r, _ in _scan(rows, with_payload) if r])
        held.clear()

    for _, _, begins, piece in sorted(pieces, key=lambda p: (p[0], p[2], p[1])):
        if begins:
            give_up()
            held.append(piece)
        elif held:
            held.append(piece)
            unpacking = _Unpacking(b"".join(held))
            if unpacking.z.eof:
                out.append(unpacking.record(with_payload))
                held.clear()
    give_up()
    return out


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives under ``path``: columns of RECORD, and path of the file.

    Bytes that are no complete record are passed over; ``digest_ok`` tells whether a response's payload has the recorded digest (null:
    none recorded). Any file name but ``*.gz`` will do: files of that name Spark unpacks itself and never cuts into ranges.
    """
    raw = (spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1")
           .option("recursiveFileLookup", "true").text(path))
    if any(f.endswith(".gz") for f in raw.inputFiles()):
        raise ValueError("archives must not be named .gz: Spark unpacks such files by name, whole, before a range of them is read")
    rows = raw.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))
    record_names = [x.split()[0] for x in RECORD.split(", ")]
    piece_names = [x.split()[0] for x in PIECE.split(", ")]

    def scan(batches):
        def each():
            for b in batches:
                for k in range(b.num_rows):
                    yield b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].as_py()

        held, size = [], 0
        paths = each()
        last = [None]

        def noted():
            for row in paths:
                last[0] = row[0]
                yield row

        for record, piece in _scan(noted(), with_payload):
            held.append((record, piece, piece[0] if piece else last[0]))
            size += len((record or piece)[-1] or b"") + 500
            if size > 4 << 20:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    def pack(held):
        record = [dict(zip(record_names, r)) if r else None for r, _, _ in held]
        piece = [dict(zip(piece_names, p)) if p else None for _, p, _ in held]
        return pa.RecordBatch.from_arrays(
            [pa.array([f for _, _, f in held], pa.string()), pa.array(record, RECORD_TYPE), pa.array(piece, PIECE_TYPE)],
            names=["path", "record", "piece"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        found = _joined(zip(frame["range_start"], frame["place"], frame["open"], frame["piece"]), with_payload)
        out = pd.DataFrame(found, columns=record_names).astype({"payload_bytes": "Int64", "digest_ok": "boolean"})
        return out.assign(path=frame["path"].iloc[0])

    found = settle(rows.mapInArrow(scan, f"path string, record struct<{_typed(RECORD)}>, piece struct<{_typed(PIECE)}>"), "records")
    pieces = found.where("piece IS NOT NULL").select("piece.*")
    waiting = pieces.join(pieces.where("open").select("path").distinct(), "path", "left_semi")
    late = waiting.groupBy("path").applyInPandas(join, f"{RECORD}, path string")
    return found.where("record IS NOT NULL").select("record.*", "path").unionByName(late)


def _typed(ddl: str) -> str:
    return ddl.replace(" ", ":").replace(",:", ",")


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
RECORD_TYPE, PIECE_TYPE = (pa.struct([(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(", "))]) for ddl in (RECORD, PIECE))


def archive_report(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; equal payloads of any size have their smallest page_id as response (all rows of that
    id, if it is repeated) and the others as revisits of it. A null page_id is never smaller than another and is read back as
    null. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = settled_path(spark, "archives")
    write_archives(archive_records(pages.select("page_id", "url", "html")), path)
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    return read_archives(spark, path, with_payload=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
