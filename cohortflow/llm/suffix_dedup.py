"""Exact removal of repeated byte strings by a distributed prefix-free parse.

Every string of ``length`` bytes (a window) that also starts elsewhere in the corpus is removed.

*Triggers and phrases.* A rolling hash of 16 bytes is taken at every position; the trigger of
a window is the place of the smallest hash among its first ``span`` positions (the last such place). It
depends on the window's bytes alone, so equal windows have their triggers at the same offset, and
no window is without one. Consecutive windows with one trigger form a phrase: its text
runs from its first window's first byte to its last window's last byte.

*Parse and dictionary.* The text from the trigger on, which all windows of the phrase share, orders
phrases (``kappa``); equal phrase texts are one dictionary entry with a count. A phrase holds all bytes of its windows, so
no window runs into the next phrase: the parse is ordered to the depth of one phrase, by entry, and
an entry's suffix of ``length`` bytes or more stands in corpus order once for each place of the entry in the parse.
Windows can only be equal if their phrases agree in kappa, so the dictionary is sorted kappa by kappa:
  - phrases whose kappa occurs once: no window of theirs has an equal neighbour in corpus order;
  - dictionary entries that occur twice or more in the parse: all their windows have;
  - single entries under a kappa that others share: the suffix array of the kappa's entries (one occurrence of each)
    brings equal windows next to each other. The entries of a kappa meet in one task, unless
    they are many: then they are cut into pieces of 16 windows, a piece's core (the bytes that all its
    windows share) is counted first, and where unequal pieces share a core the bytes around it decide each window.

*Scale.* Each step is a grouped count with partial aggregation or a join that the adaptive
skew join can split; copies of a text share one key (hash of the text), so a group of copies
is reduced before it is shuffled. Two bit sets (at most 2**MAX_BITS bits, whatever the input)
keep phrases that cannot matter from being shuffled; their false positives only add rows that
later counts rule out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.common import bounded_batches, settle, text_slices, trimmed

GRAM = 16
PIECE = 16
CROWD = 256                 # dictionary entries of one kappa from which they are compared in pieces
MAX_BITS = 28               # bit sets hold at most 2**28 bits (32 MB)
BATCH_BYTES = 1 << 19
_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LOW = np.uint64(0xFFFFFFFF)


def _span(length: int) -> int:
    if length < 40:
        raise ValueError("windows must have at least 40 bytes")
    return 1 << int(np.log2(length * 2 / 3))


def _phrases(texts: list[bytes], length: int):
    """Phrases of all texts: buffer, then arrays text number, trigger, first and last window start, and the texts' offsets."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.cumsum(sizes) - sizes
    raw = b"".join(texts)
    span, n = _span(length), len(raw)
    none = np.zeros(0, dtype=np.int64)
    if not (sizes >= length).any():
        return raw, none, none, none, none, offsets
    eight = np.ndarray((n - 7,), dtype="<u8", buffer=raw, strides=(1,))
    h = eight[:n - GRAM + 1] * _C1
    h ^= eight[GRAM - 8:] * _C2
    h ^= h >> np.uint64(29)
    h *= _C3
    h &= ~_LOW
    h |= _LOW - np.arange(len(h), dtype=np.uint64)           # ties: the last place
    reach = 1
    while reach < span:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    valid = np.zeros(n + 1, dtype=np.int8)
    long = sizes >= length
    valid[offsets[long]] = 1
    valid[offsets[long] + sizes[long] - length + 1] -= 1
    starts = np.nonzero(np.cumsum(valid[:n], dtype=np.int8))[0]
    trigger = (_LOW - (h[starts] & _LOW)).astype(np.int64)
    new = np.empty(len(starts), dtype=bool)
    new[0] = True
    new[1:] = (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(starts)) - 1
    text = np.searchsorted(offsets, starts[first], side="right") - 1
    # empty texts share an offset with their successor; the successor is the last of them
    return raw, text, trigger[first], starts[first], starts[last], offsets


def _parts(batch, column: int):
    """Row numbers and texts of an Arrow batch, a few megabytes at a time."""
    for first, texts in text_slices(batch.column(column), BATCH_BYTES):
        yield np.arange(first, first + len(texts)), texts


def _kappa(raw, triggers, width: int) -> np.ndarray:
    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:a + width]) for a in triggers.tolist()), np.uint64, len(triggers))


def _in_bits(bits: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    slot = (hashes >> np.uint64(64 - width)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _places(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One mixed 64-bit number of a phrase's text and place."""
    x = (key.view(np.uint64) ^ (at.view(np.uint64) * _C1)) * _C2
    return (x ^ (x >> np.uint64(31))) * _C3


def _bit_set(hashes: DataFrame, width: int):
    """Bit set of the leading ``width`` bits of a long column, built by Spark in pages of 32,768 bits."""
    slots = hashes.select(F.shiftrightunsigned(hashes.columns[0], 64 - width).alias("slot"))
    pages = slots.groupBy(F.shiftright("slot", 15).alias("page")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    bits = np.zeros(max(1 << width, 32768) >> 3, dtype=np.uint8)
    for p in pages:
        bits[p["page"] << 12:(p["page"] + 1) << 12] = np.frombuffer(p["bits"], dtype=np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def _width(n: int) -> int:
    return min(MAX_BITS, max(15, int(np.ceil(np.log2(16 * max(n, 1))))))


def _keyed(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    """Text bytes with the key of their content: 64 bits, and 16 more in ``tag``."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*more, F.xxhash64(text).alias("key"), F.hash(text).cast("long").bitwiseAND(F.lit(0xFFFF)).alias("tag"),
                       text.cast("binary").alias("bytes"))


def _schema(*fields: str) -> T.StructType:
    return T.StructType([T.StructField(f, T.BinaryType() if f in ("left", "right") else T.LongType()) for f in fields])


def _packed(start: np.ndarray, count: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """A run of window starts in one long: start, number of starts less one, tag of the text."""
    return (start << 24) | (count << 16) | tag


def repeated_runs(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """Runs of repeated windows by text: (key, at), where ``at`` packs first start, run length and tag."""
    span = _span(length)
    width_kappa = length - span + 1
    texts = _keyed(docs, text_col)

    def kappas(batches):
        for batch in batches:
            for _, part in _parts(batch, 0):
                raw, _, trigger, _, _, _ = _phrases(part, length)
                yield pa.RecordBatch.from_arrays([pa.array(_kappa(raw, trigger, width_kappa).view(np.int64))], names=["kappa"])

    shared = settle(texts.select("bytes").mapInArrow(trimmed(kappas), _schema("kappa")).groupBy("kappa")
                    .agg(F.count("*").alias("n")).where("n > 1").select("kappa"), "kappas")
    bits = _width(shared.count())
    seen = _bit_set(shared, bits)

    def candidates(batches):
        for batch in batches:
            keys, tags = (batch.column(i).to_numpy() for i in (0, 1))
            for rows, part in _parts(batch, 2):
                raw, text, trigger, first, last, offsets = _phrases(part, length)
                kappa = _kappa(raw, trigger, width_kappa)
                hit = np.nonzero(_in_bits(seen.value, kappa, bits))[0]
                text, trigger, first, last = text[hit], trigger[hit], first[hit], last[hit]
                view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
                entry = np.fromiter((digest(view[s:e + length], a - s) for a, s, e in
                                     zip(trigger.tolist(), first.tolist(), last.tolist())), np.uint64, len(hit))
                key, at = keys[rows[text]], _packed(first - offsets[text], last - first, tags[rows[text]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in (kappa[hit], entry, _places(key, at), key, at)],
                    names=["kappa", "entry", "place", "key", "at"])

    parse = settle(texts.mapInArrow(trimmed(candidates), _schema("kappa", "entry", "place", "key", "at")), "parse")
    dictionary = settle(parse.groupBy("kappa", "entry").agg(F.count("*").alias("n"), F.min("place").alias("place")),
                        "dictionary")
    repeated = parse.join(dictionary.where("n > 1").select("kappa", "entry"), ["kappa", "entry"]).select("key", "at")
    mixed = dictionary.groupBy("kappa").agg(F.count("*").alias("entries")).where("entries > 1")
    sources = settle(dictionary.join(mixed, "kappa").select("kappa", "place", "entries"), "sources")
    crowded = sources.where(F.col("entries") > CROWD).select("kappa").distinct()
    n_sources, n_crowded = sources.count(), crowded.count()
    if not n_sources:
        return repeated
    place_bits, crowd_bits = _width(n_sources), _width(n_crowded)
    wanted = _bit_set(sources.select("place"), place_bits)
    crowds = _bit_set(crowded, crowd_bits)

    def sources_of(batches, in_crowd: bool):
        """Phrases of the sources, one of each per task: buffer, then row, trigger, first, last, offset, kappa arrays."""
        told: set[int] = set()
        for batch in batches:
            keys, tags = (batch.column(i).to_numpy() for i in (0, 1))
            for rows, part in _parts(batch, 2):
                raw, text, trigger, first, last, offsets = _phrases(part, length)
                at = _packed(first - offsets[text], last - first, tags[rows[text]])
                place = _places(keys[rows[text]], at)
                hit = np.nonzero(_in_bits(wanted.value, place, place_bits))[0]
                kappa = _kappa(raw, trigger[hit], width_kappa)
                hit, kappa = (x[_in_bits(crowds.value, kappa, crowd_bits) == in_crowd] for x in (hit, kappa))
                new = [i for i, p in enumerate(place[hit].tolist()) if p not in told and not told.add(p)]
                hit, kappa = hit[new], kappa[new]
                t = text[hit]
                yield raw, kappa, trigger[hit], first[hit], last[hit], offsets[t], keys[rows[t]], tags[rows[t]]

    def phrase_texts(batches):
        for raw, kappa, _, first, last, offset, key, tag in sources_of(batches, False):
            yield pa.RecordBatch.from_arrays(
                [pa.array(kappa.view(np.int64)), pa.array([raw[s:e + length] for s, e in zip(first.tolist(), last.tolist())], pa.binary()),
                 pa.array(key), pa.array(_packed(first - offset, last - first, tag))], names=["kappa", "text", "key", "at"])

    local = (texts.mapInArrow(trimmed(phrase_texts), T.StructType([*_schema("kappa"), T.StructField("text", T.BinaryType()),
                                                          *_schema("key", "at")]))
             .distinct()                    # tasks with copies of one text send it once each
             .repartition("kappa").sortWithinPartitions("kappa")
             .mapInArrow(trimmed(lambda batches: _twice_in_groups(batches, length)), _schema("key", "at")))
    if not n_crowded:
        return repeated.unionAll(local)

    names = ("core1", "core2", "left", "right", "key", "tag", "base", "low", "high")

    def pieces(batches):
        for raw, _, trigger, first, last, offset, key, tag in sources_of(batches, True):
            out: list[list] = [[] for _ in names]
            for a, s, e, o, *own in zip(*(x.tolist() for x in (trigger, first, last, offset, key, tag))):
                for t in range((a - e) // PIECE, (a - s) // PIECE + 1):
                    p = a - PIECE * t                     # last window start of the whole piece
                    core = xxhash.xxh3_128_intdigest(raw[p:p + length - PIECE + 1])
                    values = (core >> 64, core & (2 ** 64 - 1), raw[max(p - PIECE + 1, 0):p].rjust(PIECE - 1, b"\0"),
                              raw[p + length - PIECE + 1:p + length], *own, p - o, p - min(e, p), p - max(s, p - PIECE + 1))
                    for column, v in zip(out, values):
                        column.append(v)
            longs = [pa.array(np.array(c, dtype=np.uint64 if i < 2 else np.int64).view(np.int64)) if i not in (2, 3)
                     else pa.array(c, pa.binary()) for i, c in enumerate(out)]
            yield pa.RecordBatch.from_arrays(longs, names=list(names))

    cut = settle(texts.mapInArrow(trimmed(pieces), _schema(*names)), "pieces")
    cores = cut.groupBy("core1", "core2").agg(F.count("*").alias("n")).where("n > 1").select("core1", "core2")
    # pieces equal with all that surrounds them repeat as a whole; the windows of one of them meet the others'
    whole = ["core1", "core2", "left", "right", "low", "high"]
    ranked = settle(cut.join(cores, ["core1", "core2"])
                    .withColumn("mix", F.xxhash64("key", "tag", "base")), "shared")
    kinds = settle(ranked.groupBy(*whole).agg(F.count("*").alias("n"), F.min("mix").alias("first")), "kinds")
    equal = ranked.join(kinds.where("n > 1").select(*whole), whole).select(
        "key", F.shiftleft(F.col("base") - F.col("high"), 24).bitwiseOR(F.shiftleft(F.col("high") - F.col("low"), 16))
        .bitwiseOR(F.col("tag")).alias("at"))
    others = kinds.groupBy("core1", "core2").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core1", "core2")
    back = F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int"))).alias("back")
    same = ["core1", "core2", "back", "left", "right"]

    def windows(rows: DataFrame, *columns) -> DataFrame:
        return rows.join(others, ["core1", "core2"]).select("*", back).select(
            "core1", "core2", "back", F.substring("left", F.lit(PIECE) - F.col("back"), F.col("back")).alias("left"),
            F.substring("right", F.lit(1), F.lit(PIECE - 1) - F.col("back")).alias("right"), *columns)

    twice = windows(kinds).groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*same)
    lone = ranked.join(kinds.where("n = 1").select(*whole), whole)
    single = windows(lone, "key", "tag", (F.col("base") - F.col("back")).alias("start")).join(twice, same).select(
        "key", F.shiftleft("start", 24).bitwiseOR(F.col("tag")).alias("at"))
    return repeated.unionAll(local).unionAll(equal).unionAll(single)


def suffix_array(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``raw`` in the order of the ``depth`` bytes from each (at least 8), and each place's rank there.

    Equal strings share a rank, the number of the first of them in the order. Prefix doubling: places ordered by
    ``reach`` bytes are ordered by twice as many through the rank of the place ``reach`` bytes on; only places that
    are still tied are sorted again. What would lie beyond the end comes first.
    """
    n = len(raw)
    head = np.ndarray((n,), ">u8", buffer=raw.tobytes() + bytes(8), strides=(1,)).astype(np.uint64)
    order = np.argsort(head)
    slots, places, rank, key = np.arange(n), order, np.empty(n, np.int64), head[order]
    reach = 8
    while len(slots):
        new = np.ones(len(slots), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        if reach == depth:
            break
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots, step = slots[~alone], min(reach, depth - reach)
        places = order[slots]
        follow = places + step
        key = rank[places] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        again = np.argsort(key)
        places, key = places[again], key[again]
        order[slots] = places
        reach += step
    return order, rank


def _twice_in_groups(batches, length: int):
    """Runs of windows that occur twice among the phrase texts of one kappa; rows come sorted by kappa."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        kappa = table.column(0).to_numpy()
        whole = int((kappa != kappa[-1]).sum()) if len(kappa) else 0
        kept = table.slice(whole)           # the last kappa may go on in the next batch
        if whole:
            yield _runs_twice(table.slice(0, whole), length)
    if kept is not None and kept.num_rows:
        yield _runs_twice(kept, length)


def _runs_twice(table: pa.Table, length: int) -> pa.RecordBatch:
    keys, ats, out = table.column(2).to_numpy(), table.column(3).to_numpy(), ([], [])
    texts = table.column(1).to_pylist()
    kappa = table.column(0).to_numpy()
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends, cuts = np.cumsum(sizes), [0]
    for i in np.nonzero(kappa[1:] != kappa[:-1])[0] + 1:        # parts of whole kappas, of some megabytes
        if ends[i - 1] - (ends[cuts[-1] - 1] if cuts[-1] else 0) >= BATCH_BYTES:
            cuts.append(int(i))
    cuts.append(len(texts))
    for a, b in zip(cuts, cuts[1:]):
        raw = np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8)
        in_order, rank = suffix_array(raw, length)
        stops = np.cumsum(sizes[a:b])
        counts = sizes[a:b] - length + 1
        row = np.repeat(np.arange(a, b), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = place + np.repeat(stops - sizes[a:b], counts)
        is_window = np.zeros(len(raw), dtype=bool)
        is_window[start] = True
        in_order = in_order[is_window[in_order]]        # suffixes of ``length`` bytes or more of one entry
        same = rank[in_order[1:]] == rank[in_order[:-1]]
        twice = np.zeros(len(raw), dtype=bool)
        twice[in_order[1:][same]] = True
        twice[in_order[:-1][same]] = True
        hit = np.nonzero(twice[start])[0]
        if len(hit):
            new = np.ones(len(hit), dtype=bool)
            new[1:] = (row[hit][1:] != row[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1)
            first = np.nonzero(new)[0]
            size = np.diff(np.append(first, len(hit)))
            r, p = row[hit[first]], place[hit[first]]
            out[0].append(keys[r])
            out[1].append(_packed((ats[r] >> 24) + p, size - 1, ats[r] & 0xFFFF))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out],
                                      names=["key", "at"])


def _covered(n: int, runs: list[int], length: int) -> np.ndarray:
    """Byte mask of what the runs of repeated windows cover."""
    edges = np.zeros(n + 1, dtype=np.int32)
    packed = np.array(runs, dtype=np.int64)
    start, more = packed >> 24, (packed >> 16) & 0xFF
    np.add.at(edges, start, 1)
    np.add.at(edges, start + more + length, -1)
    return np.cumsum(edges[:n]) > 0


def remove_repeats(docs: DataFrame, length: int = 200, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """Per row: the id columns, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept text.

    The kept text leaves out bytes of a character that was cut in two. Null texts count as empty; a text
    that occurs twice repeats as a whole (from ``length`` bytes on). Repeated rows repeat.
    """
    runs = (repeated_runs(docs, length, text_col).withColumn("tag", F.col("at").bitwiseAND(F.lit(0xFFFF)))
            .groupBy("key", "tag").agg(F.collect_set("at").alias("runs")))
    texts = _keyed(docs, text_col, *id_cols)
    joined = texts.join(runs, ["key", "tag"], "left").select(*id_cols, "bytes", "runs")
    schema = T.StructType([*(docs.schema[c] for c in id_cols),
                           *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
                           T.StructField("kept_sha256", T.StringType()),
                           *([T.StructField("kept_text", T.StringType())] if with_text else [])])

    def cut(batches):
        for batch in batches:
            texts_, runs_ = (batch.column(len(id_cols) + i).to_pylist() for i in (0, 1))
            out: list[list] = [[] for _ in range(5)]
            for raw, marks in zip(texts_, runs_):
                kept, removed, spans = raw, 0, 0
                if marks:
                    mask = _covered(len(raw), marks, length)
                    removed, spans = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(raw, dtype=np.uint8)[~mask].tobytes()
                for column, v in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(),
                                           kept.decode("utf-8", "ignore") if with_text else None)):
                    column.append(v)
            arrays = [pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(c, pa.string()) for c in out[3:4 + with_text]]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(id_cols))] + arrays, names=schema.names)

    return joined.mapInArrow(trimmed(cut), schema)


def repeats_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, for windows of 200 bytes.

    Null texts are empty; repeated rows repeat, and each removes the other's bytes; an empty table gives an empty result; other columns are
    not read. A very long text is cut into phrases as a whole, in one task.
    """
    return remove_repeats(docs, 200)
