"""Best-fit packing of documents into sequences: configuration program over the length histogram.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (at
most ``capacity`` rows) reaches the driver. There the configuration linear program
    minimise sum x_c   subject to   sum_c a(c, l) x_c >= n_l  for every length l
is solved approximately by multiplicative weights: a length's price grows
exponentially with the share of its demand still open, dynamic programming over the capacity
(an unbounded knapsack) finds the configuration of highest price, and it serves as much open
demand as it can. The fractional multiplicities are rounded down; what is left is packed by
best-fit decreasing on the histogram. The plan is a table of (length, rank range) to
(sequence, offset); pieces get their rank within their length from distributed counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.common import bounded_batches, settle, text_slices, trimmed
from cohortflow.llm.word_ids import word_ids

ROUNDS = 400        # pricing rounds of the linear program
RATE = 20.0         # how strongly open demand raises a price
REST = 0.02         # share of the tokens that the program may leave to best fit
BATCH_BYTES = 2 << 20


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text", **limits) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32 (ids as little-endian uint32).

    ``limits`` are those of a worker's table of words (``max_chunks``, ``max_bytes`` of a generation).
    """
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
                           *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])

    def cut(batches):
        table = word_ids(tokenizer_path, **limits)
        for batch in batches:
            for first, texts in text_slices(batch.column(1), BATCH_BYTES):
                ids, counts = table.encode(texts)
                raw, ends = memoryview(ids.astype("<u4").view(np.uint8)), np.cumsum(counts)
                out = [(r, p, s, min(capacity, n - s), zlib.crc32(raw[4 * (e - n + s):4 * (e - n + min(s + capacity, n))]))
                       for r, (n, e) in enumerate(zip(counts.tolist(), ends.tolist()), first)
                       for p, s in enumerate(range(0, n, capacity))]
                row, piece, start, length, crc = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(trimmed(cut), schema)


def best_configuration(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """Unbounded knapsack by dynamic programming: positions in ``lengths`` and their copies."""
    order = np.argsort(lengths)
    sizes, value = lengths[order], prices[order]
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = np.searchsorted(sizes, c, side="right")
        if fit:
            gain = best[c - sizes[:fit]] + value[:fit]
            k = int(gain.argmax())
            best[c], choice[c] = gain[k], k
    out, c = {}, capacity
    while c > 0 and choice[c] >= 0:
        k = int(order[choice[c]])
        out[k] = out.get(k, 0) + 1
        c -= int(lengths[k])
    return out


def configuration_program(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict:
    """Fractional multiplicities {((position, copies), ...): x} by multiplicative weights.

    A round prices lengths, takes the best configuration and serves with it all that its
    scarcest length still demands. No demand is exceeded.
    """
    open_, x = need.astype(float), {}
    for _ in range(rounds):
        if open_ @ lengths <= REST * (need @ lengths):
            break
        prices = np.where(open_ > 0, lengths / capacity * np.exp(RATE * (open_ / need - 1)), 0.0)
        configuration = tuple(sorted(best_configuration(lengths, prices, capacity).items()))
        amount = min(open_[k] / a for k, a in configuration)
        x[configuration] = x.get(configuration, 0.0) + amount
        for k, a in configuration:
            open_[k] = max(open_[k] - a * amount, 0.0)
    return x


def plan_sequences(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations ({length: copies}, multiplicity) that hold every piece of the histogram exactly once."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    left, plan = need.copy(), []

    def take(copies: dict[int, int], times: int) -> None:
        for k, a in copies.items():
            left[k] -= a * times
        plan.append(({int(lengths[k]): a for k, a in copies.items()}, times))

    for configuration, amount in configuration_program(lengths, need, capacity, rounds).items():
        times = min(int(amount + 1e-9), *(int(left[k]) // a for k, a in configuration))
        if times:
            take(dict(configuration), times)
    while (held := np.nonzero(left)[0]).size:       # best-fit decreasing on what rounding left
        room, copies, top = capacity, {}, held.size
        while top:
            top = int(np.searchsorted(lengths[held[:top]], room, side="right"))
            if not top:
                break
            k = int(held[top - 1])
            a = min(int(left[k]), room // int(lengths[k]))
            copies[k], room, top = a, room - a * int(lengths[k]), top - 1
        take(copies, min(int(left[k]) // a for k, a in copies.items()))
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies, offset), sorted by length and rank."""
    used, rows, sequence = {}, [], 0
    for copies, times in plan:
        offset = 0
        for length in sorted(copies, reverse=True):
            a = copies[length]
            rows.append((length, used.get(length, 0), sequence, a, offset))
            used[length] = used.get(length, 0) + a * times
            offset += a * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to settled pieces with a ``length`` and a unique long ``row``."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan_sequences(histogram, capacity, rounds)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table, n, r = places.value, length.to_numpy(), rank.to_numpy()
        at = np.searchsorted((table[:, 0] << 40) | table[:, 1], (n << 40) | r, side="right") - 1
        _, first, sequence, copies, offset = table[at].T
        return pd.DataFrame({"sequence_id": sequence + (r - first) // copies, "offset": offset + (r - first) % copies * n})

    return _ranked(pieces, histogram).select("*", place("length", "rank").alias("place")).select(
        *[c for c in pieces.columns if c != "row"], "place.sequence_id", "place.offset")


def _ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Rank of a piece among those of its length; a length's rows are dealt into groups of about 4 sqrt(n)."""
    spark = pieces.sparkSession
    groups = spark.createDataFrame([(n, max(1, int(c / (4 * c ** 0.5)))) for n, c in histogram.items()] or [(0, 1)],
                                   "length long, groups int")
    salted = (pieces.join(F.broadcast(groups), "length")      # at most ``capacity`` rows
              .withColumn("salt", F.pmod(F.xxhash64("row"), "groups").cast("int")).drop("groups"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
                          .alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row"))
    return (salted.withColumn("own", own).join(before, ["length", "salt"])
            .withColumn("rank", F.col("before") + F.col("own") - 1).drop("salt", "own", "before"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, **limits) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. For ``limits`` see ``token_pieces``.

    Null and empty texts are one piece that holds the end id alone. Repeated rows are packed one
    by one; null ids stay null. An empty table gives no rows. Other columns are not read.
    """
    pieces = settle(token_pieces(docs, tokenizer_path, capacity, **limits).withColumn("row", F.monotonically_increasing_id()),
                    "pieces")
    return pack(pieces, capacity)
