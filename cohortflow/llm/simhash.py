"""SimHash near-duplicates: segment-popcount embedding, grid join, exact verification.

A text's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.
Equal fingerprints form one class, so groups of copies are one row from the first shuffle on.

Classes are embedded by the number of set bits in each two-bit segment: 32 counts, kept in one
long in unary code, so that the Manhattan distance of two embeddings is the number of
differing code bits. Changing one fingerprint bit changes one count by one, hence the Manhattan distance never
exceeds the Hamming distance. The grid: segments are dealt into blocks, and two embeddings at
distance d <= D agree exactly on all but at most D blocks, so they share the grid cell of at
least one choice of (blocks - D) blocks. Joining cells, keeping pairs within Manhattan
distance D and verifying the Hamming distance finds every link. More blocks make finer cells;
their number follows the number of classes and only moves cost.

Members of crowded cells (many fingerprints that agree on most counts) are dealt out once more, by blocks of
the fingerprint's own bits: within distance D two agree exactly on all but D blocks. Only what agrees in four whole blocks of seven
and is still crowded is cut into tiles; a tile links its members by breadth-first search, so a dense group costs a
spanning forest and not all its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import bounded_batches, settle, text_slices, trimmed
from cohortflow.llm.components import connected_components

SEED = 42
SEGMENTS = 32
LOW = 0x5555555555555555
CROWD = 48          # members from which a cell is tiled
BATCH_BYTES = 1 << 19
TILE = 512          # members of each side of a tile


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view(np.int64)[0])


def text_fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint; zero for null texts and texts without words."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    parts = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    return _majority(np.fromiter((digest(join(p), SEED) for p in parts), dtype=np.uint64, count=n))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bounded_batches(docs.sparkSession)
    @F.arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(lambda own: (pa.array([text_fingerprint(t, shingle) for _, part in text_slices(texts, BATCH_BYTES) for t in part],
                                             pa.int64()) for texts in own))(batches)

    return docs.select(F.col(id_col), fingerprint(F.col(text_col).cast("binary")).alias("fp"))


def unary_counts(fp: Column) -> Column:
    """Set bits of each two-bit segment in unary code: 00, 01 or 11."""
    low, half = F.lit(LOW), F.shiftrightunsigned(fp, 1)
    return ((fp.bitwiseOR(half)).bitwiseAND(low)).bitwiseOR(
        F.shiftleft((fp.bitwiseAND(half)).bitwiseAND(low), 1))


def grid_masks(n_classes: int, distance: int) -> list[int]:
    """Code masks of the grid: every choice of all but ``distance`` blocks of segments.

    Two random segments agree with probability 3/8, so a cell over m segments holds about
    n * (3/8)**m unrelated classes; the fewest blocks that bring this below one are taken.
    """
    for blocks in range(distance + 2, SEGMENTS + 1):
        sizes = [len(b) for b in np.array_split(np.arange(SEGMENTS), blocks)]
        if n_classes * 0.375 ** (SEGMENTS - sum(sorted(sizes)[-distance:] if distance else [])) < 0.5 or blocks == 14:
            break
    parts = np.array_split(np.arange(SEGMENTS), blocks)
    bits = [sum(3 << (2 * int(s)) for s in p) for p in parts]
    masks = [sum(c) for c in itertools.combinations(bits, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _forest(distance: int):
    """Spanning forest of one tile: links between members at most ``distance`` bits apart."""

    def link(tile: pd.DataFrame) -> pd.DataFrame:
        fp = tile["fp"].to_numpy().view(np.uint64)
        rest, out = np.arange(len(fp)), []
        while len(rest) > 1:
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                near = np.bitwise_count(fp[front[0]] ^ fp[rest]) <= distance
                out += [(fp[front[0]], x) for x in fp[rest[near]]]
                front, rest = np.concatenate([front[1:], rest[near]]), rest[~near]
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return link


def bit_masks(distance: int) -> list[int]:
    """Masks of fingerprint bits: every choice of all but ``distance`` blocks of bits, four blocks more than the distance."""
    parts = np.array_split(np.arange(64), distance + 4)
    bits = [sum(1 << int(b) for b in p) for p in parts]
    masks = [sum(c) for c in itertools.combinations(bits, 4)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _cells(members: DataFrame, key: str, masks: list[int], name: str) -> DataFrame:
    """Members (fp, code) with every cell (grid, cell) they share with others, and its size n."""
    cells = members.select("fp", "code", F.posexplode(F.array(*[F.col(key).bitwiseAND(F.lit(m)) for m in masks]))
                           .alias("grid", "cell"))
    sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    return settle(cells.join(sizes, ["grid", "cell"]).select("grid", "cell", "n", "fp", "code"), name)


def _pairs(cells: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) within small cells that the Manhattan bound lets through and the Hamming distance confirms."""
    left, right = (cells.select("grid", "cell", F.col("fp").alias(f), F.col("code").alias(c))
                   for f, c in (("a", "code_a"), ("b", "code_b")))
    differ = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    return (left.join(right, ["grid", "cell"])
            .where((F.col("a") < F.col("b")) & (differ("code_a", "code_b") <= distance) & (differ("a", "b") <= distance))
            .select("a", "b"))


def links(classes: DataFrame, distance: int = 3) -> DataFrame:
    """Fingerprint pairs (a, b) within ``distance`` bits; for crowded tiles a spanning forest of them.

    ``classes`` holds distinct long column ``fp``. Every two fingerprints within the distance
    end up in one connected component of the result.
    """
    coded = classes.select("fp", unary_counts(F.col("fp")).alias("code"))
    shared = _cells(coded, "code", grid_masks(classes.count(), distance), "cells")
    # members of crowded cells, each once, are dealt anew by the bits themselves
    crowd = shared.where(F.col("n") > CROWD).select("fp", "code").distinct()
    finer = _cells(crowd, "fp", bit_masks(distance), "finer")
    pairs = _pairs(shared.where(F.col("n") <= CROWD), distance).unionAll(_pairs(finer.where(F.col("n") <= CROWD), distance))
    # a member of part p joins the tiles {p, q} of every part q
    parts = F.ceil(F.col("n") / TILE).cast("int")
    part = F.pmod(F.xxhash64("fp"), parts).cast("int")
    tiled = (finer.where(F.col("n") > CROWD)
             .select("grid", "cell", "fp", part.alias("p"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("q"))
             .select("grid", "cell", "fp", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")))
    forest = tiled.groupBy("grid", "cell", "i", "j").applyInPandas(_forest(distance), "a long, b long")
    return pairs.unionAll(forest).distinct()


def group_fingerprints(fps: DataFrame, distance: int = 3, id_col: str = "doc_id") -> DataFrame:
    """Class table (fp, root, component_id): root is the component's smallest fingerprint."""
    classes = settle(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")), "classes")
    roots = connected_components(links(classes.select("fp"), distance))
    rooted = (classes.join(roots, classes["fp"] == roots["node"], "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id.

    The component id is the smallest doc_id reachable over links of at most ``distance`` differing
    bits. Texts without words (null, empty, blank) have fingerprint zero and link like any
    other. A null doc_id takes part but never becomes an id unless its component has no other; repeated rows
    repeat, an empty table gives an empty result. A very long text is hashed whole, in one task. Other columns are not read.
    """
    fps = settle(fingerprints(docs, shingle), "fingerprints")
    groups = group_fingerprints(fps, distance)
    return fps.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
