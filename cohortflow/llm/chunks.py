"""A bounded table of text chunks and the numbers a tokenizer gives them, gathered by numpy."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

MAX_CHUNKS = 250_000      # chunks of one generation; a Python worker keeps two
MAX_BYTES = 40 << 20      # of one generation, as estimated
ENTRY_BYTES = 150         # of a chunk besides its text and numbers


class _Generation:
    """Chunks with their numbers, one after the other in one array."""

    def __init__(self, code: str):
        self.place: dict[bytes, int] = {}
        self.starts, self.sizes, self.numbers, self.bytes = array("q"), array("q"), array(code), 0

    def add(self, chunks: list[bytes], numbers: np.ndarray, sizes: np.ndarray) -> None:
        """New chunks, their numbers in a row and how many each has."""
        base, sizes = len(self.starts), sizes.astype(np.int64)
        self.place.update(zip(chunks, range(base, base + len(chunks))))
        self.starts.frombytes((len(self.numbers) + np.cumsum(sizes) - sizes).tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.numbers.frombytes(numbers.astype(self.numbers.typecode).tobytes())
        self.bytes += ENTRY_BYTES * len(chunks) + sum(map(len, chunks)) + len(numbers) * self.numbers.itemsize

    def gather(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of known chunks in a row, and how many each has."""
        at = np.fromiter(map(self.place.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        if not len(at) or not len(self.numbers):        # no view is returned: an array that has one cannot grow
            return np.zeros(0, self.numbers.typecode), np.zeros(len(at), np.int64)
        numbers = np.frombuffer(self.numbers, dtype=self.numbers.typecode)
        sizes, starts = (np.frombuffer(x, dtype=np.int64)[at] for x in (self.sizes, self.starts))
        ends = np.cumsum(sizes)
        return numbers[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)], sizes


class ChunkTable:
    """Numbers of chunks (bytes), asked from ``learn`` once per new chunk.

    ``fixed`` holds chunks whose numbers are given. ``code`` is the array type code of the numbers. Chunks live in two
    generations: a full young one becomes the old one, whose chunks move to the new young one when they are needed again. So frequent
    chunks stay and only those not met for a whole generation are forgotten.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[Sequence]], code: str = "I",
                 fixed: dict[bytes, Sequence] | None = None, max_chunks: int = MAX_CHUNKS, max_bytes: int = MAX_BYTES):
        self.learn, self.code, self.fixed = learn, code, fixed or {}
        self.max_chunks, self.max_bytes = max_chunks, max_bytes
        self.old = self.young = _Generation(code)
        self.turn()

    def turn(self) -> None:
        """Begin a new generation."""
        self.old, self.young = self.young, _Generation(self.code)
        self.add(list(self.fixed), list(self.fixed.values()))

    def add(self, chunks: list[bytes], numbers: list[Sequence]) -> None:
        sizes = np.fromiter(map(len, numbers), np.int64, len(chunks))
        self.young.add(chunks, np.fromiter(chain.from_iterable(numbers), np.dtype(self.code), int(sizes.sum())), sizes)

    def find(self, chunk: bytes) -> Sequence | None:
        for g in (self.young, self.old):
            k = g.place.get(chunk)
            if k is not None:
                return g.numbers[g.starts[k]:g.starts[k] + g.sizes[k]]
        return None

    def require(self, chunks: set[bytes]) -> None:
        """Have all chunks in the young generation."""
        missing = [c for c in chunks if c not in self.young.place]
        if missing and (len(self.young.place) + len(missing) > self.max_chunks or self.young.bytes > self.max_bytes):
            self.turn()
            missing = [c for c in chunks if c not in self.young.place]
        again = [c for c in missing if c in self.old.place]
        if again:
            self.young.add(again, *self.old.gather(again))
            missing = [c for c in missing if c not in self.old.place]
        for at in range(0, len(missing), 8192):
            part = missing[at:at + 8192]
            self.add(part, self.learn(part))

    def gather(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all chunks in a row, and how many each chunk has."""
        self.require(set(chunks))
        return self.young.gather(chunks)

    def gather_texts(self, chunks: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``gather``, for texts of ``counts`` consecutive chunks: numbers and how many each text has."""
        numbers, sizes = self.gather(chunks)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return numbers, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
