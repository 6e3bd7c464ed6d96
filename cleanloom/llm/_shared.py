"""What the operators of this subpackage share: tables, the shared folder, Arrow text buffers, hashing."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import removed, scratch, shared_dir, written  # noqa: F401

#: Bytes of text that a Python worker turns into numpy arrays at a time.
SLICE_BYTES = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and len(texts) + 1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batch with about `most` bytes of text each; a longer text is a piece of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, first = np.cumsum(size), 0
    while first < len(size):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(first, last - first)
        first = last


#: A longer text is walked in parts of about so many bytes.
LONG_BYTES = 4 << 20


def cuts(data: np.ndarray, may_cut: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Where the parts of a long text start, and its end; may_cut names the positions of some bytes before which a part may start."""
    at, n = [0], len(data)
    while n - at[-1] > LONG_BYTES:
        found, here = np.empty(0, np.int64), at[-1] + LONG_BYTES
        while not len(found) and here < n:
            found, here = here + may_cut(data[here : here + LONG_BYTES]), here + LONG_BYTES
        if not len(found):
            break
        at.append(int(found[0]))
    return [*at, n]


#: What a worker holds between tasks: an owner, and how to drop it.
_held: dict[str, Callable[[], None]] = {}


def held(owner: str, drop: Callable[[], None]) -> None:
    """Tells that this worker now holds something of the owner's for its later tasks."""
    _held[owner] = drop


def _release() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """run, for a worker that serves tasks of several operators: what others hold goes first, and free memory goes back after the task."""

    def task(batches: Iterator) -> Iterator:
        for other in [x for x in _held if x != owner]:
            _held.pop(other)()
        try:
            yield from run(batches)
        finally:
            _release()

    return task


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... (lengths[0] of them), then those of starts[1], ..."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of several texts, found in their bytes.

    start, length: in bytes; doc: the text of each word; first: the index of each text's first word, with
    one more entry for the end; hash: 64 bits a word, the sum of independent pseudo-random numbers for its
    (place, byte) pairs, mixed once more.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = ~_BLANK[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:]
        self.start = np.flatnonzero(begins[:-1])
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut[1:])) + 1
        self.length = ends - self.start
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        if len(self.start):
            letters = np.flatnonzero(inside[:-1])
            heads = np.append(0, np.cumsum(self.length)[:-1])
            place = (letters - np.repeat(self.start, self.length)).astype(np.uint64)
            self.hash = mix64(np.add.reduceat(mix64((place << np.uint64(8)) + data[letters] + np.uint64(0x9E3779B97F4A7C15)), heads) + self.length.astype(np.uint64))
        else:
            self.hash = np.empty(0, np.uint64)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hash and first of the Words; a single long text is walked in parts that start at blanks."""
    if len(at) != 2 or len(data) <= LONG_BYTES:
        w = Words(data, at)
        return w.hash, w.first
    ends = cuts(data, lambda x: np.flatnonzero(_BLANK[x]))
    found = np.concatenate([Words(data[a:b], np.array([0, b - a])).hash for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return found, np.array([0, len(found)])


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases the bytes A-Z.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
