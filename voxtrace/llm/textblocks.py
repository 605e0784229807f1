"""Vectorised reading of text columns inside Arrow tasks.

A text column arrives as one byte buffer with offsets. Words, word hashes and shingles of many
documents are found with a few array operations, in chunks of whole documents, so the memory of
a task follows the chunk and the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once (a longer document is a chunk of its own).
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
#: The byte table, and two odd multipliers (5 modulo 8: long periods) of the rolling sums.
BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, SECOND_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD95)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or that name with underscores, whichever the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns of these names renamed, and a function that brings back its columns."""
    columns, reserved = df.columns, {n.lower() for n in names}
    kept = df
    moved = {}
    for c in columns:
        if c.lower() in reserved:
            moved[c] = fresh(kept, f"_aside_{c}")
            kept = kept.withColumnRenamed(c, moved[c])
    return kept, lambda out: out.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in columns])


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text), F.lit(modulus)) == remainder


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def word_spans(
    data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the word offsets of each document.

    ``outside`` marks the bytes that separate words; documents separate them too.
    """
    solid = ~outside[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads], last[tails] = solid[heads], solid[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse."""
    have = _powers.get((int(base), inverse))
    if have is None or len(have) < n:
        step = pow(int(base), -1 if inverse else 1, 2**64)
        size = max(n, 1 << 16)
        have = np.full(size, step, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[(int(base), inverse)] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of values[lo:hi] for each span (a polynomial over 64-bit values, by prefix sums)."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    width = (hi - lo).astype(np.uint64)
    return mixed((sums[hi] - sums[lo]) * powers(base, len(values) + 1, True)[lo] + width)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, in slices of bounded size."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, "right")))
        at = starts[lo]
        out[lo:hi] = span_hashes(BYTE_KEYS[data[at : ends[hi - 1]]], starts[lo:hi] - at, ends[lo:hi] - at)
        lo = hi
    return out


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document.

    A document of fewer words is one shingle of all its words; one without words has none.
    """
    n = len(hashes)
    at = np.arange(max(0, n - width + 1))
    rolled = span_hashes(hashes, at, at + width) if len(at) else np.zeros(0, np.uint64)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= width:
            yield np.unique(rolled[lo : hi - width + 1])
        elif hi > lo:
            yield span_hashes(hashes[lo:hi], np.array([0]), np.array([hi - lo]))
        else:
            yield np.zeros(0, np.uint64)


def bounded_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """``df``, after bounding the bytes of an Arrow batch where the session leaves them open."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(c for c in df.sparkSession.conf.get(key) if c.isdigit()) or 0)
    if not 0 < now <= size:
        df.sparkSession.conf.set(key, str(size))
    return df


def array_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """list<long> column from the values of all rows and the number in each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))
