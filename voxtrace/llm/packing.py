"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Only the number of pieces of each length decides how full the sequences can get, and there are
at most ``capacity`` lengths. So the plan is made from that histogram, whatever the size of the
corpus: lengths above a third of the capacity are matched greedily, at most two to a sequence
(the largest partner that fits), then shorter lengths go, largest first, to the tightest gap
that takes them. Pieces are then numbered within their length and look up their place.

Defined results: a null or empty text is one piece holding only the end token. Repeated ids and
repeated rows are packed as often as they occur. An empty table gives no pieces. The string
``<|endoftext|>`` is one token where ``specials`` is set, as in the library's default call, and
ordinary text otherwise.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtrace.session import stage

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.tiktoken"
END = 0
#: The split of the vocabulary's pattern, with possessive repeats, which are faster.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Rows of one length that are numbered in one task, about.
BUCKET_ROWS = 100_000

#: The added token of the vocabulary.
SPECIALS = {"<|endoftext|>": 50256}

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The byte-level vocabulary of ``byte_bpe_50k.json``, as ranks, and its added token."""
    if vocabulary not in _encodings:
        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[vocabulary] = tiktoken.Encoding(
            vocabulary, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=SPECIALS
        )
    return _encodings[vocabulary]


def pieces(
    documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, specials: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. A document longer than ``capacity`` is cut into
    full pieces after a first one that takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_to_numpy
        allowed = set(SPECIALS) if specials else set()
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or "", allowed_special=allowed, disallowed_special=()), END).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append((i, k, lo, hi - lo, zlib.crc32(ids[lo:hi])))
            table = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(table[:, 0])),
                    pa.array(table[:, 1].astype(np.int32)),
                    *(pa.array(table[:, k]) for k in (2, 3, 4)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Places for all pieces: rows (length, first, per, sequence, offset).

    From number ``first`` on (within its length, from 0, up to the next row's), pieces fill
    sequences in turn from ``sequence``, ``per`` to each, the first of them at ``offset``.
    A group of equally filled sequences is one entry, so the work depends on the lengths alone.
    """
    left = {s: n for s, n in sorted(histogram.items(), reverse=True) if n > 0}
    next_number = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: [(first sequence, sequences)]
    open_gaps: list[int] = []  # sorted gaps that have sequences
    sequences = 0

    def place(size: int, per: int, sequence: int, count: int, offset: int) -> None:
        rows.append((size, next_number[size], per, sequence, offset))
        next_number[size] += per * count
        left[size] -= per * count

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((sequence, count))

    large = [s for s in left if 3 * s > capacity]
    ascending = large[::-1]
    for size in large:
        while left[size]:
            at = bisect.bisect_right(ascending, min(size, capacity - size)) - 1
            while at >= 0 and left[ascending[at]] < (2 if ascending[at] == size else 1):
                at -= 1
            if at < 0:  # no partner fits any more
                count = left[size]
                place(size, 1, sequences, count, 0)
                leave(capacity - size, sequences, count)
            elif ascending[at] == size:
                count = left[size] // 2
                place(size, 2, sequences, count, 0)
                leave(capacity - 2 * size, sequences, count)
            else:
                partner = ascending[at]
                count = min(left[size], left[partner])
                place(size, 1, sequences, count, 0)
                place(partner, 1, sequences, count, size)
                leave(capacity - size - partner, sequences, count)
            sequences += count
    for size in (s for s in left if 3 * s <= capacity):
        while left[size]:
            at = bisect.bisect_left(open_gaps, size)
            if at < len(open_gaps):
                gap = open_gaps[at]
                sequence, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            else:
                gap, sequence = capacity, sequences
                count = -(-left[size] // (capacity // size))
                sequences += count
            per = gap // size
            full = min(count, left[size] // per)
            if full:
                place(size, per, sequence, full, capacity - gap)
                leave(gap - per * size, sequence, full)
            if full < count:
                rest = left[size]
                if rest:
                    place(size, rest, sequence + full, 1, capacity - gap)
                    leave(gap - rest * size, sequence + full, 1)
                leave(gap, sequence + full + bool(rest), count - full - bool(rest))
    return pd.DataFrame(rows, columns=["length", "first", "per", "sequence", "offset"], dtype="int64")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows of pieces (doc_id, piece, length and others).

    The histogram (one row per length) is all that reaches the driver.
    """
    cut = stage(cut, "pack_pieces")
    rows = cut.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    keyed = cut.withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    )
    counts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_rows"))
    along = Window.partitionBy("length").orderBy("_bucket")
    offsets = counts.withColumn("_before", F.sum("_rows").over(along) - F.col("_rows")).drop("_rows")
    histogram = cut.groupBy("length").count().collect()
    plan = pack_plan({r["length"]: r["count"] for r in histogram}, capacity)
    by_length = {
        int(size): tuple(part[c].to_numpy() for c in ("first", "per", "sequence", "offset"))
        for size, part in plan.sort_values(["length", "first"]).groupby("length")
    }

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, rank = length.to_numpy(np.int64), number.to_numpy(np.int64)
        sequence, offset = np.empty_like(size), np.empty_like(size)
        for s in np.unique(size):
            mine = np.flatnonzero(size == s)
            first, per, start, base = by_length[int(s)]
            at = np.searchsorted(first, rank[mine], "right") - 1
            along = rank[mine] - first[at]
            sequence[mine] = start[at] + along // per[at]
            offset[mine] = base[at] + along % per[at] * s
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    numbered = keyed.withColumn("_inside", F.row_number().over(inside) - 1).join(
        offsets, ["length", "_bucket"]
    )
    placed = numbered.withColumn("_place", place("length", F.col("_inside") + F.col("_before")))
    return placed.select(*[F.col(f"`{c}`") for c in cut.columns], "_place.sequence_id", "_place.offset")
