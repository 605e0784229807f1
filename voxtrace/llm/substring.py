"""Exact substring deduplication over word windows, with difference-cover anchors.

A window of ``width`` words is removed from a document if the same words also start somewhere in
a document with a smaller id. Anchors are shorter runs of words at positions that lie, modulo a
period, in a difference cover: whatever the positions of two equal windows, some anchor lies at
the same place inside both. So windows need not be hashed at every word to be found.

1. Each anchor carries a hash of its words, and one of its surroundings: all words that a window
   holding it can reach. Only anchors in two or more documents matter.
2. If an anchor has the same surroundings everywhere, all windows that hold it are repeats in
   all documents but the smallest: no window has to be compared.
3. Where surroundings differ (at the edges of a common passage), the match is extended word by
   word: the documents emit the windows that hold the anchor, with 128-bit hashes, and the
   smallest document of each is found.

Anchors that hold more than ``HOT`` of all anchors of a sample of documents are counted map-side
and looked up by broadcast (at most 1 / HOT of them), so no task gathers a common passage.

Defined results: a null text has no words; a document of fewer than ``width`` words loses
nothing; rows with a null id lose nothing and are no source; rows with the same id never repeat
each other, and lose what any of them repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtrace.llm.textblocks import (
    SECOND_BASE,
    bounded_batches,
    chunks,
    mixed,
    span_hashes,
    text_buffers,
    word_hashes,
    word_spans,
)
from voxtrace.session import stage

WIDTH = 50
# fixed values: perfect difference sets (every difference modulo the period occurs)
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
}
#: Names that the result adds or uses on the way: input columns may not have them.
REPEAT_COLUMNS = ("kept_text", "n_words", "n_removed", "_copies", "_windows", "_repeat_id")
HOT = 1 / 65536
#: One document in so many tells which anchors are hot.
SAMPLED = 16

_OTHER = np.uint64(0x5851F42D4C957F2D)


def period_for(width: int) -> int:
    """The longest period that leaves anchors of a third of the window."""
    return max(p for p in COVERS if p == 1 or 3 * p <= 2 * width)


class _Words:
    """Words of a chunk of documents: hashes, and the first and last place of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        self.starts, self.ends, self.bounds = word_spans(data, offsets)
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.lo = np.repeat(self.bounds[:-1], self.counts)
        self.hi = np.repeat(self.bounds[1:], self.counts)
        period = period_for(width)
        self.reach, size = period - 1, width - period + 1
        inside = np.zeros(period, bool)
        inside[list(COVERS[period])] = True
        at = np.arange(len(self.hashes))
        self.anchors = np.flatnonzero(
            inside[(at - self.lo) % period] & (at + size <= self.hi) & (self.hi - self.lo >= width)
        )
        self.keys = span_hashes(self.hashes, self.anchors, self.anchors + size)
        self.size, self.width = size, width

    def surroundings(self) -> np.ndarray:
        at = self.anchors
        left = np.minimum(at - self.lo[at], self.reach)
        right = np.minimum(self.hi[at] - at - self.size, self.reach)
        around = span_hashes(self.hashes, at - left, at + self.size + right)
        return mixed(around + (left * (self.reach + 1) + right).astype(np.uint64))

    def window_range(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window (by its first word) that holds each anchor."""
        return np.maximum(self.lo[at], at - self.reach), np.minimum(at, self.hi[at] - self.width)

    def windows(self, at: np.ndarray) -> np.ndarray:
        """Sorted windows that hold an anchor of ``at``."""
        first, last = self.window_range(at)
        steps = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(steps, first, 1)
        np.add.at(steps, last + 1, -1)
        return np.flatnonzero(np.cumsum(steps[:-1]) > 0)


def _chunked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, _Words]]:
    data, offsets = text_buffers(batch.column("text"))
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        own = data[part[0] : part[-1]]
        yield lo, hi, own, part - part[0], _Words(own, part - part[0], width)


def _members(column: pa.Array, lo: int, words: _Words, keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each key is in the list of its document (lists: one per row of the batch)."""
    lists = column.slice(lo, len(words.counts)).fill_null([])
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    have = np.unique(mixed(values + owner.astype(np.uint64) * _OTHER))
    ask = mixed(keys + doc.astype(np.uint64) * _OTHER)
    if not len(have):
        return np.zeros(len(ask), bool)
    at = np.minimum(np.searchsorted(have, ask), len(have) - 1)
    return have[at] == ask


def repeated_parts(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, _copies, _windows: hashes of anchors whose windows are all repeats, and of single
    windows that are; one row for each document that has any. ``documents``: doc_id, text."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, _, _, _, words in _chunked(batch, width):
                doc = words.doc[words.anchors]
                around = words.surroundings()
                order = np.lexsort((around, words.keys, doc))
                doc, keys, around = doc[order], words.keys[order], around[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1]) | (around[1:] != around[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[new].view(np.int64)),
                        pa.array(around[new].view(np.int64)),
                        ids.take(pa.array(lo + doc[new])),
                    ],
                    ["anchor", "around", "doc_id"],
                )

    schema = "anchor long, around long, doc_id long"
    sampled = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).mapInArrow(anchors, schema)
    counted = stage(
        sampled.groupBy("anchor").agg(F.count("*").alias("rows")).where("rows > 1"), "substring_sample"
    )
    total = counted.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(counted.where(F.col("rows") > max(100, total * HOT)).select("anchor", F.lit(True).alias("hot")))
    raw = documents.mapInArrow(anchors, schema).join(hot, "anchor", "left")

    facts = {"least": F.min("doc_id"), "most": F.max("doc_id"), "one": F.min("around"), "other": F.max("around")}
    hot_rows = raw.where("hot").drop("hot")
    hot_facts = hot_rows.groupBy("anchor").agg(*[f.alias(name) for name, f in facts.items()])
    same = Window.partitionBy("anchor")
    cold = raw.where("hot is null").drop("hot")
    judged = cold.select("*", *[f.over(same).alias(name) for name, f in facts.items()])
    judged = judged.unionByName(hot_rows.join(F.broadcast(hot_facts), "anchor"))
    judged = judged.where("least < most").where("one <> other or doc_id > least")
    labels = judged.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("one") == F.col("other"), F.col("anchor"))).alias("_copies"),
        F.collect_set(F.when(F.col("one") != F.col("other"), F.col("anchor"))).alias("_edges"),
    )
    labels = stage(labels, "substring_labels")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, _, _, _, words in _chunked(batch, width):
                edge = _members(batch.column("_edges"), lo, words, words.keys, words.doc[words.anchors])
                at = words.windows(words.anchors[edge])
                first = span_hashes(words.hashes, at, at + width)
                second = span_hashes(mixed(words.hashes ^ _OTHER), at, at + width, SECOND_BASE)
                doc = words.doc[at]
                order = np.lexsort((second, first, doc))
                doc, first, second = doc[order], first[order], second[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first[new].view(np.int64)),
                        pa.array(second[new].view(np.int64)),
                        ids.take(pa.array(lo + doc[new])),
                    ],
                    ["window", "window2", "doc_id"],
                )

    edges = labels.where(F.size("_edges") > 0).select("doc_id", "_edges")
    emitted = documents.join(edges, "doc_id").mapInArrow(windows, "window long, window2 long, doc_id long")
    emitted = stage(emitted, "substring_windows")
    least = (
        emitted.groupBy("window", "window2")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("least < most")
        .drop("most")
    )
    repeats = (
        emitted.join(least, ["window", "window2"])
        .where("doc_id > least")
        .groupBy("doc_id")
        .agg(F.collect_set("window").alias("_windows"))
    )
    copies = labels.where(F.size("_copies") > 0).select("doc_id", "_copies")
    return stage(copies.join(repeats, "doc_id", "full_outer"), "substring_repeats")


def remove_repeats(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns of ``documents`` (doc_id, text and others), with kept_text, n_words, n_removed.

    kept_text: the remaining words joined by one space.
    """
    documents = bounded_batches(documents)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    parts = repeated_parts(own, width).withColumnRenamed("doc_id", "_repeat_id")

    def reduce_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[bytes] = []
            counts, gone = [], []
            for lo, _, data, offsets, words in _chunked(batch, width):
                removed = np.zeros(len(words.hashes) + 1, np.int64)
                copy = _members(batch.column("_copies"), lo, words, words.keys, words.doc[words.anchors])
                first, last = words.window_range(words.anchors[copy])
                np.add.at(removed, first, 1)
                np.add.at(removed, last + width, -1)
                lists = batch.column("_windows").slice(lo, len(words.counts))
                some = lists.is_valid().to_numpy(zero_copy_only=False)
                at = np.flatnonzero(some[words.doc] & (np.arange(len(words.hashes)) + width <= words.hi))
                keys = span_hashes(words.hashes, at, at + width)
                at = at[_members(batch.column("_windows"), lo, words, keys, words.doc[at])]
                np.add.at(removed, at, 1)
                np.add.at(removed, at + width, -1)
                stays = np.cumsum(removed[:-1]) == 0
                left = np.add.reduceat(np.append(stays, False), words.bounds[:-1]) * (words.counts > 0) if len(words.counts) else []
                raw = data.tobytes()
                for d in range(len(words.counts)):
                    a, b = words.bounds[d], words.bounds[d + 1]
                    keep = np.flatnonzero(stays[a:b]) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)]))
                counts += words.counts.tolist()
                gone += (words.counts - np.asarray(left)).tolist()
            rest = [batch.column(c) for c in range(batch.num_columns) if batch.schema.names[c] not in ("_copies", "_windows")]
            names = [n for n in batch.schema.names if n not in ("_copies", "_windows")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
                [*names, "kept_text", "n_words", "n_removed"],
            )

    joined = documents.join(parts, documents["doc_id"].cast("long") == parts["_repeat_id"], "left").drop("_repeat_id")
    fields = [f for f in joined.schema.fields if f.name not in ("_copies", "_windows")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return joined.mapInArrow(reduce_texts, f"{schema}, kept_text string, n_words long, n_removed long")


def kept_digest(reduced: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return reduced.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
