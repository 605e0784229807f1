"""Spelling variants: words one edit apart, found by a scan of sorted lists.

Two words one edit apart agree in the first or in the last half of the shorter one. So every word
is put into two kinds of sorted lists: with all words of its length (and one more) that begin like
it, and, read backwards, with those that end like it. A list is scanned once for all its words:

* Words that share a prefix share the rows of the edit matrix for it. The longest common prefixes
  (LCP) of neighbours in the list say how far; a range of the list is one row for each word asked
  for, cut to the band of one edit: the three cells around the diagonal.
* A range whose row has no cell of at most one edit is skipped, and all that it holds with it.
* Ranges of all words asked for move on together, one code point at a time.

A list of more than ``LIST_WORDS`` words is not scanned in one task. Its words are dealt to finer
lists, one for each place where the edit may be: the words of a list agree before and behind it,
so such a list holds at most as many words as two free letters allow.

Words are lower-cased runs of Latin letters, all of them code points below 256, one byte each.

Defined results: null texts hold no words; a null id counts as an empty id in the hash; rows that
repeat an id or a text count once each; a text of any length is read whole, and so is a run of any
length; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtrace.llm.textblocks import bounded_batches
from voxtrace.session import stage

LETTERS = "[a-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
#: One in so many runs loses a code point.
SLIPS = 31
#: A word is a variant of one that occurs so many times as often.
DOMINANCE = 10
#: Words of a list that one task scans.
LIST_WORDS = 1 << 17
#: Rows that a task gathers before it scans them, and rows of the edit matrix at a time.
BLOCK_ROWS, STATES = 1 << 16, 1 << 19


def words_with_slips(doc_id: Column, text: Column) -> Column:
    """Array of the runs of ``text``, some without one code point, by a hash of id and run."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    own = F.translate(text, upper, upper.lower())
    # a shorter run can't give a word that is long enough
    runs = F.regexp_extract_all(own, F.lit(f"({LETTERS}{{{MIN_LENGTH},}})"), F.lit(1))

    def slipped(run: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
        at = F.pmod(h, F.length(run)).cast("int")
        shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
        return F.when(h % SLIPS == 0, shorter).otherwise(run)

    return F.transform(runs, slipped)


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n: distinct words of all texts that are long and frequent enough."""
    found = documents.select(F.explode(words_with_slips(F.col("doc_id"), F.col("text"))).alias("word"))
    counted = found.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def _listed(words: DataFrame) -> DataFrame:
    """base, side, at (-1), list, spelled, n: the lists by halves that each word belongs to.

    ``base`` is the length of the shorter word of the pairs that a list is for; ``spelled`` is the
    word, or the word read backwards where ``side`` is 1.
    """
    length = F.length("word")
    own = words.select(
        "word",
        "n",
        F.explode(F.array(length, length - 1)).alias("base"),
    ).where(F.col("base") >= MIN_LENGTH)
    both = own.select(
        "n",
        "base",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("word").alias("spelled")),
                F.struct(F.lit(1).alias("side"), F.reverse("word").alias("spelled")),
            )
        ).alias("s"),
    ).select("base", "s.side", F.lit(-1).alias("at"), "s.spelled", "n")
    half = F.substring("spelled", F.lit(1), F.floor(F.col("base") / 2).cast("int"))
    return both.withColumn("list", F.xxhash64("base", "side", half))


def _finer(rows: DataFrame) -> DataFrame:
    """The lists for each place of the edit, for words of lists that are too long."""
    placed = rows.withColumn(
        "at", F.explode(F.sequence(F.floor(F.col("base") / 2).cast("int"), F.col("base")))
    )
    gap = F.when(F.length("spelled") > F.col("base"), 2).otherwise(1)
    before = F.substring("spelled", F.lit(1), F.col("at"))
    behind = F.substring("spelled", F.col("at") + gap + 1, F.length("spelled"))
    return placed.withColumn("list", F.xxhash64("base", "side", "at", before, behind))


def lists(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """All rows to scan, in lists of bounded length."""
    halves = _listed(words)
    sizes = stage(halves.groupBy("list").agg(F.count("*").alias("size")).where(F.col("size") > list_words), "spelling_long")
    if sizes.isEmpty():
        return halves
    marked = halves.join(sizes, "list", "left")
    columns = halves.columns
    short = marked.where("size is null").select(*columns)
    return short.unionByName(_finer(marked.where("size is not null").select(*columns)))


def common_prefix(flat: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int = 1) -> np.ndarray:
    """Length of the common prefix of the words at ``a`` and ``b``, up to ``limit`` each.

    ``step`` -1 reads both backwards.
    """
    out = np.zeros(len(a), np.int64)
    going = np.flatnonzero(limit > 0)
    k = 0
    while len(going):
        going = going[flat[a[going] + step * k] == flat[b[going] + step * k]]
        k += 1
        out[going] = k
        going = going[limit[going] > k]
    return out


def _children(lo, hi, depth, start, length, lcp, flat):
    """Ranges of one more common code point: (offsets by range, lo, hi, code point).

    The word that ends at ``depth`` is the first of its range and in none of them.
    """
    first = lo + (length[lo] == depth)
    size = hi - first
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    owner = np.repeat(np.arange(len(lo)), size)
    heads = np.flatnonzero((at == first[owner]) | (lcp[at] <= depth[owner]))
    own, begin = owner[heads], at[heads]
    end = np.append(begin[1:], 0)
    last = np.append(own[1:] != own[:-1], True)[: len(own)]
    end = np.where(last, hi[own], end) if len(own) else begin
    return np.searchsorted(own, np.arange(len(lo) + 1)), begin, end, flat[start[begin] + depth[own]], depth[own] + 1


def scan(flat: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked, found) of words of one list that are one edit apart.

    Words are ``flat[start : start + length]``, distinct and sorted within each list, of which
    ``group`` holds the ascending number of each word's list.
    """
    n = len(start)
    pad = np.concatenate([flat, np.zeros(2, np.uint8)])
    lcp = np.zeros(n, np.int64)
    if n > 1:
        limit = np.where(group[1:] == group[:-1], np.minimum(length[1:], length[:-1]), 0)
        lcp[1:] = common_prefix(pad, start[1:], start[:-1], limit)
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:n])
    tails = np.append(heads[1:], n)[: len(heads)]
    several = tails - heads > 1
    heads, tails = heads[several], tails[several]
    if not len(heads):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # what all words of a list share is an exact row for every one of them
    inner = lcp.copy()
    inner[heads] = np.iinfo(np.int64).max
    edges = np.append(np.column_stack([heads, tails]).ravel(), n)
    inner = np.append(inner, 0)
    shared = np.minimum.reduceat(inner, np.minimum(edges[:-1], n))[::2]
    levels = []
    lo, hi, depth = heads, tails, shared
    while len(lo):
        bounds, begin, end, letter, deeper = _children(lo, hi, depth, start, length, lcp, pad)
        levels.append((lo, depth, bounds, letter))
        lo, hi, depth = begin, end, deeper
    asked_all = np.repeat(np.arange(len(heads)), tails - heads)
    words = np.repeat(heads, tails - heads) + np.arange(len(asked_all)) - np.repeat(
        np.cumsum(tails - heads) - (tails - heads), tails - heads
    )
    found_a, found_b = [], []
    step = max(1, STATES // 64)
    for first in range(0, len(words), step):
        asked, node = words[first : first + step], asked_all[first : first + step]
        row = np.tile(np.array([1, 0, 1], np.int8), (len(asked), 1))
        at = shared[node]
        row[at == 0, 0] = 2
        row[at + 1 > length[asked], 2] = 2
        for k, (lo, depth, bounds, letter) in enumerate(levels):
            if not len(asked):
                break
            # a word ends here: its distance stands in the cell of the asked word's length
            d, word = depth[node], lo[node]
            cell = length[asked] - d + 1
            ends = (length[word] == d) & (cell >= 0) & (cell <= 2)
            hit = np.flatnonzero(ends)
            hit = hit[row[hit, cell[hit]] == 1]
            found_a.append(asked[hit])
            found_b.append(word[hit])
            if k + 1 == len(levels):
                break
            count = bounds[node + 1] - bounds[node]
            parent = np.repeat(np.arange(len(node)), count)
            child = np.repeat(bounds[node], count) + np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
            asked, old, d, c = asked[parent], row[parent], d[parent], letter[child]
            size, begin = length[asked], start[asked]
            same = [
                (c == pad[np.minimum(begin + np.maximum(d + shift, 0), len(pad) - 1)]) & (d + shift >= 0) & (d + shift < size)
                for shift in (-1, 0, 1)
            ]
            left = np.minimum(old[:, 0] + 1 - same[0], old[:, 1] + 1)
            middle = np.minimum(np.minimum(old[:, 1] + 1 - same[1], old[:, 2] + 1), left + 1)
            right = np.minimum(old[:, 2] + 1 - same[2], middle + 1)
            left = np.where(d > size, 2, np.minimum(left, 2))
            middle = np.where(d + 1 > size, 2, np.minimum(middle, 2))
            right = np.where(d + 2 > size, 2, np.minimum(right, 2))
            alive = np.flatnonzero((left < 2) | (middle < 2) | (right < 2))
            row = np.column_stack([left[alive], middle[alive], right[alive]]).astype(np.int8)
            asked, node = asked[alive], child[alive]
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _near_of(table: pa.Table) -> pa.RecordBatch:
    """For each word of the lists in ``table``: near words, the largest n and the first such word."""
    base, side, at, keys, n = (
        table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("base", "side", "at", "list", "n")
    )
    spelled = [w.encode("latin-1") for w in table.column("spelled").to_pylist()]
    length = np.array([len(w) for w in spelled], np.int64)
    start = np.concatenate([[0], np.cumsum(length)])[:-1].astype(np.int64)
    flat = np.frombuffer(b"".join(spelled), np.uint8)
    change = (keys[1:] != keys[:-1]) | (base[1:] != base[:-1]) | (side[1:] != side[:-1]) | (at[1:] != at[:-1])
    asked, found = scan(flat, start, length, np.concatenate([[0], np.cumsum(change)]))
    # each pair counts in one list only: by the first half if it lies before the edit, at the edit's place
    least = np.minimum(length[asked], length[found])
    ahead = common_prefix(flat, start[asked], start[found], least)
    back = common_prefix(flat, start[asked] + length[asked] - 1, start[found] + length[found] - 1, least, -1)
    reverse = side[asked] == 1
    half = base[asked] // 2
    good = (least == base[asked]) & (ahead >= half) & ~(reverse & (back >= half))
    good &= (at[asked] < 0) | (ahead == at[asked])
    asked, found = asked[good], found[good]
    words = np.array([w[::-1] if s else w for w, s in zip(spelled, side.tolist(), strict=True)], object)
    order = np.lexsort((-n[found], asked))
    asked, found = asked[order], found[order]
    heads = np.flatnonzero(np.append(True, asked[1:] != asked[:-1])[: len(asked)])
    tails = np.append(heads[1:], len(asked))[: len(heads)]
    best_n, best = n[found[heads]], []
    for lo, hi, top in zip(heads.tolist(), tails.tolist(), best_n.tolist(), strict=True):
        near = found[lo:hi]
        best.append(min(words[near[n[near] == top]]).decode("latin-1"))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([w.decode("latin-1") for w in words[asked[heads]]], pa.string()),
            pa.array((tails - heads).astype(np.int64)),
            pa.array(best_n.astype(np.int64)),
            pa.array(best, pa.string()),
        ],
        ["word", "n_near", "best_n", "best"],
    )


def _scan_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists arrive one after the other; whole ones are scanned in blocks."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < BLOCK_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column("list").combine_chunks().to_numpy()
        cut = int(np.flatnonzero(keys == keys[-1])[0])
        if cut:
            yield _near_of(table.slice(0, cut))
            # a copy, so that the rows before it are let go
            held = table.take(np.arange(cut, len(table))).to_batches()
        rows = len(table) - cut
    if rows:
        yield _near_of(pa.Table.from_batches(held).combine_chunks())


def near_words(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """word, n_near, best_n, best: near words of each word that has any, and the most frequent one.

    ``words``: word, n; distinct words of code points below 256.
    """
    rows = bounded_batches(lists(words, list_words))
    sorted_lists = rows.repartition("list").sortWithinPartitions("list", "base", "side", "at", "spelled")
    near = sorted_lists.mapInArrow(_scan_lists, "word string, n_near long, best_n long, best string")
    return (
        near.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
        .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root for (word, form): the last word that is reached by following forms.

    Counts grow along forms, so there is no cycle; each round doubles the steps taken.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        over = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(now.join(over, "root", "left").select("word", "root", "further"), "spelling_roots")
        now = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.where("further is not null").isEmpty():
            return now


def spelling_variants(documents: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words in ``documents`` (doc_id, text)."""
    words = stage(vocabulary(documents.select("doc_id", "text")), "spelling_words")
    near = near_words(words, list_words)
    is_form = F.col("best_n") >= DOMINANCE * F.col("n")
    found = stage(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "spelling_forms",
    )
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
