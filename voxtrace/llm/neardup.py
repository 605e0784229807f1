"""Near-duplicate classes of documents by SetSketch registers, with exact confirmation.

A document's shingle set is summarised by registers: the least of many hashes of its elements,
as an exponential variable, on an exponentially spaced scale and cut to one byte. Registers of a
union are the largest of both, and equal registers are the likelier the more two sets share.

1. Documents with the same set form a class; from here on classes are compared.
2. Bands of registers are hashed to buckets. Each bucket has a lead, and each class is paired with
   one lead, the one that it shares most buckets with. Pairs are kept if the likelihood estimate
   from their registers allows the threshold, and confirmed on the full sets. Links give components.
3. In buckets that then hold several components, classes are paired with one lead of another
   component each, ``ROUNDS`` times.
4. In buckets that still do, every class outside the largest component is held against all
   classes of other components, block by block inside tasks, by registers. Pairs that these allow
   are confirmed on the full sets. Where a block has more such pairs than classes in them, those
   classes leave it instead of the pairs: they meet again with their sets, and only links leave
   that task. So every two classes that share a bucket are compared, unless they are linked
   already, and no table of pairs is longer than that of the members of buckets.

A pair at the threshold misses all buckets with a probability of at most ``MISS``.

Defined results: null and empty texts, and those without words, have no shingles and link with
nothing; a text of fewer words than a shingle is one shingle; rows that share an id count as
linked, whatever their texts; a row with a null id links with nothing and is kept, with a null
component; an empty table gives an empty one; other columns are not looked at. A text of any
length counts whole: a task holds its words and its set, and a pair in a task both sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtrace.llm.textblocks import (
    LOWER,
    bounded_batches,
    chunks,
    mixed,
    shingle_sets,
    text_buffers,
    word_hashes,
    word_spans,
)
from voxtrace.operators.ordered import salted_lookup
from voxtrace.session import stage

REGISTERS = 320
#: The scale of the registers: a value is 1 - log_BASE of (minimum / RATE), cut to a byte.
BASE, RATE, TOP = 1.1, 20.0, 255
MISS = 1e-6
#: Standard deviations of the estimate by which it may fall short of the threshold.
SLACK = 5.0
#: Rounds in which each class is paired with one lead of another component.
ROUNDS = 2
#: Members of a bucket that meet in one task: at most about so many from either side.
BLOCK = 512
#: Likely pairs of two blocks, for each class in such a pair, beyond which tasks confirm them inside.
DENSE = 1
#: Rows that a task gathers before it compares registers, and pairs compared at a time.
SCAN_ROWS, SCAN_PAIRS = 1 << 12, 1 << 15
#: Links in one file of a round's table, about.
LINKS_PER_FILE = 200_000
#: Ids (8 bytes each) up to which the documents to confirm are looked up by broadcast.
BROADCAST_ROWS = 2_000_000

_multipliers = np.random.default_rng(97).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0x2545F4914F6CDD1D)


def band_rows(threshold: float) -> int:
    """The most registers in a band such that a pair at the threshold is missed by ``MISS`` at most."""
    fits = [r for r in range(1, REGISTERS + 1) if (1 - threshold**r) ** (REGISTERS // r) <= MISS]
    return max(fits, default=1)


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes (one byte each)."""
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    for lo in range(0, len(elements), 512):
        part = elements[None, lo : lo + 512] * _multipliers[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    share = (least.astype(np.float64) + 1) / 2.0**64
    variable = np.maximum(-np.log1p(-np.minimum(share, 1 - 1e-16)), 1e-300) / RATE
    return np.clip(np.floor(1 - np.log(variable) / np.log(BASE)), 0, TOP).astype(np.uint8)


def jaccard_estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum likelihood of the Jaccard similarity from registers (rows of x, y) and set sizes.

    A register of the first set exceeds the second's with probability p(u - v J), where u and v
    are the shares of both sizes and p(t) = -log_b(1 - t (b - 1) / b).
    """
    more, less = (x > y).sum(1)[:, None], (x < y).sum(1)[:, None]
    u = (n / (n + m))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def exceeds(t: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(t, 0) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = exceeds(u - v * grid), exceeds(v - u * grid)
    tiny = 1e-12
    likelihood = (
        more * np.log(up + tiny)
        + less * np.log(down + tiny)
        + (x.shape[1] - more - less) * np.log(np.maximum(1 - up - down, tiny))
    )
    return grid[np.arange(len(x)), likelihood.argmax(1)]


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = text_buffers(batch.column("text"))
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        own = LOWER[data[part[0] : part[-1]]]
        starts, ends, bounds = word_spans(own, part - part[0])
        for k, elements in enumerate(shingle_sets(word_hashes(own, starts, ends), bounds, width)):
            yield lo + k, elements


def _set_hashes(elements: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums over a set's hashes, which name it."""
    return mixed(elements).sum(dtype=np.uint64), mixed(elements ^ _SECOND).sum(dtype=np.uint64)


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set (set_a, set_b) and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, a, b, found = [], [], [], []
            for _, own in _sets(batch, width):
                sizes.append(len(own))
                one, two = _set_hashes(own)
                a.append(one)
                b.append(two)
                found.append(registers(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(a, np.uint64).view(np.int64)),
                    pa.array(np.array(b, np.uint64).view(np.int64)),
                    pa.array(found, pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "registers"],
            )

    return documents.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, registers binary")


def _buckets(speakers: DataFrame, rows: int) -> DataFrame:
    """(bucket, band, id): one row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = REGISTERS // rows
        weights = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        names = mixed(np.arange(101, 101 + bands, dtype=np.uint64))
        for batch in batches:
            packed = batch.column("registers").to_pylist()
            if not packed:
                continue
            values = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), REGISTERS)
            for lo in range(0, len(packed), 1024):
                part = mixed(values[lo : lo + 1024, : bands * rows].astype(np.uint64) + np.uint64(1))
                key = mixed((part.reshape(-1, bands, rows) * weights).sum(2, dtype=np.uint64) + names)
                ids = np.repeat(batch.column("id").to_numpy()[lo : lo + 1024], bands)
                band = np.tile(np.arange(bands, dtype=np.int32), len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(ids)], ["bucket", "band", "id"]
                )

    return speakers.select("id", "registers").mapInArrow(run, "bucket long, band int, id long")


def connected(links: DataFrame, name: str) -> DataFrame:
    """(id, component) of all ids in ``links`` (a, b): the smallest id that can be reached.

    Each id takes the smallest label among its neighbours' labels, then labels follow labels;
    rounds end when nothing changes. Only a boolean reaches the driver.
    """
    parts = max(1, links.count() // LINKS_PER_FILE)

    def kept(df: DataFrame) -> DataFrame:
        return stage(df.coalesce(parts), name)  # few files, so that small tables are joined by broadcast

    both = kept(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    labels = kept(least.select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        far = both.join(labels.select(F.col("id").alias("b"), "component"), "b")
        least = far.groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = labels.join(least, "id").select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        over = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = kept(
            moved.join(over, "component", "left").select(
                "id", "was", F.least("component", "root").alias("component")
            )
        )
        labels = jumped.select("id", "component")
        if jumped.where("was <> component").isEmpty():
            return labels


def merged(components: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``components`` (id, component) after more ``links`` (a, b) of their ids or of new ones.

    Links become links of components first, so that rounds go over what has changed only.
    """
    for end in ("a", "b"):
        own = components.select(F.col("id").alias(end), "component")
        links = links.join(own, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    roots = connected(stage(links.where("a <> b").distinct(), name), name)
    old = components.join(roots.toDF("component", "root"), "component", "left")
    old = old.select("id", F.coalesce("root", "component").alias("component"))
    return stage(old.unionByName(roots.join(components.select("id"), "id", "left_anti")), name)


def _one_lead(met: DataFrame) -> DataFrame:
    """Pairs (a, b): each ``id`` with the ``lead`` that it meets in most buckets."""
    shared = met.groupBy("id", "lead").agg(F.count("*").alias("n"))
    chosen = shared.groupBy("id").agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("lead"))
    return chosen.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


class _Confirmer:
    """Keeps pairs (a, b) of classes that reach the threshold, by estimate and then on the full sets.

    ``speakers``: id, doc_id, set_a, set_b, n_shingles, registers; one row a class.
    """

    def __init__(self, documents: DataFrame, speakers: DataFrame, width: int, percent: int):
        self.documents, self.speakers = documents, speakers
        self.width, self.percent = width, percent
        lowest = percent / 100
        self.lowest = lowest - SLACK * np.sqrt(lowest * (1 - lowest) / REGISTERS)

    def likely(self, pairs: DataFrame) -> DataFrame:
        own = self.speakers.select("id", "n_shingles", "registers")
        first = own.toDF("a", "n", "x")
        second = own.toDF("b", "m", "y")
        lowest = self.lowest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, len(batch), 2048):
                    part = batch.slice(lo, 2048)
                    x, y = (
                        np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS)
                        for c in ("x", "y")
                    )
                    n, m = (part.column(c).to_numpy().astype(float) for c in ("n", "m"))
                    good = pa.array(jaccard_estimate(x, y, n, m) >= lowest)
                    yield part.select(["a", "b"]).filter(good)

        # sets whose sizes differ too much can't reach the threshold
        sized = pairs.join(first, "a").join(second, "b").where(
            F.lit(100) * F.least("n", "m") >= F.lit(self.percent) * F.greatest("n", "m")
        )
        return sized.mapInArrow(run, "a long, b long")

    def sets(self, needed: DataFrame) -> DataFrame:
        """(id, elements): full sets of the classes in ``needed`` (id), from the text of one document each."""
        width = self.width
        needed = self.speakers.select("id", "doc_id", "set_a", "set_b").join(needed.distinct(), "id")
        needed = stage(needed, "neardup_needed")
        asked = needed.count()
        if asked <= BROADCAST_ROWS:
            needed = F.broadcast(needed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, own = [], []
                a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("set_a", "set_b"))
                for k, elements in _sets(batch, width):
                    # of texts that share an id, those of other classes are left out
                    fits = _set_hashes(elements) == (a[k], b[k])
                    own.append(fits)
                    if fits:
                        found.append(elements.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").filter(pa.array(own, pa.bool_())), pa.array(found, pa.binary())], ["id", "elements"]
                )

        own = self.documents.join(needed, "doc_id").mapInArrow(run, "id long, elements binary")
        found = stage(own, "neardup_sets")
        # rows that repeat an id and its text give a set more than once
        return stage(found.dropDuplicates(["id"]), "neardup_sets") if found.count() > asked else found

    def links(self, pairs: DataFrame) -> DataFrame:
        return self.confirmed(self.likely(pairs))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent
        pairs = stage(pairs, "neardup_likely")
        own = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")))

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(100 * common >= percent * (len(p) + len(q) - common))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        joined = pairs.join(own.toDF("b", "y"), "b").join(own.toDF("a", "x"), "a")
        return joined.mapInArrow(confirm, "a long, b long")

    def links_across(self, now: DataFrame, rows: int) -> DataFrame:
        """Links between components in the buckets of ``now`` (bucket, band, id, component).

        A pair that shares several buckets is compared in the first band they share only.
        """
        parts = now.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        facts = (
            parts.groupBy("bucket")
            .agg(
                F.max_by("component", F.struct("n", "component")).alias("main"),
                F.sum("n").alias("all"),
                F.max("n").alias("in_main"),
            )
            .where("all > in_main")
            .select(
                "bucket",
                "main",
                F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
                F.ceil((F.col("all") - F.col("in_main")) / BLOCK).cast("int").alias("outer"),
            )
        )
        rest = stage(now.join(facts, "bucket"), "neardup_rest")

        def placed(df: DataFrame, mine: str, count: str, other: str, others: str, side: int) -> DataFrame:
            block = F.pmod(F.xxhash64(F.lit(mine), "id"), F.col(count)).cast("int")
            spread = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
            out = df.withColumn(mine, block).withColumn(other, spread)
            return out.select("bucket", "i", "j", F.lit(side).alias("side"), "band", "main", "id", "component")

        met = placed(rest.where("component <> main"), "i", "outer", "j", "blocks", 0).unionByName(
            placed(rest, "j", "blocks", "i", "outer", 1)
        )
        own = self.speakers.select("id", "n_shingles", "registers")
        keys = ["bucket", "i", "j"]
        sorted_rows = met.join(own, "id").repartition(*keys).sortWithinPartitions(*keys, "side")
        scan = partial(_scan_blocks, rows=rows, percent=self.percent, lowest=self.lowest, dense=DENSE)
        kinds = "bucket long, i int, j int, side int, band int, main long, id long, component long"
        found = stage(sorted_rows.mapInArrow(scan, f"a long, b long, {kinds}"), "neardup_across")
        links = self.confirmed(found.where("a is not null").select("a", "b").distinct())
        dense = found.where("a is null").drop("a", "b")
        if dense.isEmpty():
            return links
        return links.unionByName(self._links_inside(dense, rows)).distinct()

    def _links_inside(self, met: DataFrame, rows: int) -> DataFrame:
        """Links of blocks with too many likely pairs, confirmed where the classes in them meet.

        One link of a member to a component is enough for each task.
        """
        percent, lowest = self.percent, self.lowest
        full = self.sets(met.select("id"))
        own = self.speakers.select("id", "registers", "n_shingles").join(full, "id")
        whole = met.join(own, "id")
        left, right = (
            whole.where(F.col("side") == k).select(*[F.col(c).alias(c) for c in whole.columns]) for k in (0, 1)
        )

        def confirm(outside: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(outside) and len(members):
                y = np.frombuffer(b"".join(members["registers"]), np.uint8).reshape(-1, REGISTERS)
                m = members["n_shingles"].to_numpy(float)
                ids, owner = members["id"].to_numpy(), members["component"].to_numpy()
                sets = [np.frombuffer(e, np.uint64) for e in members["elements"]]
                band, main = int(outside["band"].iloc[0]), outside["main"].iloc[0]
                for row in outside.itertuples(index=False):
                    x = np.frombuffer(row.registers, np.uint8)
                    same = y == x
                    n = float(row.n_shingles)
                    good = (owner != row.component) & ((owner == main) | (ids > row.id))
                    good &= 100 * np.minimum(m, n) >= percent * np.maximum(m, n)
                    equal = same.sum(1)
                    good &= equal >= REGISTERS * (lowest - 0.05)
                    at = np.flatnonzero(good)
                    if band and len(at):
                        before = same[at, : band * rows].reshape(len(at), band, rows)
                        at = at[~before.all(2).any(1)]
                    if not len(at):
                        continue
                    at = at[np.argsort(-equal[at], kind="stable")]
                    p, linked = np.frombuffer(row.elements, np.uint64), set()
                    # the likeliest first, since one link to a component is enough; the rest by estimate
                    for part in (at[:8], at[8:]):
                        part = part[~np.isin(owner[part], list(linked))] if linked else part
                        if not len(part):
                            continue
                        value = jaccard_estimate(
                            np.broadcast_to(x, (len(part), REGISTERS)), y[part], np.full(len(part), n), m[part]
                        )
                        for k in part[value >= lowest].tolist():
                            if owner[k] in linked:
                                continue
                            common = len(np.intersect1d(p, sets[k], assume_unique=True))
                            if 100 * common >= percent * (len(p) + len(sets[k]) - common):
                                linked.add(owner[k])
                                found.append((row.id, ids[k]))
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        keys = ("bucket", "i", "j")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(confirm, "a long, b long").distinct()


def _scan_blocks(
    batches: Iterator[pa.RecordBatch], rows: int, percent: int, lowest: float, dense: float
) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, i, j, side) become likely pairs, or the members of a dense block that are in one."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        for lo in range(0, len(batch), SCAN_ROWS):
            held.append(batch.slice(lo, SCAN_ROWS))
            count += len(held[-1])
            if count < SCAN_ROWS:
                continue
            table = pa.Table.from_batches(held)
            group = _group_starts(table)
            if group[-1]:
                yield _likely_in_blocks(table.slice(0, group[-1]), rows, percent, lowest, dense)
                held = table.take(np.arange(group[-1], len(table))).to_batches()
                count = sum(map(len, held))
    if count:
        yield _likely_in_blocks(pa.Table.from_batches(held), rows, percent, lowest, dense)


def _group_starts(table: pa.Table) -> np.ndarray:
    bucket, i, j = (table.column(c).to_numpy() for c in ("bucket", "i", "j"))
    change = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def _likely_in_blocks(table: pa.Table, rows: int, percent: int, lowest: float, dense: float) -> pa.RecordBatch:
    starts = _group_starts(table)
    ends = np.append(starts[1:], len(table))
    ids, owner, main, band, side = (table.column(c).to_numpy() for c in ("id", "component", "main", "band", "side"))
    size = table.column("n_shingles").to_numpy().astype(float)
    values = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(-1, REGISTERS)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    outside = np.flatnonzero(side == 0)
    # members of a group follow those outside its largest component
    first = ends - np.bincount(group[side == 1], minlength=len(starts))
    many = (ends - first)[group[outside]]
    found_p, found_q = [], []
    upto = np.concatenate([[0], np.cumsum(many)])
    lo = 0
    while lo < len(outside):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + SCAN_PAIRS, "right")) - 1)
        p = np.repeat(outside[lo:hi], many[lo:hi])
        q = np.repeat(first[group[outside[lo:hi]]], many[lo:hi]) + np.arange(len(p)) - np.repeat(
            upto[lo:hi] - upto[lo], many[lo:hi]
        )
        good = (owner[p] != owner[q]) & ((owner[q] == main[q]) | (ids[q] > ids[p]))
        good &= 100 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q])
        p, q = p[good], q[good]
        same = values[p] == values[q]
        near = same.sum(1) >= REGISTERS * (lowest - 0.05)
        p, q, same = p[near], q[near], same[near]
        # the band of the bucket is the first that both share
        bands = REGISTERS // rows
        whole = same[:, : bands * rows].reshape(len(p), bands, rows).all(2)
        new = whole.argmax(1) == band[p]
        p, q = p[new], q[new]
        if len(p):
            likely = jaccard_estimate(values[p], values[q], size[p], size[q]) >= lowest
            found_p.append(p[likely])
            found_q.append(q[likely])
        lo = hi
    p = np.concatenate(found_p) if found_p else np.zeros(0, np.int64)
    q = np.concatenate(found_q) if found_q else np.zeros(0, np.int64)
    paired = np.zeros(len(table), bool)
    paired[p] = paired[q] = True
    crowded = np.bincount(group[p], minlength=len(starts)) > dense * np.bincount(group[paired], minlength=len(starts))
    sparse = ~crowded[group[p]]
    p, q = p[sparse], q[sparse]
    members = np.flatnonzero(paired & crowded[group])
    none, missing = np.zeros(len(members), np.int64), np.repeat([False, True], [len(p), len(members)])
    a = pa.array(np.concatenate([np.minimum(ids[p], ids[q]), none]), mask=missing)
    b = pa.array(np.concatenate([np.maximum(ids[p], ids[q]), none]), mask=missing)
    at = np.concatenate([p, members])
    names = ["bucket", "i", "j", "side", "band", "main", "id", "component"]
    columns = [pa.array(table.column(c).to_numpy()[at]) for c in names]
    return pa.RecordBatch.from_arrays([a, b, *columns], ["a", "b", *names])


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``documents`` (doc_id, text).

    ``percent``: link two documents when 100 * |intersection| >= percent * |union|.
    """
    documents = bounded_batches(documents)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = stage(sketches(documents, width), "neardup_sketches")
    key = ["set_a", "set_b", "n_shingles"]
    comparable = drawn.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage(
        comparable.groupBy(*key).agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()),
        "neardup_classes",
    )
    # a set that a third of all documents share is looked up in parts
    of_class = salted_lookup(comparable.drop("registers"), classes, key, ["doc_id"])
    members = stage(of_class.select("doc_id", "n_shingles", "id", *key[:2], "least"), "neardup_members")
    heads = members.where("doc_id = least").select("doc_id", "id", *key).distinct()
    speakers = stage(
        comparable.join(heads, ["doc_id", *key]).dropDuplicates(["id"]), "neardup_speakers"
    )
    rows = band_rows(percent / 100)
    placed = _buckets(speakers, rows)
    shared = placed.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("most")).where("lead < most")
    placed = stage(placed.join(shared.select("bucket", "lead"), "bucket").distinct(), "neardup_buckets")

    confirmer = _Confirmer(documents, speakers, width, percent)
    # classes that share an id hang together from the start
    several = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a < most")
    tied = members.join(several.select("doc_id", "a"), "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
    found = confirmer.links(_one_lead(placed.where("id <> lead").select("id", "lead")))
    links = stage(tied.unionByName(found).distinct(), "neardup_links")
    component = connected(links, "neardup_rounds")
    placed = placed.drop("lead")
    for step in range(ROUNDS + 1):
        now = placed.join(component.select("id", "component"), "id", "left").withColumn(
            "component", F.coalesce("component", "id")
        )
        if step < ROUNDS:
            mixed_buckets = (
                now.groupBy("bucket")
                .agg(
                    F.min("component").alias("low"),
                    F.max("component").alias("high"),
                    F.min_by(F.struct("id", "component"), F.xxhash64(F.lit(step), "id")).alias("head"),
                )
                .where("low < high")
            )
            met = now.join(mixed_buckets, "bucket").where(F.col("component") != F.col("head.component"))
            found = confirmer.links(_one_lead(met.select("id", F.col("head.id").alias("lead"))))
        else:
            found = confirmer.links_across(now, rows)
        found = stage(found, "neardup_links")
        if not found.isEmpty():
            component = merged(component, found, "neardup_rounds")
    # the smallest document of all classes of a component
    linked = component.join(classes.select("id", "least"), "id")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("id", "component_id")
    own = members.join(named, "id", "left_anti").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    rest = drawn.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    result = (
        salted_lookup(members, named, ["id"], ["doc_id"])
        .select("doc_id", "n_shingles", "component_id")
        .unionByName(own)
        .unionByName(rest)
    )
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
