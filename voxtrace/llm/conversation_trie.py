"""A trie of conversation prefixes, from balanced parentheses in sorted shards.

A conversation is a path of turns (16-byte digests of role and text). Equal paths are counted
once; distinct ones are range-partitioned and sorted, so that a very common first turn is spread
over tasks like any other. A task cuts its sorted paths into shards of about ``SHARD_TURNS`` turns
and writes each shard's trie as balanced parentheses: "(" for a new node, ")" when it is left.

* The excess ("(" minus ")") is kept in blocks with their least values in a tree of minima; the
  end of a subtree (findclose) is the first place at which the excess falls below the node's.
* The number of "(" before it is the preorder number; leaves of a subtree are its pairs "()";
  savings of a subtree are a difference of one cumulative array over preorder numbers.
* Nodes on a shard's first and last path, its spines, may go on in other shards. Their parts are
  added up by node, and what spines save below themselves is added along the spines.

Paths of more than ``BAND`` turns are cut into bands. The trie of a band hangs on the nodes where
the band above ends; bands are worked from the deepest upwards, one round each, so a task holds
at most ``BAND`` turns of a path. A list of member ids is joined in pieces by range, then hashed
piece by piece.

Defined results: rows without a conversation id belong to none and are left out; a null role or
text is empty; turns of equal number follow each other by role, then by MD5 of role and text;
repeated rows are turns of their own; a conversation whose rebuilt form has no turn is a member
of the root only; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtrace.llm.textblocks import bounded_batches
from voxtrace.operators.ordered import row_numbers, salted_lookup
from voxtrace.session import stage

#: Conversations of a family, whose first one lends its turns, and the most turns lent, less one.
FAMILY, LENT = 5, 9
BAND = 1 << 14
SHARD_TURNS = 1 << 17
#: Turns that order the ranges; paths alike so far stay in one task, shard after shard.
RANGE_TURNS = 64
#: Bits in a block of excess values.
BLOCK = 256
#: Ids joined to one piece.
PIECE_IDS = 1 << 14

ROOT = "0" * 32
NO_ANCHOR = -(2**63)
EMPTY = hashlib.sha256(b"").hexdigest()


class BalancedParentheses:
    """Bits of a forest in depth-first order (1 opens, 0 closes), with a tree of least excesses."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        self.opens = np.flatnonzero(bits)
        blocks = -(-len(bits) // BLOCK) or 1
        top = np.iinfo(np.int64).max
        padded = np.full(blocks * BLOCK, top)
        padded[: len(bits)] = self.excess
        least = [padded.reshape(blocks, BLOCK).min(axis=1)]
        while len(least[-1]) > 1:
            low = least[-1]
            low = np.append(low, top) if len(low) % 2 else low
            least.append(low.reshape(-1, 2).min(axis=1))
        self.levels = np.concatenate([[0], np.cumsum([len(x) for x in least])])
        self.least = np.concatenate(least)
        self.sizes = np.array([len(x) for x in least])

    def _scan(self, at: np.ndarray, target: np.ndarray, out: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Look from ``at`` to the end of its block; returns those not found there."""
        place, goal, left = at.copy(), target, np.arange(len(at))
        missed = []
        while len(left):
            inside = (place < len(self.bits)) & ((place == at[left]) | (place % BLOCK > 0))
            missed.append(left[~inside])
            left, place, goal = left[inside], place[inside], goal[inside]
            hit = self.excess[place] == goal
            out[which[left[hit]]] = place[hit]
            left, place, goal = left[~hit], place[~hit] + 1, goal[~hit]
        return np.concatenate(missed) if missed else left

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Places of the closing parentheses of those opened at ``at``."""
        out = np.full(len(at), -1, np.int64)
        target = self.excess[at] - 1
        which = np.arange(len(at))
        # a block that ends here has nothing more to scan
        edge = (at + 1) % BLOCK == 0
        rest = np.flatnonzero(~edge)
        missed = rest[self._scan(at[rest] + 1, target[rest], out, which[rest])]
        missed = np.sort(np.concatenate([missed, np.flatnonzero(edge)]))
        node, level, goal = at[missed] // BLOCK + 1, np.zeros(len(missed), np.int64), target[missed]
        climbing = np.arange(len(missed))
        while len(climbing):
            value = self.least[self.levels[level[climbing]] + node[climbing]]
            climbing = climbing[value > goal[climbing]]
            node[climbing] += 1
            up = climbing[node[climbing] % 2 == 0]
            node[up] //= 2
            level[up] += 1
        sinking = np.flatnonzero(level > 0)
        while len(sinking):
            level[sinking] -= 1
            node[sinking] *= 2
            value = self.least[self.levels[level[sinking]] + node[sinking]]
            node[sinking] += value > goal[sinking]
            sinking = sinking[level[sinking] > 0]
        self._scan(node * BLOCK, goal, out, missed)
        return out


def _range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for each range (not empty), by a table of powers of two."""
    table = [values]
    width = 1
    while 2 * width <= len(values):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    power = np.floor(np.log2(np.maximum(hi - lo, 1))).astype(np.int64)
    power -= (1 << power) > hi - lo
    out = np.empty(len(lo), values.dtype)
    for k in np.unique(power):
        own = power == k
        out[own] = np.minimum(table[k][lo[own]], table[k][hi[own] - (1 << int(k))])
    return out


SHARD_SCHEMA = (
    "spine boolean, level int, conv_id long, parent_conv_id long, parent_key binary, node_key binary, path_id long, "
    "n_convs long, n_children long, n_leaves long, saved long, ends string, last_bytes long, "
    "below_leaves long, below_saved long"
)
_ARROW = pa.schema(
    [
        ("spine", pa.bool_()),
        ("level", pa.int32()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("parent_key", pa.binary()),
        ("node_key", pa.binary()),
        ("path_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved", pa.int64()),
        ("ends", pa.string()),
        ("last_bytes", pa.int64()),
        ("below_leaves", pa.int64()),
        ("below_saved", pa.int64()),
    ]
)


def _node_keys(path: np.ndarray) -> list[bytes]:
    """Keys of the nodes of a path: the first turn itself, then digests of digests."""
    keys = [path[0].tobytes()]
    for turn in path[1:]:
        keys.append(hashlib.md5(keys[-1] + turn.tobytes()).digest())
    return keys


def _shard(table: pa.Table) -> pa.RecordBatch:
    """Nodes of one shard: whole ones, and the parts of those on its first and last path."""
    rows = len(table)
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    lists = column["keys"]
    offsets = lists.offsets.to_numpy().astype(np.int64)
    raw = b"".join(lists.flatten().to_pylist())
    turns = np.frombuffer(raw, np.uint8).reshape(-1, 16)
    pairs = turns.view(np.uint64)
    offsets = offsets - offsets[0]
    sizes = column["sizes"].flatten().to_numpy()
    length = np.diff(offsets)
    n, conv, anchor = (column[c].to_numpy(zero_copy_only=False) for c in ("n", "conv_id", "anchor_conv"))
    # the common prefix with the path before
    lcp = np.zeros(rows, np.int64)
    going, k = np.arange(1, rows), 0
    while len(going):
        going = going[(length[going] > k) & (length[going - 1] > k)]
        same = (pairs[offsets[going] + k] == pairs[offsets[going - 1] + k]).all(axis=1)
        going = going[same]
        k += 1
        lcp[going] = k
    opened = length - lcp
    closed = np.append(0, length[:-1] - lcp[1:])
    counts = np.append(np.column_stack([closed, opened]).ravel(), length[-1])
    tree = BalancedParentheses(np.repeat(np.append(np.tile([0, 1], rows), 0).astype(bool), counts))
    at = tree.opens
    close = tree.find_close(at)
    total = len(at)
    own = np.arange(total)
    after = own + (close - at + 1) // 2
    level = tree.excess[at] - 1
    leaf = ~tree.bits[at + 1]
    row = np.repeat(np.arange(rows), opened)
    row_after = np.append(row, rows)[after]
    so_far = np.concatenate([[0], np.cumsum(n)])
    n_convs = so_far[row_after] - so_far[row]
    first = _range_least(conv, row, row_after)
    named = anchor[row] != NO_ANCHOR
    first = np.where((level == 0) & named, anchor[row], first)
    last_bytes = sizes[offsets[row] + level]
    # the latest node of the level above is the parent
    ranked = np.sort(level * total + own)
    above = np.searchsorted(ranked, (level - 1) * total + own) - 1
    parent = np.where(level > 0, ranked[above] % total, -1)
    end = np.cumsum(opened) - 1
    below = {c: np.zeros(total, np.int64) for c in ("below_leaves", "below_saved", "below_children")}
    for c, values in below.items():
        values[end] = column[c].to_numpy(zero_copy_only=False)
    ends = np.full(total, EMPTY, object)
    ends[end] = column["ends"].to_pylist()

    first_path = np.arange(length[0])
    deepest = np.arange(length[-1])
    last_path = ranked[np.searchsorted(ranked, (deepest + 1) * total) - 1] % total
    spine = np.zeros(total, bool)
    spine[first_path] = True
    spine[last_path] = True
    children = np.bincount(parent[(parent >= 0) & ~spine], minlength=total) + below["below_children"]
    leaves = np.where(leaf & ~spine, np.where(below["below_leaves"] > 0, below["below_leaves"], 1), 0)
    saves = np.where(spine, 0, (n_convs - 1) * last_bytes + below["below_saved"])
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (leaves, saves)]
    n_leaves, saved = (s[after] - s[own] for s in sums)

    paths = [(0, first_path)]
    if rows > 1:
        paths.append((rows - 1, last_path))
    keys_of: dict[int, bytes] = {}
    spine_rows = []
    for r, nodes in paths:
        keys = _node_keys(turns[offsets[r] : offsets[r + 1]])
        for node, key in zip(nodes.tolist(), keys, strict=True):
            spine_rows.append((node, key, int(conv[r]), node not in keys_of))
            keys_of[node] = key
    whole = np.flatnonzero(~spine)
    marked = np.array([s[0] for s in spine_rows], np.int64)
    counted = np.array([s[3] for s in spine_rows], np.int64)
    node = np.concatenate([whole, marked])
    share = np.concatenate([np.ones(len(whole), np.int64), counted])
    on_spine = np.concatenate([np.zeros(len(whole), bool), np.ones(len(marked), bool)])
    up = parent[node]
    known = (up >= 0) & ~spine[up]
    level_zero = level[whole] == 0
    node_keys = [turns[offsets[row[w]]].tobytes() if z else None for w, z in zip(whole.tolist(), level_zero.tolist(), strict=True)]
    columns = [
        on_spine,
        level[node].astype(np.int32),
        first[node],
        pa.array(first[up], mask=~known),
        pa.array([keys_of.get(u) for u in up.tolist()], pa.binary()),
        pa.array(node_keys + [s[1] for s in spine_rows], pa.binary()),
        pa.array([None] * len(whole) + [s[2] for s in spine_rows], pa.int64()),
        n_convs[node] * share,
        children[node] * share,
        n_leaves[node] * share,
        saved[node] * share,
        pa.array(ends[node], pa.string()),
        last_bytes[node],
        below["below_leaves"][node] * share,
        below["below_saved"][node] * share,
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ARROW)


def _shards(batches: Iterator[pa.RecordBatch], shard_turns: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    turns = 0
    for batch in batches:
        lo = 0
        upto = batch.column("keys").offsets.to_numpy().astype(np.int64)
        while lo < len(batch):
            hi = int(np.searchsorted(upto, upto[lo] + shard_turns - turns, "left"))
            hi = min(max(hi, lo + 1), len(batch))
            held.append(batch.slice(lo, hi - lo))
            turns += int(upto[hi] - upto[lo])
            lo = hi
            if turns >= shard_turns:
                yield _shard(pa.Table.from_batches(held))
                held, turns = [], 0
    if held:
        yield _shard(pa.Table.from_batches(held))


def lent_turns(conv_id: Column) -> Column:
    """Turns that a conversation takes over from the first of its family."""
    return F.crc32(conv_id.cast("string")) % LENT


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, key, bytes: turns of the rebuilt conversations, and one row of depth 0 each."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().cast("int").alias("numbered"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"),
        role.alias("role"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = row_numbers(turns, ["conv_id"], ["numbered", "turn", "role", "key", "row"], "place")
    placed = stage(placed.select("conv_id", "place", "key", "bytes"), "trie_turns")
    ids = placed.where("place = 1").select("conv_id")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = placed.where((family == F.col("conv_id")) & (F.col("place") < LENT))
    lent = (
        heads.withColumn("family", F.col("conv_id"))
        .withColumn("conv_id", F.explode(F.sequence(F.col("family") - (FAMILY - 1), F.col("family") + (FAMILY - 1))))
        .where((F.col("conv_id") != F.col("family")) & (family == F.col("family")))
        .where(F.col("place") <= lent_turns(F.col("conv_id")))
        .join(ids, "conv_id", "left_semi")
        .select("conv_id", F.col("place").alias("depth"), "key", "bytes")
    )
    given = heads.groupBy(F.col("conv_id").alias("family")).agg(F.max("place").alias("given"))
    rest = placed.where((family != F.col("conv_id")) & (F.col("place") > lent_turns(F.col("conv_id"))))
    rest = salted_lookup(rest.withColumn("family", family), given, ["family"], ["conv_id", "place"], "left")
    h = lent_turns(F.col("conv_id"))
    rest = rest.select(
        "conv_id",
        (F.col("place") - h + F.least(h, F.coalesce("given", F.lit(0).cast("long")))).alias("depth"),
        "key",
        "bytes",
    )
    firsts = placed.where(family == F.col("conv_id")).select("conv_id", F.col("place").alias("depth"), "key", "bytes")
    start = ids.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("bytes")
    )
    return start.unionByName(firsts).unionByName(lent).unionByName(rest)


def _paths(turns: DataFrame, band: int) -> DataFrame:
    """A row for each band of each conversation: its turns, its digest and that of the band above."""
    pieces = (
        turns.withColumn("band", F.greatest(F.floor((F.col("depth") - 1) / band), F.lit(0)).cast("int"))
        .groupBy("conv_id", "band")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "key", "bytes"))).alias("t"))
        .select("conv_id", "band", F.col("t.key").alias("keys"), F.col("t.bytes").alias("sizes"))
        .withColumn("own", F.md5(F.array_join("keys", "")))
    )
    pieces = stage(pieces, "trie_pieces")
    # the digest of a band holds those of all bands above
    chain = (
        pieces.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("band", "own"))).alias("c"))
        .select(
            "conv_id",
            F.aggregate(
                "c",
                F.array(F.lit(ROOT)),
                lambda found, x: F.concat(found, F.array(F.md5(F.concat(F.element_at(found, -1), x["own"])))),
            ).alias("p"),
        )
    )
    digests = chain.select("conv_id", F.posexplode(F.slice("p", F.lit(2), F.size("p") - 1)).alias("band", "path"), "p").select(
        "conv_id",
        "band",
        "path",
        F.element_at("p", F.col("band") + 1).alias("anchor"),
        (F.col("band") == F.size("p") - 2).alias("final"),
    )
    return stage(pieces.drop("own").join(digests, ["conv_id", "band"]), "trie_paths")


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (path, conv_id) become pieces of joined ids."""
    names = ["path", "first", "n", "ids"]

    def flush(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d[0] for d in done], pa.string()),
                pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()),
                pa.array([",".join(d[3]) for d in done], pa.string()),
            ],
            names,
        )

    done: list = []
    held = 0
    for batch in batches:
        for path, conv, final in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "final")), strict=True):
            if not done or done[-1][0] != path or done[-1][2] >= PIECE_IDS:
                if held >= 1 << 16:
                    yield flush(done)
                    done, held = [], 0
                done.append([path, conv, 0, []])
            done[-1][2] += 1
            held += 1
            if final:
                done[-1][3].append(str(conv))
    if done:
        yield flush(done)


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (path, first) become one row a path with the digest of all its ids."""
    path, least, n, any_id, digest = None, 0, 0, False, hashlib.sha256()
    out: list = []
    for batch in batches:
        for p, first, count, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "n", "ids")), strict=True):
            if p != path:
                if path is not None:
                    out.append((path, least, n, digest.hexdigest()))
                path, least, n, any_id, digest = p, first, 0, False, hashlib.sha256()
            n += count
            if ids:
                digest.update(("," + ids if any_id else ids).encode())
                any_id = True
        if len(out) >= 1 << 14:
            yield _digest_rows(out)
            out = []
    if path is not None:
        out.append((path, least, n, digest.hexdigest()))
    if out:
        yield _digest_rows(out)


def _digest_rows(out: list) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["path", "conv_id", "n", "ends"]
    )


def _distinct(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, conv_id, n, ends) of each distinct path, and its turns beside them."""
    ids = paths.select("path", "conv_id", "final")
    pieces = (
        ids.repartitionByRange("path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .mapInArrow(_id_pieces, "path string, first long, n long, ids string")
    )
    digests = stage(
        pieces.repartition("path")
        .sortWithinPartitions("path", "first")
        .mapInArrow(_digest_pieces, "path string, conv_id long, n long, ends string"),
        "trie_digests",
    )
    whole = paths.drop("final").join(digests, ["conv_id", "path"])
    return digests, stage(whole, "trie_distinct")


def _merge_spines(parts: DataFrame) -> DataFrame:
    """Nodes on spines from their parts; ``below`` counts and savings go to the ends of paths."""
    per = parts.groupBy("node_key").agg(
        F.min("level").alias("level"),
        F.min("conv_id").alias("conv_id"),
        F.first("parent_key").alias("parent_key"),
        F.min("path_id").alias("owner"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"),
        F.min(F.when(F.col("ends") != EMPTY, F.col("ends"))).alias("ends"),
        F.max("last_bytes").alias("last_bytes"),
        F.sum("below_leaves").alias("below_leaves"),
        F.sum("below_saved").alias("below_saved"),
    )
    per = stage(per, "trie_spines")
    kids = per.where("parent_key is not null").groupBy(F.col("parent_key").alias("node_key")).agg(F.count("*").alias("kids"))
    per = per.join(kids, "node_key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    own_leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("below_leaves"))
    own_saved = (F.col("n_convs") - 1) * F.col("last_bytes") + F.col("below_saved")
    # each node's own figures are taken along by one of its paths, up to the path's start
    along = parts.select("path_id", "level", "node_key").join(
        per.select("node_key", "owner", own_leaves.alias("l"), own_saved.alias("s")), "node_key"
    )
    counted = F.col("owner") == F.col("path_id")
    upwards = along.groupBy("path_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("level")).alias("up"),
                    "node_key",
                    F.when(counted, F.col("l")).otherwise(0).cast("long").alias("l"),
                    F.when(counted, F.col("s")).otherwise(0).cast("long").alias("s"),
                )
            )
        ).alias("t")
    )

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("t").to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["node_key"] for x in path], pa.binary()),
                        pa.array(np.cumsum([x["l"] for x in path]).astype(np.int64)),
                        pa.array(np.cumsum([x["s"] for x in path]).astype(np.int64)),
                    ],
                    ["node_key", "l", "s"],
                )

    sums = upwards.select("t").mapInArrow(running, "node_key binary, l long, s long").groupBy("node_key").agg(
        F.sum("l").alias("l"), F.sum("s").alias("s")
    )
    return stage(
        per.join(sums, "node_key").select(
            "node_key",
            "level",
            "conv_id",
            "parent_key",
            "n_convs",
            F.col("n_children").cast("long").alias("n_children"),
            (F.col("n_leaves") + F.col("l")).alias("n_leaves"),
            (F.col("saved") + F.col("s")).alias("saved"),
            F.coalesce("ends", F.lit(EMPTY)).alias("ends"),
        ),
        "trie_spines",
    )


def _band_nodes(rows: DataFrame, shard_turns: int) -> DataFrame:
    """Nodes of the tries of one band: level, conv_id, parent_conv_id, ..., node_key at level 0."""
    sorted_paths = rows.repartitionByRange(F.slice("keys", 1, RANGE_TURNS)).sortWithinPartitions("keys")
    parts = stage(sorted_paths.mapInArrow(partial(_shards, shard_turns=shard_turns), SHARD_SCHEMA), "trie_nodes")
    spines = _merge_spines(parts.where("spine"))
    names = spines.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("over"))
    columns = ["level", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends", "node_key", "parent_key"]
    inner = parts.where("not spine").select(*columns, "parent_conv_id")
    outer = spines.select(*columns, F.lit(None).cast("long").alias("parent_conv_id"))
    nodes = inner.unionByName(outer)
    named = nodes.where("parent_key is null").drop("parent_key")
    below_spine = salted_lookup(
        nodes.where("parent_key is not null").drop("parent_conv_id"), names, ["parent_key"], ["conv_id", "level"]
    )
    return named.unionByName(below_spine.withColumnRenamed("over", "parent_conv_id").drop("parent_key"))


def conversation_trie(conversations: DataFrame, band: int = BAND, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each distinct prefix of the rebuilt ``conversations`` (conv_id, turn, role, text).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns = rebuilt_turns(bounded_batches(conversations))
    digests, paths = _distinct(_paths(turns, band))
    deepest = paths.agg(F.max("band")).first()[0] or 0
    found, below = None, None
    for b in range(deepest, -1, -1):
        rows = paths.where(F.col("band") == b)
        names = digests.select(F.col("path").alias("anchor"), F.col("conv_id").alias("anchor_conv"))
        if b:
            rows = salted_lookup(rows, names, ["anchor"], ["conv_id"])
            rows = rows.withColumn("keys", F.concat(F.array("anchor"), "keys")).withColumn(
                "sizes", F.concat(F.array(F.lit(0).cast("long")), "sizes")
            )
        else:
            rows = rows.withColumn("anchor_conv", F.lit(None).cast("long"))
        if below is None:
            for c in ("below_leaves", "below_saved", "below_children"):
                rows = rows.withColumn(c, F.lit(0).cast("long"))
        else:
            rows = rows.join(below, "path", "left")
            for c in ("below_leaves", "below_saved", "below_children"):
                rows = rows.withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
        nodes = _band_nodes(
            rows.select(
                F.transform("keys", lambda k: F.unhex(k)).alias("keys"),
                "sizes",
                "n",
                "conv_id",
                F.coalesce("anchor_conv", F.lit(NO_ANCHOR).cast("long")).alias("anchor_conv"),
                "ends",
                "below_leaves",
                "below_saved",
                "below_children",
            ),
            shard_turns,
        )
        if b:
            nodes = stage(nodes, "trie_band")
            below = nodes.where("level = 0").select(
                F.lower(F.hex("node_key")).alias("path"),
                F.col("n_leaves").alias("below_leaves"),
                F.col("saved").alias("below_saved"),
                F.col("n_children").alias("below_children"),
            )
            nodes = nodes.where("level > 0")
        own = nodes.select(
            "conv_id",
            (F.col("level") + F.lit(b * band)).cast("long").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            F.col("saved").alias("saved_tokens"),
            F.col("ends").alias("ends_sha256"),
        )
        found = own if found is None else found.unionByName(own)
    return found
