"""Language-model scoring by context-tree weighting over bytes, beside a smoothed word model.

A byte is eight binary decisions; each has its own context tree over the preceding bytes, up to
``DEPTH`` of them. A node's Krichevsky-Trofimov estimate depends on its counts alone, and counts
add up, so they are gathered from all training texts in one aggregation. The weighted
probability of a node is half its own estimate plus half the product over its children; the
ratio of both gives the weights with which all depths are mixed along a context. A context is
kept if it occurs ``LEAST`` times or more in the training texts; the others share the rest of
their parent, one further child. So the tree grows with the corpus.

The tree is never in one place. All contexts below one of ``SPLIT`` bytes are one task's, which
weighs them from the leaves up; the contexts of fewer bytes, of which there is a fixed number at
most, are weighed on the driver from sums of their children. A byte's probability depends on
itself and the ``DEPTH`` bytes before it alone, so it is found once for each distinct gram, in
the same tasks, from the top down. Texts look up the grams that hold ``FREQUENT_GRAM`` of the
training bytes or more by broadcast, the others by a join.

The word model is add-one smoothed unigrams over lower-cased words and an end token. Words that
hold ``FREQUENT`` of the training tokens or more (at most 1 / FREQUENT) are looked up by
broadcast, the others by a join on their hash.

Defined results: a null text is empty, and an empty text is its end alone. Without training
texts every byte costs eight bits and every token has probability 1. Each row is scored,
repeated ids included; a null id counts as empty text when rows are held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtrace.llm.textblocks import (
    LOWER,
    array_column,
    bounded_batches,
    chunks,
    held_out,
    text_buffers,
    word_hashes,
    word_spans,
)
from voxtrace.session import stage

DEPTH = 5
SHARE = 2.0**-15
#: Occurrences from which on a context is kept.
LEAST = 2
#: Bytes of the contexts whose subtrees are dealt to tasks.
SPLIT = 3
#: Distinct grams of a task, about.
TASK_GRAMS = 1 << 19
FREQUENT = 2.0**-20
FREQUENT_GRAM = 2.0**-21
#: Stands for the end token among word hashes.
END = np.uint64(0x6A09E667F3BCC909)
#: Bytes of text whose grams are counted at once.
COUNT_CHUNK = 2 << 20


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each byte with the DEPTH bytes before it, and the code offsets of each text.

    A text is preceded by zero bytes and ended by one.
    """
    n = len(offsets) - 1
    padded = np.insert(data, np.repeat(offsets[:-1], DEPTH), 0)
    ends = offsets[1:] + DEPTH * np.arange(1, n + 1)
    padded = np.insert(padded, ends, 0)
    codes = np.zeros(len(padded), np.uint64)
    for back in range(DEPTH + 1):
        codes[DEPTH:] |= padded[DEPTH - back : len(padded) - back].astype(np.uint64) << np.uint64(8 * back)
    first = offsets[:-1] + (DEPTH + 1) * np.arange(n)
    keep = np.ones(len(padded), bool)
    keep[(first[:, None] + np.arange(DEPTH)).ravel()] = False
    return codes[keep], offsets + np.arange(n + 1)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words and ends, and the token offsets of each text."""
    own = LOWER[data]
    starts, ends, bounds = word_spans(own, offsets)
    hashes = np.insert(word_hashes(own, starts, ends), bounds[1:], END)
    return hashes, bounds + np.arange(len(bounds))


def training_counts(documents: DataFrame, out: Column | None = None) -> DataFrame:
    """(is_token, key, n): byte grams and tokens of all texts. Of texts where ``out`` holds the
    grams are listed, but count 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in (False, True):
                mine = batch.filter(pa.compute.equal(batch.column("out"), held))
                data, offsets = text_buffers(mine.column("text"))
                for lo, hi in chunks(offsets, COUNT_CHUNK):
                    part = offsets[lo : hi + 1]
                    own = data[part[0] : part[-1]]
                    found = [(False, _grams(own, part - part[0])[0])]
                    if not held:
                        found.append((True, _tokens(own, part - part[0])[0]))
                    for is_token, keys in found:
                        key, n = np.unique(keys, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(key), is_token)),
                                pa.array(key.astype(np.uint64).view(np.int64)),
                                pa.array(n * (not held)),
                            ],
                            ["is_token", "key", "n"],
                        )

    out = F.lit(False) if out is None else out
    counted = documents.select("text", out.alias("out")).mapInArrow(count, "is_token boolean, key long, n long")
    return stage(counted.groupBy("is_token", "key").agg(F.sum("n").alias("n")), "lm_counts")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series after eight steps of the recurrence."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def _decisions(symbols: np.ndarray) -> np.ndarray:
    """Counts of both outcomes at the 255 decisions of a byte, from counts of 256 symbols.

    Decision 1 is the first bit; decision 2k + bit follows decision k.
    """
    out = np.zeros((*symbols.shape[:-1], 256, 2))
    for bit in range(8):
        sums = symbols.reshape(*symbols.shape[:-1], 2 ** (bit + 1), 128 >> bit).sum(-1)
        out[..., 2**bit : 2 ** (bit + 1), :] = sums.reshape(*symbols.shape[:-1], 2**bit, 2)
    return out


def _estimate(n: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability, some contexts at a time."""
    out = np.empty(n.shape[:-1])
    for lo in range(0, len(n), 256):
        a, b = (n[lo : lo + 256, ..., k].astype(float) for k in (0, 1))
        out[lo : lo + 256] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - np.log(np.pi) - _log_gamma(a + b + 1)
    return out


def _next(n: np.ndarray) -> np.ndarray:
    """Probability of both outcomes after counts n."""
    return (n + 0.5) / (n.sum(-1, keepdims=True) + 1)


@dataclass
class ContextTree:
    """Log10 probability of each byte after each context.

    ``contexts[d]``: sorted codes of the contexts kept at depth d (1 to DEPTH), the byte just
    before lowest. ``table`` has one row for the root and then for each context, as it holds
    where no deeper context is kept.
    """

    contexts: list[np.ndarray]
    table: np.ndarray

    def children(self) -> np.ndarray:
        """Row of the context that is one byte longer, for each row and byte; 0 where none is kept."""
        out = np.zeros((len(self.table), 256), np.int32)
        above, number = 0, 1
        for depth, codes in enumerate(self.contexts):
            parent = np.zeros(len(codes), int)
            if depth:
                parent = np.searchsorted(self.contexts[depth - 1], codes & ((1 << 8 * depth) - 1))
            out[above + parent, codes >> 8 * depth] = np.arange(number, number + len(codes))
            above, number = number, number + len(codes)
        return out.ravel()


def fit_context_tree(counts: DataFrame, share: float = SHARE) -> ContextTree:
    """The tree as one table, from gram counts (is_token, key, n), without contexts of less than
    ``share`` of the bytes. For small corpora: up to 256 / share counts of each depth reach the
    driver. ``gram_logs`` gives the same probabilities for any corpus."""
    grams = counts.where(~F.col("is_token")).select("key", "n")
    total = grams.agg(F.sum("n")).first()[0] or 0
    contexts, symbols = [], []
    root = np.zeros(256)
    for depth in range(DEPTH + 1):
        cut = grams.groupBy((F.col("key") % (1 << 8 * (depth + 1))).alias("key")).agg(F.sum("n").alias("n"))
        if depth:
            context = F.shiftright("key", 8)
            common = cut.groupBy(context.alias("context")).agg(F.sum("n").alias("all")).where(F.col("all") >= max(1.0, total * share))
            cut = cut.withColumn("context", context).join(common, "context")
        found = cut.select("key", "n").toPandas()
        key, n = found["key"].to_numpy(np.int64), found["n"].to_numpy(float)
        if not depth:
            root[key] = n
            continue
        codes = np.unique(key >> 8)
        if depth > 1:  # a context of enough bytes has a parent of enough bytes
            assert np.isin(codes & ((1 << 8 * (depth - 1)) - 1), contexts[-1]).all()
        mine = np.zeros((len(codes), 256))
        mine[np.searchsorted(codes, key >> 8), key & 255] = n
        contexts.append(codes)
        symbols.append(mine)
    levels = [root[None, :], *symbols]
    parents = [np.zeros(0, int)] + [
        np.zeros(len(c), int) if d == 0 else np.searchsorted(contexts[d - 1], c & ((1 << 8 * d) - 1))
        for d, c in enumerate(contexts)
    ]
    del symbols
    decisions = []
    while levels:
        decisions.append(_decisions(levels.pop(0)).astype(np.float32))
    # from the leaves up: weighted probabilities, and the weight of a node's own estimate
    weighted: list[np.ndarray] = [np.zeros(0)] * (DEPTH + 1)
    stay: list[np.ndarray] = [np.zeros(0)] * (DEPTH + 1)
    rests: list[np.ndarray] = [np.zeros(0)] * (DEPTH + 1)
    for depth in range(DEPTH, -1, -1):
        n = decisions[depth].astype(float)
        own = _estimate(n)
        if depth == DEPTH:
            weighted[depth], stay[depth], rests[depth] = own, np.ones(own.shape, np.float32), decisions[depth]
            continue
        below, up = decisions[depth + 1], parents[depth + 1]
        rest, product = n.copy(), np.zeros_like(own)
        np.subtract.at(rest, up, below)
        np.add.at(product, up, weighted[depth + 1])
        product += _estimate(rest)
        has = np.zeros(len(n), bool)
        has[up] = True
        both = np.logaddexp(own, product) - np.log(2)
        weighted[depth] = np.where(has[:, None], both, own)
        stay[depth] = np.where(has[:, None], np.exp(own - np.log(2) - both), 1.0).astype(np.float32)
        rests[depth] = rest.astype(np.float32)
        weighted[depth + 1] = np.zeros(0)
    # from the root down: what the depths above contribute, and the weight that is left for below
    table = []
    given, left = np.zeros((1, 256, 2)), np.ones((1, 256))
    for depth in range(DEPTH + 1):
        if depth:
            given, left = given[parents[depth]], left[parents[depth]]
        given = given + (left * stay[depth])[..., None] * _next(decisions[depth].astype(float))
        left = left * (1 - stay[depth])
        mixture = (given + left[..., None] * _next(rests[depth].astype(float))).astype(np.float32)
        decisions[depth] = rests[depth] = np.zeros(0)
        logs, node = np.zeros((len(mixture), 256), np.float32), np.ones(256, int)
        for bit in range(7, -1, -1):
            outcome = (np.arange(256) >> bit) & 1
            logs += np.log10(mixture[:, node, outcome])
            node = 2 * node + outcome
        table.append(logs)
    return ContextTree(contexts, np.concatenate(table))


def text_scores(tree: ContextTree, children: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log10 probability of each text, its end included."""
    codes, bounds = _grams(data, offsets)
    row, at = np.zeros(len(codes), np.int32), np.arange(len(codes))
    for back in range(1, DEPTH + 1):
        byte = ((codes[at] >> np.uint64(8 * back)) & np.uint64(255)).astype(np.int32)
        longer = children[row[at] * 256 + byte]
        kept = longer > 0
        at = at[kept]
        row[at] = longer[kept]
    logs = tree.table.ravel()[row.astype(np.int64) * 256 + (codes & np.uint64(255)).astype(np.int64)]
    return np.add.reduceat(logs, bounds[:-1], dtype=np.float64) if len(bounds) > 1 else np.zeros(0)


#: Log gamma at k + 1/2 and k + 1 for small counts k.
_SMALL = 1 << 12
_AT_HALF, _AT_ONE = (_log_gamma(np.arange(_SMALL) + step) for step in (0.5, 1.0))


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of two counts."""

    def gamma(n: np.ndarray, table: np.ndarray, step: float) -> np.ndarray:
        out = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
        big = n >= _SMALL
        out[big] = _log_gamma(n[big] + step)
        return out

    return gamma(a, _AT_HALF, 0.5) + gamma(b, _AT_HALF, 0.5) - np.log(np.pi) - gamma(a + b, _AT_ONE, 1.0)


@dataclass
class Level:
    """The decisions of the contexts of one depth: counts of both outcomes, those that kept
    children hold, the children's log weighted probability, and whether any child is kept."""

    a: np.ndarray
    b: np.ndarray
    below_a: np.ndarray
    below_b: np.ndarray
    below: np.ndarray
    has: np.ndarray

    def __post_init__(self) -> None:
        own = _block(self.a, self.b)
        self.rest_a, self.rest_b = self.a - self.below_a, self.b - self.below_b
        both = np.logaddexp(own, self.below + _block(self.rest_a, self.rest_b)) - np.log(2)
        self.weighted = np.where(self.has, both, own)
        self.stay = np.where(self.has, np.exp(own - np.log(2) - both), 1.0)

    def next(self) -> np.ndarray:
        """Probability of outcome 0 by the context itself."""
        return (self.a + 0.5) / (self.a + self.b + 1)

    def next_rest(self) -> np.ndarray:
        """Probability of outcome 0 by the rest, where no child is kept for the context."""
        return (self.rest_a + 0.5) / (self.rest_a + self.rest_b + 1)


def _parents_level(child: Level, kept: np.ndarray, parent: np.ndarray, a: np.ndarray, b: np.ndarray, has: np.ndarray) -> Level:
    """The level above: ``parent`` is the place there of each of the child level's decisions."""
    up, size = parent[kept], len(a)
    sums = [np.bincount(up, x[kept], size) for x in (child.a, child.b, child.weighted)]
    return Level(a, b, *sums, has)


class Subtrees:
    """The contexts of SPLIT to DEPTH bytes of distinct grams, one bit of the byte at a time."""

    def __init__(self, key: np.ndarray, n: np.ndarray) -> None:
        # the byte just before comes first, the byte itself last
        code = key & 255
        for back in range(1, DEPTH + 1):
            code = code | (((key >> (8 * back)) & 255) << (8 * (DEPTH + 1 - back)))
        self.n = n.astype(float)
        self.symbol = code & 255
        self.codes = {d: code >> (8 * (DEPTH + 1 - d)) << 8 | self.symbol for d in range(SPLIT - 1, DEPTH + 1)}
        self.order = {d: np.argsort(c, kind="stable") for d, c in self.codes.items()}
        places = {d: self.places(d, 0) for d in self.codes}
        self.kept = {d: np.bincount(at, self.n)[at] >= LEAST for d, (at, _) in places.items()}
        self.has = {d: np.zeros(len(key), bool) for d in self.codes}
        for d in range(SPLIT - 1, DEPTH):
            at = places[d][0]
            self.has[d] = (np.bincount(at, self.kept[d + 1]) > 0)[at]

    def places(self, depth: int, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """The decision of each gram, as a number, and a gram of each decision."""
        order = self.order[depth]
        nodes = (self.codes[depth] >> (8 - bit))[order]
        new = np.ones(len(nodes), bool)
        new[1:] = nodes[1:] != nodes[:-1]
        at = np.empty(len(nodes), np.int64)
        at[order] = np.cumsum(new) - 1
        return at, order[new]

    def levels(self, bit: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], dict[int, Level]]:
        """Places and first grams of all depths, and the levels from the leaves up to SPLIT - 1."""
        one = (self.symbol >> (7 - bit)) & 1 == 1
        at, first, found = {}, {}, {}
        for d in range(DEPTH, SPLIT - 2, -1):
            at[d], first[d] = self.places(d, bit)
            a, b = (np.bincount(at[d], np.where(one == side, self.n, 0)) for side in (False, True))
            has = self.has[d][first[d]]
            if d == DEPTH:
                zero = np.zeros_like(a)
                found[d] = Level(a, b, zero, zero, zero, has)
            else:
                below = first[d + 1]
                found[d] = _parents_level(found[d + 1], self.kept[d + 1][below], at[d][below], a, b, has)
        return at, first, found

    def node(self, bit: int, grams: np.ndarray) -> np.ndarray:
        """Context of SPLIT - 1 bytes and decision (1 to 255) of some grams, as one key."""
        code = self.codes[SPLIT - 1][grams]
        return code >> 8 << 8 | 1 << bit | (code & 255) >> (8 - bit)

    def top(self) -> Iterator[tuple[np.ndarray, ...]]:
        """For each bit: node, a, b, below_a, below_b, below of the contexts above the subtrees."""
        for bit in range(8):
            _, first, found = self.levels(bit)
            level = found[SPLIT - 1]
            yield self.node(bit, first[SPLIT - 1]), level.a, level.b, level.below_a, level.below_b, level.below

    def logs(self, node: np.ndarray, given: np.ndarray, left: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's byte, from what the contexts above give."""
        out = np.zeros(len(self.n))
        for bit in range(8):
            at, _, found = self.levels(bit)
            one = (self.symbol >> (7 - bit)) & 1
            above = np.searchsorted(node, self.node(bit, np.arange(len(out))))
            p, remains = given[above, one], left[above]
            other = np.where(one == 1, 1 - rest[above], rest[above])
            for d in range(SPLIT, DEPTH + 1):
                level, mine = found[d], at[d]
                own, stay = level.next()[mine], level.stay[mine]
                p = p + remains * np.where(self.kept[d], stay * np.where(one == 1, 1 - own, own), other)
                remains = remains * np.where(self.kept[d], 1 - stay, 0)
                own = level.next_rest()[mine]
                other = np.where(one == 1, 1 - own, own)
            out += np.log10(p)
        return out


def _weigh_top(node: np.ndarray, a: np.ndarray, b: np.ndarray, below_a: np.ndarray, below_b: np.ndarray, below: np.ndarray):
    """Probabilities that contexts of fewer than SPLIT bytes give to both outcomes of each node,
    the weight that is left for longer ones, and the probability of outcome 0 in the rest."""
    at, keys = {SPLIT - 1: np.arange(len(node))}, {SPLIT - 1: node}
    for d in range(SPLIT - 2, -1, -1):
        up = keys[d + 1] >> 16 << 8 | keys[d + 1] & 255
        keys[d], parent = np.unique(up, return_inverse=True)
        at[d] = parent[at[d + 1]]
    first = {d: np.searchsorted(keys[d], keys[d] >> 8 << 8 | 1) for d in keys}  # the context's first decision
    total = {d: np.bincount(at[d], a + b, len(keys[d]))[first[d]] for d in keys}
    kept = {d: total[d] >= (LEAST if d else 0) for d in keys}
    found = {SPLIT - 1: Level(a, b, below_a, below_b, below, (below_a + below_b)[first[SPLIT - 1]] > 0)}
    for d in range(SPLIT - 2, -1, -1):
        parent = np.empty(len(keys[d + 1]), np.int64)
        parent[at[d + 1]] = at[d]
        has = (np.bincount(parent, kept[d + 1], len(keys[d])) > 0)[first[d]]
        sums = (np.bincount(at[d], x, len(keys[d])) for x in (a, b))
        found[d] = _parents_level(found[d + 1], kept[d + 1], parent, *sums, has)
    given, left = np.zeros((len(node), 2)), np.ones(len(node))
    rest = np.zeros(len(node))
    for d in range(SPLIT):
        level, mine = found[d], at[d]
        holds = kept[d][mine]
        own, stay = level.next()[mine], level.stay[mine]
        part = left * np.where(holds, stay * own, rest)
        whole = left * np.where(holds, stay, 1)
        given += np.stack([part, whole - part], 1)
        left = left * np.where(holds, 1 - stay, 0)
        rest = level.next_rest()[mine]
    return given, left, rest


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a task's grams."""
    parts = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])


def gram_logs(counts: DataFrame) -> DataFrame:
    """(key, n, log): log10 probability of the last byte of each gram in ``counts``."""
    grams = counts.where(~F.col("is_token")).select("key", "n")
    tasks = max(1, -(-grams.count() // TASK_GRAMS))
    dealt = grams.repartition(tasks, F.shiftright("key", 8) % (1 << 8 * SPLIT))
    names = ["node", "a", "b", "below_a", "below_b", "below"]

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = _whole(batches)
        if len(key):
            for columns in Subtrees(key, n).top():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    sums = dealt.mapInArrow(top, "node long, " + ", ".join(f"{c} double" for c in names[1:]))
    above = sums.groupBy("node").agg(*(F.sum(c).alias(c) for c in names[1:])).toPandas().sort_values("node")
    columns = [above[c].to_numpy() for c in names]
    columns[0] = columns[0].astype(np.int64)
    model = grams.sparkSession.sparkContext.broadcast((columns[0], *_weigh_top(*columns)))

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = _whole(batches)
        if len(key):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(n), pa.array(Subtrees(key, n).logs(*model.value))], ["key", "n", "log"]
            )

    return stage(dealt.mapInArrow(logs, "key long, n long, log double"), "lm_grams")


def _by_document(keys: np.ndarray, owner: np.ndarray, documents: int) -> tuple[pa.Array, pa.Array]:
    """Distinct keys of each document, and how often they occur in it."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    per_doc = np.bincount(owner[first], minlength=documents)
    return array_column(keys[first].view(np.int64), per_doc), array_column(np.diff(np.append(first, len(keys))), per_doc)


def score_texts(documents: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte. Rows that are held out are not learned from."""
    documents = bounded_batches(documents.select("doc_id", "text"))
    out = held_out(F.col("doc_id"), modulus, remainder)
    counts = training_counts(documents, out)
    grams = gram_logs(counts)
    bytes_ = grams.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= max(1.0, bytes_ * FREQUENT_GRAM)
    likely = grams.where(often).select("key", "log").toPandas().sort_values("key")
    likely = documents.sparkSession.sparkContext.broadcast(
        (likely["key"].to_numpy(np.int64).view(np.uint64), likely["log"].to_numpy(float))
    )
    tokens = counts.where("is_token").select(F.col("key").alias("token"), "n")
    facts = tokens.agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).first()
    total, kinds = facts["all"] or 0, facts["kinds"]
    norm = np.log10(total + kinds + 1)
    frequent = tokens.where(F.col("n") >= max(1.0, total * FREQUENT)).toPandas()
    frequent["key"] = frequent["token"].to_numpy(np.int64).view(np.uint64)
    frequent = frequent.sort_values("key")
    common = documents.sparkSession.sparkContext.broadcast(
        (frequent["key"].to_numpy(np.uint64), frequent["n"].to_numpy(np.int64))
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (gram_keys, gram_log), (keys, seen) = likely.value, common.value
        logs = np.log10(seen + 1.0) - norm
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for lo, hi in chunks(offsets, 2 << 20):
                part = offsets[lo : hi + 1]
                own, part = data[part[0] : part[-1]], part - part[0]
                hashes, bounds = _tokens(own, part)
                doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
                at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
                hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                base = np.bincount(doc[hit], logs[at[hit]], hi - lo) if hit.any() else np.zeros(hi - lo)
                known = np.bincount(doc[hit], minlength=hi - lo)
                codes, code_bounds = _grams(own, part)
                writer = np.repeat(np.arange(hi - lo), np.diff(code_bounds))
                kinds_, which = np.unique(codes, return_inverse=True)
                place = np.minimum(np.searchsorted(gram_keys, kinds_), max(0, len(gram_keys) - 1))
                met = gram_keys[place] == kinds_ if len(gram_keys) else np.zeros(len(kinds_), bool)
                value = np.zeros(len(kinds_))
                value[met] = gram_log[place[met]]
                scores, other = np.bincount(writer, value[which], hi - lo), ~met[which]
                # the other words and grams: distinct within the document
                rare, times = _by_document(hashes[~hit], doc[~hit], hi - lo)
                grams_, gram_times = _by_document(codes[other], writer[other], hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(lo, hi - lo),
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.diff(bounds)),
                        pa.array(known.astype(np.int64)),
                        pa.array(base),
                        pa.array(scores),
                        pa.array(np.diff(part)),
                        rare,
                        times,
                        grams_,
                        gram_times,
                    ],
                    ["row", "doc_id", "n_tokens", "known", "base", "score", "n_bytes", "rare", "times", "grams", "gram_times"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(
        score,
        f"row long, doc_id {kind}, n_tokens long, known long, base double, score double, n_bytes long, "
        "rare array<long>, times array<long>, grams array<long>, gram_times array<long>",
    )
    scored = stage(scored, "lm_scores")
    words = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("word")).select(
        "row", F.col("word.rare").alias("token"), F.col("word.times").alias("times")
    )
    met = words.join(tokens.where(F.col("n") < max(1.0, total * FREQUENT)), "token", "left")
    n = F.coalesce("n", F.lit(0))
    others = met.groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(n + 1.0) - F.lit(float(norm)))).alias("more_base"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    zero = F.lit(0)
    asked = scored.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("gram")).select(
        "row", F.col("gram.grams").alias("key"), F.col("gram.gram_times").alias("times")
    )
    tails = asked.join(grams.where(~often).select("key", "log"), "key").groupBy("row").agg(
        F.sum(F.col("times") * F.col("log")).alias("more_score")
    )
    total_score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    joined = scored.drop("rare", "times", "grams", "gram_times").join(others, "row", "left").join(tails, "row", "left")
    return joined.select(
        "doc_id",
        out.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        total_score.alias("score"),
        (-total_score / F.log10(F.lit(2.0)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
