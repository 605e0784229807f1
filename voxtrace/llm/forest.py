"""Approximate nearest neighbours by inner product: forests of hash prefixes.

Rows are cut into blocks of bounded size by a hash. Each block holds a forest: a tree hashes every
vector to a long string of bits, one for each random direction, and keeps the strings in a sorted
array. Vectors are first brought to equal length by one more component, which is 0 for a query; so
the largest inner product is the smallest angle, however uneven the lengths are.

A query descends to its longest matching prefix in each tree. Then all trees ascend together, one
bit at a time, until the ranges of the query's prefix hold enough entries in all trees of the
block. The rows in these ranges are scored once each, on the original vectors; other rows are
not looked at. Queries meet the blocks in blocks of their own; only the k best of a query and a
block leave a task.

How many entries are enough is a share of the block's rows, learnt from at most ``PROBES``
queries: their true neighbours are found by one scan, and each tells at which share it would have
been reached. The share that reaches ``RECALL`` of them holds for all queries and blocks, since
blocks are alike. Where neighbours are close it is small; where all vectors are nearly as far
as the nearest ones no index can do with few, and the share says so.

Defined results: vectors that are null, all zero or hold null or non-finite components take no
part, nor do rows without an id; vectors of unequal length are compared with zeros at the end. Of
equal vectors the k + 1 with the smallest ids are kept, which are all that can be among k
neighbours. Ties go to the smaller id. A repeated id counts once, by its best vector. An empty
table, or no query, gives no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtrace.llm.topk import matrix, usable
from voxtrace.session import stage

BITS = 32
TREES = 24
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
PROBES = 100
#: Share of the probes' true neighbours that the ascent has to reach.
RECALL = 0.96
#: Queries whose ranges are held at once in a task.
AT_ONCE = 512


class Forest:
    """The trees of one block of rows."""

    def __init__(self, rows: pd.DataFrame, trees: int, width: int, longest: float, seed: int):
        rows = rows.sort_values("vec_id", kind="stable")
        self.ids = rows["vec_id"].to_numpy(np.int64)
        self.vectors = self._padded(rows["embedding"], width)
        self.directions = np.random.default_rng(seed).standard_normal((width + 1, trees * BITS))
        self.trees, self.width = trees, width
        rest = np.sqrt(np.maximum(0, 1 - ((self.vectors / longest) ** 2).sum(1, keepdims=True)))
        strings = self._strings(np.hstack([self.vectors / longest, rest]))
        self.order = np.argsort(strings, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(strings.T, self.order, 1)

    @staticmethod
    def _padded(vectors: pd.Series, width: int) -> np.ndarray:
        found = matrix(vectors)
        return np.pad(found, ((0, 0), (0, width - found.shape[1])))

    def _strings(self, points: np.ndarray) -> np.ndarray:
        """One string of bits for each point and tree, the first direction as the highest bit."""
        high = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        parts = [
            (points @ self.directions[:, t * BITS : (t + 1) * BITS] > 0) @ high for t in range(self.trees)
        ]
        return np.stack(parts, axis=1)

    def strings_of(self, queries: np.ndarray) -> np.ndarray:
        return self._strings(np.hstack([queries, np.zeros((len(queries), 1))]))

    def ranges(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where rows that share 0 to ``BITS`` leading bits lie: (tree, bits, query) from, to."""
        shape = (self.trees, BITS + 1, len(strings))
        low, high = np.empty(shape, np.int32), np.empty(shape, np.int32)
        for t in range(self.trees):
            for bits in range(BITS + 1):
                first = strings[:, t] >> (BITS - bits) << (BITS - bits)
                low[t, bits] = np.searchsorted(self.sorted[t], first)
                high[t, bits] = np.searchsorted(self.sorted[t], first + (1 << (BITS - bits)))
        return low, high

    def needs(self, query: int, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Entries of the query's prefixes one bit below the length at which each row is reached."""
        place = np.argsort(self.order, axis=1)[:, rows]
        inside = (low[:, :, query, None] <= place[:, None]) & (place[:, None] < high[:, :, query, None])
        entries = np.append((high - low)[:, :, query].sum(0), 0)
        # ranges of longer prefixes lie within those of shorter ones
        return entries[inside.any(0).sum(0)]

    def reached(self, query: int, bits: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        found = np.zeros(len(self.ids), bool)
        for t in range(self.trees):
            found[self.order[t, low[t, bits, query] : high[t, bits, query]]] = True
        return np.flatnonzero(found)

    def search(self, queries: pd.DataFrame, k: int, share: float) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": [], "scored": []}
        least = min(k + 1, len(self.ids))
        once = len(np.unique(self.ids)) == len(self.ids)
        for at in range(0, len(queries), AT_ONCE):
            some = queries.iloc[at : at + AT_ONCE]
            wanted = self._padded(some["embedding"], self.width)
            low, high = self.ranges(self.strings_of(wanted))
            entries = (high - low).sum(0)
            stops = np.maximum(0, (entries > share * len(self.ids)).sum(0) - 1)
            for number, (query_id, bits) in enumerate(zip(some["vec_id"].to_numpy(np.int64), stops, strict=True)):
                mine = self.reached(number, bits, low, high)
                while len(mine) < least and bits:
                    bits -= 1
                    mine = self.reached(number, bits, low, high)
                mine = mine[self.ids[mine] != query_id]
                if not len(mine):
                    continue
                scored = len(mine)
                if once and scored > k:  # all that can be among the k best, ties and rounding included
                    rough = self.vectors[mine] @ wanted[number]
                    floor = np.partition(rough, scored - k)[scored - k]
                    mine = mine[rough >= floor - 1e-9 * (1 + abs(floor))]
                score = (self.vectors[mine] * wanted[number]).sum(1)
                best = np.lexsort((self.ids[mine], -score))
                _, first = np.unique(self.ids[mine][best], return_index=True)
                best = best[np.sort(first)[:k]]
                out["query_id"] += [query_id] * len(best)
                out["vec_id"] += self.ids[mine[best]].tolist()
                out["score"] += score[best].tolist()
                out["scored"] += [scored] + [0] * (len(best) - 1)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "scored": "int64"})


def entries_share(blocks: DataFrame, asked: DataFrame, k: int, trees: int, width: int, longest: float, seed: int) -> float:
    """Share of a block's rows, as entries in all its trees, that reaches ``RECALL`` of true neighbours."""
    probes = asked.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(PROBES).toPandas()

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(rows, trees, width, longest, seed)
        wanted = forest._padded(probes["embedding"], width)
        low, high = forest.ranges(forest.strings_of(wanted))
        out = []
        for number, own in enumerate(probes["vec_id"].to_numpy(np.int64)):
            score = np.where(forest.ids == own, -np.inf, forest.vectors @ wanted[number])
            best = np.argsort(-score, kind="stable")[:k]
            best = best[np.isfinite(score[best])]
            need = forest.needs(number, low, high, best) / len(forest.ids)
            out.append(pd.DataFrame({"probe": number, "score": score[best], "need": need}))
        return pd.concat(out)

    nearest = Window.partitionBy("probe").orderBy(F.desc("score"))
    found = blocks.groupBy("block").applyInPandas(measure, "probe int, score double, need double")
    found = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return found.agg(F.percentile("need", F.lit(RECALL)).alias("share")).first()["share"] or 0.0


def forest_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score, n_scored): the k nearest found of ``queries`` among ``vectors``.

    ``n_scored``: rows that were scored for the query.
    """
    schema = "query_id long, vec_id long, score double, scored long"

    def ready(df: DataFrame) -> DataFrame:
        wide = usable(df).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        return wide.where(F.exists("embedding", lambda x: x != 0)).dropDuplicates(["vec_id", "embedding"])

    # equal vectors: k + 1 smallest ids
    same = Window.partitionBy("embedding").orderBy("vec_id")
    index = ready(vectors).withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
    index, asked = stage(index, "forest_rows"), stage(ready(queries), "forest_queries")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    facts = index.agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.size("embedding")).alias("width")).first()
    asking = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not facts["n"] or not asking["n"]:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_scored long")
    width, longest = max(facts["width"], asking["width"]), facts["norm"]
    n_blocks, n_asking = math.ceil(facts["n"] / BLOCK_ROWS), math.ceil(asking["n"] / QUERY_ROWS)

    def dealt(column: str, n: int):
        return F.pmod(F.xxhash64("vec_id", "embedding", F.lit(seed)), F.lit(n)).cast("int").alias(column)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    blocks = index.select("vec_id", "embedding", dealt("block", n_blocks))
    share = entries_share(blocks, asked, k, trees, width, longest, seed)

    def search(rows: pd.DataFrame, who: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(who):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "scored": []})
        return Forest(rows, trees, width, longest, seed).search(who, k, share)

    keys = ["block", "asking"]
    held = blocks.withColumn("asking", every(n_asking))
    visits = asked.select("vec_id", "embedding", dealt("asking", n_asking)).withColumn("block", every(n_blocks))
    met = held.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(search, schema)
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("scored").alias("scored"))
    mine = Window.partitionBy("query_id")
    return (
        met.withColumn("n_scored", F.sum("scored").over(mine))
        .withColumn("rank", F.row_number().over(mine.orderBy(F.desc("score"), "vec_id")))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", "n_scored")
    )
