"""Exact top-k search by inner product of integer vectors, columnar with branch and bound.

Candidates and queries are cut into blocks of bounded size; each pair of blocks is one group. In
a group the candidates lie dimension by dimension. For each query, scores are accumulated over
one block of dimensions after another, those with the largest part of the query first. The
products of the remaining norms bound what the rest can add (Cauchy-Schwarz): candidates whose
upper bound stays below the k-th largest lower bound leave, and the survivors are compacted.

Defined results: vectors that are null or hold null or non-finite components take no part;
vectors of unequal length are compared over the longer one, with zeros; an empty vector scores
0. A score beyond 64 bits is cut to the nearest long. Rows with the same id are candidates each,
but not for queries of that id. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 8192, 1024
#: Dimensions accumulated between two rounds of pruning.
STEP = 16
#: Products of components below this bound are summed exactly in 64 bits.
SAFE = 1 << 26


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector, and each component, is present and finite."""
    bad = F.exists(
        column,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    return vectors.where(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull())


def matrix(rows: pd.Series, dtype=np.float64) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _quantised(rows: pd.Series, scale: int) -> np.ndarray:
    values = np.floor(scale * matrix(rows))
    if values.size and np.abs(values).max() >= SAFE:
        whole = np.empty(values.shape, object)
        whole[:] = [[int(x) for x in row] for row in values]
        return whole
    return values.astype(np.int64)


def _search(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of candidates that may be among the k best of one block.

    ``rest``: norm of each candidate over all dimensions from each step on, for this order.
    """
    steps = range(0, len(order), STEP)
    alive = np.arange(columns.shape[1])
    score = np.zeros(len(alive), columns.dtype)
    own = query[order].astype(np.float64)
    for number, lo in enumerate(steps):
        dims = order[lo : lo + STEP]
        whole = len(alive) == columns.shape[1]
        score = score + query[dims] @ (columns[dims] if whole else columns[np.ix_(dims, alive)])
        if len(alive) <= k:
            continue
        tail = np.sqrt((own[lo + STEP :] ** 2).sum())
        # two units more than the bound, for the rounding of norms
        margin = tail * rest[number + 1][alive] * (1 + 1e-9) + 2
        value = score.astype(np.float64)
        floor = np.partition(value - margin, len(alive) - k)[len(alive) - k]
        keep = value + margin >= floor
        if not keep.all():
            alive, score = alive[keep], score[keep]
    return alive, score


def exact_top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: int = 1024,
    candidate_block: int = CANDIDATES,
    query_block: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products.

    Both tables hold vec_id and embedding; components become floor(scale * x).
    """
    cand = usable(candidates).select("vec_id", "embedding")
    query = usable(queries).select("vec_id", "embedding")
    n_cand = max(1, -(-candidates.count() // candidate_block))
    n_query = max(1, -(-queries.count() // query_block))

    def dealt(df: DataFrame, own: str, mine: int, other: str, others: int, salt: int) -> DataFrame:
        return df.withColumn(
            own, F.pmod(F.xxhash64(F.lit(salt), "vec_id", "embedding"), F.lit(mine)).cast("int")
        ).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(cand, "c", n_cand, "q", n_query, 1)
    right = dealt(query, "q", n_query, "c", n_cand, 2)

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(block) and len(asked):
            have, want = _quantised(block["embedding"], scale), _quantised(asked["embedding"], scale)
            width = max(have.shape[1], want.shape[1])
            have = np.pad(have, ((0, 0), (0, width - have.shape[1])))
            want = np.pad(want, ((0, 0), (0, width - want.shape[1])))
            if have.dtype != want.dtype:
                have, want = have.astype(object), want.astype(object)
            columns, ids = np.ascontiguousarray(have.T), block["vec_id"].to_numpy()
            # one order of dimensions for the block of queries: the most mass first
            order = np.argsort(-np.abs(want.astype(np.float64)).sum(0), kind="stable")
            squares = columns.astype(np.float64)[order] ** 2
            edges = range(0, width + STEP, STEP)
            rest = [np.sqrt(squares[lo:].sum(0)) for lo in edges]
            for row, query_id in zip(want, asked["vec_id"].to_numpy(), strict=True):
                others = k + int((ids == query_id).sum())
                at, score = _search(row, columns, rest, order, others)
                good = ids[at] != query_id
                at, score = at[good], score[good]
                best = np.lexsort((ids[at], -score))[:k]
                out["query_id"] += [query_id] * len(best)
                out["vec_id"] += ids[at[best]].tolist()
                out["score"] += [int(min(max(s, -(2**63)), 2**63 - 1)) for s in score[best]]
        return pd.DataFrame(out).astype("int64")

    found = (
        left.groupBy("c", "q")
        .cogroup(right.groupBy("c", "q"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
