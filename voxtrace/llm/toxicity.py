"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Every labelled training text counts towards the log-count ratios; the ``features`` n-grams with
the strongest evidence are kept, so the model has a fixed size. The weights of the scaled
features are fitted by logistic regression on at most ``sample`` labelled texts, chosen by a
hash of the id.

Defined results: a null or empty text has no n-grams and scores by the intercept alone. Without
labelled rows of both classes the score is the training share of toxic rows (0 without any).
Null labels are ignored; a document labelled more than once counts once per label row. Columns
beyond the ones named here are never read, or are passed on unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtrace.llm.textblocks import (
    BASE,
    BYTE_KEYS,
    LOWER,
    bounded_batches,
    chunks,
    held_out,
    mixed,
    powers,
    text_buffers,
)
from voxtrace.session import stage

#: Lengths of the n-grams; a space stands for every run of separators.
SIZES = (4, 5, 6)
#: N-grams kept by the model, and labelled texts used for the fit at most.
FEATURES, SAMPLE = 8192, 8000
#: Label rows (16 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 2_000_000
SMOOTHING = 1.0


@dataclass
class ToxicityModel:
    """Sorted n-gram hashes with one weight each (fitted weight times log-count ratio)."""

    grams: np.ndarray
    weights: np.ndarray
    intercept: float


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with a single space for each run of other ASCII signs, and the text
    offsets; each text begins and ends with a space.

    Letters are the bytes a-z and those of characters beyond ASCII.
    """
    n = len(offsets) - 1
    padded = np.insert(LOWER[data], np.repeat(offsets, 1), 32)
    marks = offsets + np.arange(n + 1)
    solid = ((padded >= 97) & (padded <= 122)) | (padded >= 128)
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first separator after a letter
    keep[marks] = True
    padded[~solid] = 32
    # a text's leading mark is already a space: drop the separators right behind it
    at = np.concatenate([[0], np.cumsum(keep)])
    return padded[keep], at[marks]


def _gram_hashes(letters: np.ndarray, size: int) -> np.ndarray:
    n = len(letters) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = powers(BASE, size)
    total = np.zeros(n, np.uint64)
    keys = BYTE_KEYS[letters]
    for k in range(size):
        total += keys[k : k + n] * weights[k]
    return mixed(total + np.uint64(size))


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk: first row, letters, and offsets that include both marks of each text."""
    data, offsets = text_buffers(column)
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        letters, marks = _letters(data[part[0] : part[-1]], part - part[0])
        yield lo, letters, marks


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: n-gram, toxic and other texts that hold it. Gram 0 counts texts, and gram 1
    the (text, n-gram) pairs."""
    for batch in batches:
        labels = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, letters, marks in _texts(batch.column("text")):
            found, flags = [], []
            sizes = [(_gram_hashes(letters, k), k) for k in SIZES]
            pairs = np.zeros(2, np.int64)
            n = len(marks) - 1
            for i in range(n):
                own = np.concatenate(
                    [h[marks[i] : max(marks[i], marks[i + 1] + 2 - k)] for h, k in sizes]
                )
                own = np.unique(own)
                found.append(own)
                flags.append(np.full(len(own), labels[lo + i], np.int8))
                pairs[labels[lo + i]] += len(own)
            grams, flag = np.concatenate(found), np.concatenate(flags)
            order = np.argsort(grams, kind="stable")
            grams, flag = grams[order], flag[order]
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, int)
            toxic = np.add.reduceat(flag.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            total = np.diff(np.append(first, len(grams)))
            ones = int(labels[lo : lo + n].sum())
            yield pa.RecordBatch.from_pydict(
                {
                    "gram": np.concatenate([grams[first], np.array([0, 1], np.uint64)]).view(np.int64),
                    "toxic_texts": np.concatenate([toxic, [ones, pairs[1]]]),
                    "other_texts": np.concatenate([total - toxic, [n - ones, pairs[0]]]),
                }
            )


def _hits(letters: np.ndarray, marks: np.ndarray, grams: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each text."""
    mask = np.uint64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)
    maybe[(grams & mask).astype(np.int64)] = True
    where, which = [], []
    for size in SIZES:
        hashes = _gram_hashes(letters, size)
        at = np.flatnonzero(maybe[(hashes & mask).astype(np.int64)])
        number = np.searchsorted(grams, hashes[at])
        number[number == len(grams)] = 0
        good = grams[number] == hashes[at] if len(grams) else np.zeros(len(at), bool)
        at, number = at[good], number[good]
        text = np.searchsorted(marks, at, "right") - 1
        inside = at + size <= marks[np.minimum(text + 1, len(marks) - 1)] + 1
        inside &= text < len(marks) - 1
        where.append(text[inside])
        which.append(number[inside])
    text, number = np.concatenate(where), np.concatenate(which)
    key = np.unique(text * (len(grams) + 1) + number)
    text, number = key // (len(grams) + 1), key % (len(grams) + 1)
    cuts = np.searchsorted(text, np.arange(len(marks)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield number[lo:hi]


def _fit(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled binary features, with a quadratic penalty, by
    accelerated full gradients. Both classes weigh the same in total."""
    lengths = np.array([len(r) for r in rows])
    columns = np.concatenate(rows) if len(rows) else np.zeros(0, int)
    owner = np.repeat(np.arange(len(rows)), lengths)
    scaled = ratios[columns]
    importance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weights, intercept = np.zeros(len(ratios)), 0.0
    mass = (importance * np.bincount(owner, scaled**2, len(rows))).mean() + 1.0
    step, penalty = 4.0 / mass, 1e-3
    last_w, last_b, previous = weights, intercept, np.inf
    for k in range(400):
        look_w = weights + k / (k + 3) * (weights - last_w)
        look_b = intercept + k / (k + 3) * (intercept - last_b)
        z = np.bincount(owner, scaled * look_w[columns], len(rows)) + look_b
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        loss = (importance * (np.logaddexp(0, z) - y * z)).mean() + penalty / 2 * (look_w**2).sum()
        if loss > previous + 1e-9:  # too long a step: halve it and drop the momentum
            step, last_w, last_b, previous = step / 2, weights, intercept, np.inf
            continue
        previous = loss
        off = importance * (p - y)
        slope = np.bincount(columns, scaled * off[owner], len(ratios)) / len(rows)
        last_w, last_b = weights, intercept
        weights = look_w - step * (slope + penalty * look_w)
        intercept = look_b - step * mass / 8 * off.mean()
    return weights, float(intercept)


def _with_text(documents: DataFrame, marked: DataFrame) -> DataFrame:
    """Labelled texts. The labels are broadcast while they are at most ``BROADCAST_ROWS`` rows of
    two numbers; beyond that Spark plans the join."""
    if marked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marked = F.broadcast(marked)
    return documents.select("doc_id", "text").join(marked, "doc_id").select("doc_id", "text", "toxic")


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, features: int = FEATURES, sample: int = SAMPLE
) -> ToxicityModel:
    """Train on the texts of ``documents`` (doc_id, text) that ``labels`` (doc_id, toxic 0/1) marks.

    The counts cover every labelled row. Only the kept n-grams, and the feature numbers of the
    bounded sample, reach the driver: at most ``features`` rows, and ``sample`` rows of at most
    ``features`` numbers.
    """
    marked = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = bounded_batches(_with_text(documents, marked))
    counted = rows.select("text", "toxic").mapInArrow(
        _count_grams, "gram long, toxic_texts long, other_texts long"
    )
    totals = counted.groupBy("gram").agg(
        F.sum("toxic_texts").alias("toxic_texts"), F.sum("other_texts").alias("other_texts")
    )
    # an n-gram of one or two texts is no evidence, whatever the size of the corpus
    table = stage(totals.where("toxic_texts + other_texts > 2 or gram in (0, 1)"), "toxicity_grams")
    fixed = {r["gram"]: (r["toxic_texts"], r["other_texts"]) for r in table.where("gram in (0, 1)").collect()}
    toxic, other = fixed.get(0, (0, 0))
    if not toxic or not other:
        share = toxic / (toxic + other) if toxic + other else 0.0
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 40.0 if share == 1 else -40.0)
    toxic_pairs, other_pairs = fixed[1]
    a, b = F.col("toxic_texts"), F.col("other_texts")
    n, both = float(toxic + other), F.col("toxic_texts") + F.col("other_texts")

    def evidence(part: Column, expected: Column) -> Column:
        return F.when(part > 0, part * F.log(part / expected)).otherwise(0.0)

    gain = (
        evidence(a, both * toxic / n)
        + evidence(b, both * other / n)
        + evidence(F.lit(toxic) - a, F.greatest(F.lit(n) - both, F.lit(1e-9)) * toxic / n)
        + evidence(F.lit(other) - b, F.greatest(F.lit(n) - both, F.lit(1e-9)) * other / n)
    )
    best = (
        table.where("gram not in (0, 1)")
        .withColumn("gain", gain)
        .orderBy(F.desc("gain"), "gram")
        .limit(features)
        .toPandas()
    )
    best["key"] = best["gram"].to_numpy(np.int64).view(np.uint64)
    best = best.sort_values("key")
    grams = best["key"].to_numpy(np.uint64)
    p = (best["toxic_texts"].to_numpy(float) + SMOOTHING) / (toxic_pairs + SMOOTHING * len(best))
    q = (best["other_texts"].to_numpy(float) + SMOOTHING) / (other_pairs + SMOOTHING * len(best))
    ratios = np.log(p / q)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h.astype(np.int16) for _, letters, marks in _texts(batch.column("text")) for h in _hits(letters, marks, grams)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int16())), batch.column("toxic")], ["found", "toxic"]
            )

    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    chosen = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")
    fitted = chosen.mapInArrow(numbers, "found array<short>, toxic int").toPandas()
    y = fitted["toxic"].to_numpy(float)
    if len(set(y)) < 2:  # the sample holds one class, or none of its ids has a text
        weights, intercept = np.ones(len(ratios)), float(np.log(toxic / other))
    else:
        weights, intercept = _fit([np.asarray(x, np.int64) for x in fitted["found"]], y, ratios)
    return ToxicityModel(grams, weights * ratios, intercept)


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """Probability of label 1 for each whole text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        out = np.full(len(column), model.intercept)
        if len(model.grams):
            for lo, letters, marks in _texts(column):
                for i, h in enumerate(_hits(letters, marks, model.grams)):
                    out[lo + i] += model.weights[h].sum()
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))

    return score(text)


def training_labels(labels: DataFrame) -> DataFrame:
    """Label rows outside the held-out fifth."""
    return labels.where(~held_out(F.col("doc_id"), 5, 0))
