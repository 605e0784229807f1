"""Similarity of blocks by Hotelling T2: statistics, search, votes, leave-one-out.

A block is first reduced to n, a mean vector and a shrunk covariance, with ordinary partial
aggregates. Everything after works on one row per block.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtrace.operators.ordered import row_numbers
from voxtrace.session import stage

# Fixed values of the default search.
SHRINKAGE = 0.05
MIN_ROWS = 5
TOP_K = 5
EXPECTED_DEPTH = 70
EPSILON = 1e-12
FEATURES = [
    "Centroid X",
    "Centroid Y",
    "Centroid Z",
    "Lacuna BBox Size X (um)",
    "Lacuna BBox Size Y (um)",
    "Lacuna BBox Size Z (um)",
    "Major Axis (um) (radius) (from PCA on volume)",
    "Minor Axis (um) (radius) (from PCA on volume)",
    "Minor to Major Axis Ratio",
    "Surface Area (um^2)",
    "Surface Area to Vol Ratio (raw)",
    "Surface Area to Vol Ratio (um)",
    "Volume (um^3)",
    "Voxel Size (mm)",
    "index Lc.Or1_x",
    "index Lc.Or1_y",
    "index Lc.Or1_z",
    "index Lc.Or2_x",
    "index Lc.Or2_y",
    "index Lc.Or2_z",
    "index Lc_Ob",
    "index Lc_St",
]


def block_statistics(
    rows: DataFrame, key: str, features: Sequence[str] = FEATURES, shrinkage: float = SHRINKAGE
) -> DataFrame:
    """(key, n, mean, cov): rows with a missing or non-finite feature are left out.

    ``cov`` is the row-major sample covariance (zero for one row), shrunk towards its mean
    variance.
    """
    p = len(features)
    quoted = [F.col(f"`{f}`").cast("double") for f in features]
    finite = F.lit(True)
    for c in quoted:
        finite = finite & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    summed = (
        rows.select(F.col(f"`{key}`").alias(key), *[c.alias(f"f{i}") for i, c in enumerate(quoted)], finite.alias("_ok"))
        .where("_ok")
        .groupBy(key)
        .agg(
            F.count("*").alias("n"),
            *[F.avg(f"f{i}").alias(f"m{i}") for i in range(p)],
            *[F.coalesce(F.covar_samp(f"f{i}", f"f{j}"), F.lit(0.0)).alias(f"c{i}_{j}") for i, j in pairs],
        )
    )
    trace = sum((F.col(f"c{i}_{i}") for i in range(p)), F.lit(0.0))
    floor = F.lit(shrinkage) * trace / p

    def cell(i: int, j: int) -> Column:
        low, high = min(i, j), max(i, j)
        value = (1 - F.lit(shrinkage)) * F.col(f"c{low}_{high}")
        return value + floor if i == j else value

    return summed.select(
        key,
        "n",
        F.array(*[F.col(f"m{i}") for i in range(p)]).alias("mean"),
        F.array(*[cell(i, j) for i in range(p) for j in range(p)]).alias("cov"),
    )


#: Blocks whose sums a task holds before it hands them on.
HELD_BLOCKS = 512


def _merged(parts: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, co-moments) of rows whose parts have these."""
    n = parts["n"].to_numpy(float)
    means, moments = np.stack(parts["mean"].to_numpy()), np.stack(parts["moments"].to_numpy())
    # means as distances from the first one, so that large values keep their digits
    away = means - means[0]
    shift = n @ away / n.sum()
    spread = away - shift
    between = np.einsum("b,bi,bj->ij", n, spread, spread)
    return int(n.sum()), means[0] + shift, moments.sum(0) + between.ravel()


def block_moments(
    rows: DataFrame, key: str, features: Sequence[str] = FEATURES, shrinkage: float = SHRINKAGE
) -> DataFrame:
    """``block_statistics`` for many features: (key, n, mean, cov); a null key is a block of its own.

    A task reduces its rows to one (n, mean, co-moment matrix) per block over Arrow batches; these parts
    are merged in salted groups and then per block, so a block may hold any share of the rows. The plan
    does not grow with the square of the features.
    """
    p = len(features)
    part = rows.select(
        F.col(f"`{key}`").alias("_key"), F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_x")
    )
    kind = part.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, _salt int, n long, mean array<double>, moments array<double>"

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, list] = {}

        def out() -> pd.DataFrame:
            found = [(k, *_merged(pd.DataFrame(v, columns=["n", "mean", "moments"]))) for k, v in held.items()]
            table = pd.DataFrame(found, columns=["_key", "n", "mean", "moments"])
            table["_salt"] = np.random.default_rng(TaskContext.get().partitionId()).integers(0, 32, len(table))
            held.clear()
            return table[["_key", "_salt", "n", "mean", "moments"]]

        for batch in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in batch["_x"]], float).reshape(-1, p)
            good = np.isfinite(x).all(1)
            codes, keys = pd.factorize(batch["_key"].astype(object), use_na_sentinel=False)
            keys = [None if pd.isna(k) else k for k in keys]
            codes, x = codes[good], x[good]
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for places in np.split(order, cuts):
                if not len(places):
                    continue
                own, k = x[places], keys[codes[places[0]]]
                mean = own[0] + (own - own[0]).mean(0)
                mine = held.setdefault(k, [])
                mine.append((len(own), mean, ((own - mean).T @ (own - mean)).ravel()))
                if len(mine) > 8:
                    held[k] = [_merged(pd.DataFrame(mine, columns=["n", "mean", "moments"]))]
            if len(held) > HELD_BLOCKS:
                yield out()
        if held:
            yield out()

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        n, mean, moments = _merged(parts)
        return pd.DataFrame(
            {"_key": parts["_key"].iloc[:1], "_salt": 0, "n": n, "mean": [mean.tolist()], "moments": [moments.tolist()]}
        )

    def finish(parts: pd.DataFrame) -> pd.DataFrame:
        n, mean, moments = _merged(parts)
        cov = (moments / max(1, n - 1)).reshape(p, p)
        cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / p * np.eye(p)
        return pd.DataFrame({"_key": parts["_key"].iloc[:1], "n": n, "mean": [mean.tolist()], "cov": [cov.ravel().tolist()]})

    merged = part.mapInPandas(reduce, schema).groupBy("_key", "_salt").applyInPandas(merge, schema)
    return (
        merged.groupBy("_key")
        .applyInPandas(finish, f"_key {kind}, n long, mean array<double>, cov array<double>")
        .withColumnRenamed("_key", key)
    )


def _t2_udf():
    @F.pandas_udf("double")
    def t2(
        n1: pd.Series, m1: pd.Series, s1: pd.Series, n2: pd.Series, m2: pd.Series, s2: pd.Series
    ) -> pd.Series:
        import numpy as np

        if not len(n1):
            return pd.Series([], dtype="float64")
        a, b = n1.to_numpy(dtype=float), n2.to_numpy(dtype=float)
        delta = np.stack(m1.to_numpy()) - np.stack(m2.to_numpy())
        p = delta.shape[1]
        first = np.stack(s1.to_numpy()).reshape(-1, p, p)
        second = np.stack(s2.to_numpy()).reshape(-1, p, p)
        freedom = (a + b - 2)[:, None, None]
        pooled = (a - 1)[:, None, None] * first + (b - 1)[:, None, None] * second
        pooled = np.where(freedom > 0, pooled / np.where(freedom > 0, freedom, 1), 0.0)
        inverse = np.linalg.pinv(pooled)
        form = np.einsum("ni,nij,nj->n", delta, inverse, delta)
        return pd.Series(a * b / (a + b) * form)

    return t2


def hotelling_t2(left: str, right: str) -> Column:
    """T2 between two structs (n, mean, cov) of the same row."""
    return _t2_udf()(
        *[F.col(f"{side}.{field}") for side in (left, right) for field in ("n", "mean", "cov")]
    )


def guard(
    stats: DataFrame, min_rows: int = MIN_ROWS, expected_depth: int | None = EXPECTED_DEPTH
) -> DataFrame:
    """``status`` per block: depth_mismatch (an error), too_few_rows (skipped) or ok."""
    depth = F.lit(False)
    if expected_depth is not None and "block_depth" in stats.columns:
        depth = F.coalesce(F.col("block_depth") != expected_depth, F.lit(False))
    return stats.withColumn(
        "status",
        F.when(depth, "depth_mismatch").when(F.col("n") < min_rows, "too_few_rows").otherwise("ok"),
    )


def value_matches(df: DataFrame, column: str, expected: object) -> Column:
    """One metadata value against an expected one: booleans by identity, numbers as numbers."""
    if isinstance(expected, (list, tuple, set)):
        found = F.lit(False)
        for item in expected:
            found = found | value_matches(df, column, item)
        return found
    if column not in df.columns:
        return F.lit(expected is None)
    actual = F.col(f"`{column}`")
    if expected is None:
        return actual.isNull()
    boolean = isinstance(df.schema[column].dataType, T.BooleanType)
    if boolean or isinstance(expected, bool):
        same = actual == F.lit(expected) if boolean and isinstance(expected, bool) else F.lit(False)
        return F.coalesce(same, F.lit(False))
    as_text = actual.cast("string") == F.lit(str(expected))
    try:
        number = float(expected)
    except (TypeError, ValueError):
        return F.coalesce(as_text, F.lit(False))
    as_number = actual.try_cast("double")
    return F.coalesce(
        F.when(as_number.isNotNull(), as_number == number).otherwise(as_text), F.lit(False)
    )


def metadata_filter(blocks: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """All keys must match; a list allows any of its values."""
    kept = blocks
    for column, expected in filters.items():
        kept = kept.where(value_matches(blocks, column, expected))
    return kept


def mark_exclusions(
    blocks: DataFrame,
    patient_id: str | None = None,
    reference_id: str | None = None,
    query_path: str | None = None,
) -> DataFrame:
    """Add ``excluded_by``: patient, too_few_rows, reference_id, self_match or null.

    The rules apply in this order. A reference is the query itself if its path equals the
    query's, or its relative path is the query's name or ends it.
    """
    patient = F.lit(False)
    if patient_id is not None and patient_id.strip():
        patient = F.col("patient_id") == patient_id.strip()
    named = F.lit(False)
    if reference_id is not None and reference_id.strip():
        wanted = reference_id.strip()
        named = (
            (F.col("sample_identifier") == wanted)
            | (F.col("relpath") == wanted)
            | (F.regexp_extract("relpath", r"([^/]*)$", 1) == wanted)
        )
    itself = F.lit(False)
    if query_path is not None:
        itself = (
            (F.col("path") == query_path)
            | (F.regexp_extract("relpath", r"([^/]*)$", 1) == query_path.rsplit("/", 1)[-1])
            | F.lit(query_path).endswith(F.col("relpath"))
        )
    few = F.col("n") < MIN_ROWS if "n" in blocks.columns else F.lit(False)
    return blocks.withColumn(
        "excluded_by",
        F.when(patient, "patient")
        .when(few, "too_few_rows")
        .when(named, "reference_id")
        .when(itself, "self_match"),
    )


def _side(columns: Sequence[str] = ("n", "mean", "cov")) -> Column:
    return F.struct(*columns)


def search(query: DataFrame, references: DataFrame) -> DataFrame:
    """T2 of every reference block to one query block.

    ``query`` has exactly one row; its statistics enter as a scalar, so the reference table
    is scanned once and never shuffled.
    """
    one = query.select(_side().alias("s")).scalar()
    return (
        references.withColumn("_q", one)
        .withColumn("_r", _side())
        .withColumn("t2", hotelling_t2("_q", "_r"))
    )


def top_matches(matches: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k nearest blocks of one query, ranked by (t2, patient, block)."""
    nearest = matches.orderBy("t2", "patient_id", "block_id").limit(k)
    ranked = nearest.withColumn(
        "rank",
        F.row_number().over(Window.orderBy("t2", "patient_id", "block_id")).cast("bigint"),
    )  # at most k rows
    return ranked.withColumn("weight", 1 / (F.col("t2") + EPSILON))


def patient_summary(top: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Support of every patient among the retained matches, with class counts and position."""
    per_class = top.groupBy(*keys, "patient_id", "class_label").agg(
        F.count("*").alias("_n"),
        F.sum("weight").alias("_w"),
        F.min("t2").alias("_t2"),
        F.min_by("block_id", "rank").alias("_block"),
        F.min("rank").alias("_rank"),
    )
    counts = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "class_label"))),
        lambda c: F.concat(c["class_label"], F.lit(":"), (-c["n"]).cast("string")),
    )  # at most k classes
    summed = per_class.groupBy(*keys, "patient_id").agg(
        F.sum("_n").alias("match_count"),
        F.round(F.sum("_w"), 8).alias("weighted_score"),
        F.min("_t2").alias("best_t2"),
        F.min_by("_block", "_rank").alias("best_block"),
        F.array_join(counts, ",").alias("class_counts"),
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("weighted_score"), "best_t2", "patient_id")
    return summed.withColumn("position", F.row_number().over(order).cast("bigint"))


def class_votes(top: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted vote per class over the retained matches, with share and position."""
    votes = (
        top.where(F.col("class_label").isNotNull())
        .groupBy(*keys, "class_label")
        .agg(
            F.count("*").alias("count"),
            F.sum("weight").alias("weight"),
            F.min("t2").alias("best_t2"),
        )
    )
    order = Window.partitionBy(*keys).orderBy(
        F.desc("weight"), F.desc("count"), "best_t2", "class_label"
    )
    share = F.try_divide("weight", F.sum("weight").over(Window.partitionBy(*keys)))
    return votes.withColumn("share", F.round(share, 8)).withColumn(
        "position", F.row_number().over(order).cast("bigint")
    )


def class_inference(top: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Predicted class and confidence."""
    return (
        class_votes(top, keys)
        .where("position = 1")
        .select(*keys, F.col("class_label").alias("predicted_class"), F.col("share").alias("confidence"))
    )


def feature_differences(
    matches: DataFrame, features: Sequence[str], n: int = 3
) -> DataFrame:
    """The n features whose means differ most, per (query, reference) row of means."""
    names = F.array(*[F.lit(f) for f in features])
    pairs = F.transform(
        F.arrays_zip(names.alias("f"), F.col("query_mean"), F.col("reference_mean")),
        lambda x: F.struct(
            (-F.bround(F.abs(x["query_mean"] - x["reference_mean"]), 4)).alias("key"),
            x["f"].alias("feature"),
            F.bround(x["query_mean"], 4).alias("query_mean"),
            F.bround(x["reference_mean"], 4).alias("reference_mean"),
        ),
    )
    finite = F.filter(pairs, lambda x: F.abs(x["key"]) < float("inf"))
    ranked = F.slice(F.array_sort(finite), 1, n)
    return matches.select(
        *[c for c in matches.columns if c not in ("query_mean", "reference_mean")],
        F.posexplode(ranked).alias("place", "d"),
    ).select(
        *[c for c in matches.columns if c not in ("query_mean", "reference_mean")],
        (F.col("place") + 1).cast("bigint").alias("place"),
        "d.feature",
        "d.query_mean",
        "d.reference_mean",
        (-F.col("d.key")).alias("abs_diff"),
    )


def _diagonal_bound(left: str, right: str, p: int) -> Column:
    """A value T2 cannot fall below: the best single-feature distance.

    For any feature j, T2 >= scale * delta_j^2 / pooled_jj, and pooled_jj is at most the
    larger of the two variances.
    """
    n1, n2 = F.col(f"{left}.n"), F.col(f"{right}.n")
    best = F.lit(0.0)
    for j in range(p):
        delta = F.get(f"{left}.mean", F.lit(j)) - F.get(f"{right}.mean", F.lit(j))
        widest = F.greatest(
            F.get(f"{left}.cov", F.lit(j * p + j)), F.get(f"{right}.cov", F.lit(j * p + j))
        )
        best = F.greatest(best, F.coalesce(F.try_divide(delta * delta, widest), F.lit(0.0)))
    return n1 * n2 / (n1 + n2) * best


def _positive_definite(cov: Column, p: int) -> Column:
    """Whether the smallest eigenvalue of a flattened p x p covariance is clearly above 0."""

    @F.pandas_udf("boolean")
    def check(rows: pd.Series) -> pd.Series:
        def regular(flat) -> bool:
            if flat is None or len(flat) != p * p or not np.isfinite(np.asarray(flat, float)).all():
                return False
            values = np.linalg.eigvalsh(np.asarray(flat, float).reshape(p, p))
            return bool(values[0] > 1e-10 * max(values[-1], 0.0))

        return rows.map(regular)

    return check(cov)


def nearest_other_patients(
    stats: DataFrame, p: int, k: int = TOP_K, reach: int = 8, salts: int = 8
) -> DataFrame:
    """For every block, its k nearest blocks of other patients, exactly.

    1. Each block's distances to its ``reach`` neighbours on both sides, in the order of the
       first mean and in a hashed order, give an upper bound for its k-th best distance. The
       hashed order gives one even where all near blocks belong to the block's own patient.
    2. A block further away along the first feature than that bound allows cannot be among
       the k best, so blocks meet only within that radius (buckets of the first mean, salted),
       and only if no other single feature rules the pair out.
    3. The exact T2 is computed for the pairs that remain.

    A block with too few eligible neighbours has no radius and meets every block. So does one
    with a singular covariance: the bounds of 2 hold for a regular pooled covariance, which one
    regular side is enough for; pairs of two singular blocks are never ruled out.
    """
    side = F.struct("n", "mean", "cov")
    blocks = (
        stats.select("block_id", "patient_id", "class_label", side.alias("s"))
        .withColumn("at", F.get("s.mean", F.lit(0)))
        .withColumn("variance", F.get("s.cov", F.lit(0)))
        .withColumn("shuffled", F.xxhash64("block_id"))
        .withColumn("regular", _positive_definite(F.col("s.cov"), p))
    )
    placed = row_numbers(
        row_numbers(blocks, [], ["at", "block_id"], "pos"), [], ["shuffled", "block_id"], "pos_2"
    )
    placed = stage(placed.drop("shuffled"), "placed-blocks")
    left = placed.select(
        F.col("block_id").alias("query_id"), F.col("patient_id").alias("query_patient"),
        F.col("class_label").alias("query_class"), F.col("s").alias("q"), "at", "variance",
        F.col("regular").alias("q_regular"), "pos", "pos_2",
    )
    right = placed.select(
        "block_id", "patient_id", "class_label", F.col("s").alias("r"), F.col("at").alias("r_at"),
        F.col("regular").alias("r_regular"), F.col("pos").alias("r_pos"), F.col("pos_2").alias("r_pos_2"),
    )

    def neighbours(mine: str, theirs: str) -> DataFrame:
        steps = F.array(*[F.lit(s) for s in range(-reach, reach + 1) if s])
        return (
            left.withColumn(theirs, F.explode(F.transform(steps, lambda s: F.col(mine) + s)))
            .join(right.select(theirs, "block_id", "patient_id", "r"), theirs)
            .where("patient_id <> query_patient")
            .select("query_id", "q", "block_id", "r")
        )

    # A pair found in both orders must count once, or the bound would be too small.
    near = (
        neighbours("pos", "r_pos")
        .unionByName(neighbours("pos_2", "r_pos_2"))
        .dropDuplicates(["query_id", "block_id"])
        .withColumn("t2", hotelling_t2("q", "r"))
    )
    bound = F.get(F.array_sort(F.collect_list("t2")), F.lit(k - 1))  # at most 4 * reach values
    bounds = near.groupBy("query_id").agg(bound.alias("bound"))

    extent = placed.agg(
        F.struct(
            F.min("at").alias("lo"), F.max("at").alias("hi"), F.max("variance").alias("v"),
            F.min("s.n").alias("n"), F.count("*").alias("c"),
        )
    ).scalar()
    buckets = F.greatest(F.floor(F.col("_e.c") / 64), F.lit(1)).cast("bigint")
    scale = F.col("q.n") * F.col("_n") / (F.col("q.n") + F.col("_n"))
    slack = 1 + 1e-9
    radius = F.sqrt(F.col("bound") * slack * F.greatest("variance", "_v") / scale)

    def bucket(value: Column) -> Column:
        share = F.coalesce(F.try_divide(value - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
        inside = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
        return F.least(F.floor(inside * F.col("_b")), F.col("_b") - 1).cast("bigint")

    def with_extent(df: DataFrame) -> DataFrame:
        named = [F.col(f"_e.{c}").alias(f"_{c}") for c in ("lo", "hi", "v", "n")]
        return df.withColumn("_e", extent).select(*df.columns, *named, buckets.alias("_b"))

    seekers = (
        with_extent(left.join(bounds, "query_id", "left"))
        .withColumn("radius", F.when(F.col("q_regular"), radius))
        .withColumn("radius", F.coalesce("radius", F.col("_hi") - F.col("_lo") + 1))
        .withColumn(
            "bucket",
            F.explode(F.sequence(bucket(F.col("at") - F.col("radius")), bucket(F.col("at") + F.col("radius")))),
        )
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .select(
            "query_id", "query_patient", "query_class", "q", "q_regular", "at", "radius", "bound", "bucket", "salt"
        )
    )
    targets = (
        with_extent(right)
        .withColumn("bucket", bucket(F.col("r_at")))
        .withColumn("salt", F.pmod(F.xxhash64("block_id"), F.lit(salts)).cast("int"))
        .drop("_lo", "_hi", "_v", "_n", "_b", "r_pos", "r_pos_2")
    )
    allowed = F.coalesce(
        _diagonal_bound("q", "r", p) <= F.col("bound") * slack, F.lit(True)
    ) | ~(F.col("q_regular") | F.col("r_regular"))
    pairs = (
        seekers.join(targets, ["bucket", "salt"])
        .where(
            (F.col("patient_id") != F.col("query_patient"))
            & (F.abs(F.col("r_at") - F.col("at")) <= F.col("radius"))
            & allowed
        )
        .withColumn("t2", hotelling_t2("q", "r"))
    )
    order = Window.partitionBy("query_id").orderBy("t2", "patient_id", "block_id")
    return (
        pairs.select("query_id", "query_patient", "query_class", "block_id", "patient_id", "class_label", "t2")
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= k)
        .withColumn("weight", 1 / (F.col("t2") + EPSILON))
    )


def leave_one_out(top: DataFrame) -> DataFrame:
    """Predicted class, confidence and best distance per query block."""
    truth = top.groupBy("query_id", "query_class").agg(F.min("t2").alias("best_t2"))
    return class_inference(top, ["query_id"]).join(truth, "query_id").withColumn(
        "correct", F.col("predicted_class") == F.col("query_class")
    )


def loo_accuracy(predictions: DataFrame) -> DataFrame:
    """Accuracy per true class."""
    return predictions.groupBy("query_class").agg(
        F.count("*").alias("queries"),
        F.count_if("correct").alias("correct"),
        F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


def loo_distances(predictions: DataFrame) -> DataFrame:
    """Distance to the nearest block for right and wrong predictions."""
    return predictions.groupBy("correct").agg(
        F.count("*").alias("queries"),
        F.round(F.avg("best_t2"), 6).alias("mean_best_t2"),
        F.round(F.min("best_t2"), 6).alias("min_best_t2"),
        F.round(F.max("best_t2"), 6).alias("max_best_t2"),
    )


def loo_calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Mean confidence and accuracy per confidence bin."""
    number = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("bigint")
    return predictions.groupBy(number.alias("bin")).agg(
        F.count("*").alias("queries"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"),
    )


def loo_auc(top: DataFrame) -> DataFrame:
    """One-vs-rest ROC AUC per class, from the vote share of the class.

    Ties count one half. Queries are first counted per distinct score; a query without a vote
    for the class has score 0 and is added as a count.
    """
    from voxtrace.operators.ordered import running_total

    votes = class_votes(top, ["query_id"]).select("query_id", "class_label", "share")
    truth = top.select("query_id", "query_class").distinct()
    sizes = truth.groupBy(F.col("query_class").alias("class_label")).agg(
        F.count("*").alias("positives")
    )
    everyone = truth.agg(F.count("*")).scalar()
    scored = votes.join(truth, "query_id").groupBy("class_label", "share").agg(
        F.count_if(F.col("class_label") == F.col("query_class")).alias("p"),
        F.count_if(F.col("class_label") != F.col("query_class")).alias("q"),
    )
    voted = scored.groupBy("class_label").agg(F.sum("p").alias("vp"), F.sum("q").alias("vq"))
    silent = (
        sizes.join(voted, "class_label", "left")
        .withColumn("_all", everyone)
        .select(
            "class_label",
            F.lit(0.0).alias("share"),
            (F.col("positives") - F.coalesce("vp", F.lit(0))).alias("p"),
            (F.col("_all") - F.col("positives") - F.coalesce("vq", F.lit(0))).alias("q"),
        )
    )
    counted = scored.join(sizes.select("class_label"), "class_label", "left_semi").unionByName(silent)
    merged = counted.groupBy("class_label", "share").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    ranked = running_total(merged, ["class_label"], ["share"], F.col("q"), "below")
    return ranked.groupBy("class_label").agg(
        F.sum("p").alias("positives"),
        F.sum("q").alias("negatives"),
        F.round(
            F.try_divide(
                F.sum(F.col("p") * (F.col("below") - F.col("q") / 2)), F.sum("p") * F.sum("q")
            ),
            6,
        ).alias("auc"),
    )


# Fixed value: version of the stored statistics.
STATS_VERSION = 1


def statistics_signature(
    size: Column, modified: Column, policy: str, features: Sequence[str], shrinkage: float, depth
) -> Column:
    """Text that changes whenever stored statistics of a block are no longer valid."""
    return F.concat_ws(
        "|",
        F.lit(str(STATS_VERSION)),
        size.cast("string"),
        modified.cast("string"),
        F.lit(policy),
        F.lit(",".join(features)),
        F.lit(repr(shrinkage)),
        F.lit(str(depth)),
    )


def refresh_statistics(
    stored: DataFrame, signatures: DataFrame, rows: DataFrame, key: str, features: Sequence[str],
    shrinkage: float = SHRINKAGE,
) -> DataFrame:
    """Stored rows whose signature still holds, and fresh statistics for all other blocks."""
    valid = stored.join(signatures, [key, "signature"], "left_semi").withColumn(
        "rebuilt", F.lit(False)
    )
    stale = signatures.join(stored, [key, "signature"], "left_anti")
    fresh = block_statistics(
        rows.join(stale.select(key), key, "left_semi"), key, features, shrinkage
    )
    return valid.unionByName(fresh.join(stale, key).withColumn("rebuilt", F.lit(True)))
