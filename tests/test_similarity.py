"""Block similarity against numpy, and exact pruned leave-one-out against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxtrace.operators import segmentation as seg
from voxtrace.operators import similarity as sim
from voxtrace.plans import segmentation_plans

P = 4
NAMES = [f"f {i}" for i in range(P)]


def make(spark, blocks=60, seed=1):
    rng = np.random.default_rng(seed)
    frames = []
    for b in range(blocks):
        n = int(rng.integers(3, 12))
        data = rng.normal(rng.normal(0, 2, P), rng.uniform(0.5, 2, P), (n, P))
        frames.append(pd.DataFrame(data, columns=NAMES).assign(block_id=b))
    rows = pd.concat(frames)
    # A third of all blocks belongs to one patient.
    patients = [f"p{0 if b % 3 == 0 else b % 11:02d}" for b in range(blocks)]
    library = pd.DataFrame(
        {"block_id": range(blocks), "patient_id": patients, "class_label": [f"c{b % 3}" for b in range(blocks)]}
    )
    return rows, library, spark.createDataFrame(rows), spark.createDataFrame(library)


def stats_numpy(x):
    cov = np.cov(x, rowvar=False) if len(x) > 1 else np.zeros((x.shape[1],) * 2)
    return len(x), x.mean(axis=0), 0.95 * cov + 0.05 * np.trace(cov) / x.shape[1] * np.eye(x.shape[1])


def t2_numpy(a, b):
    pooled = ((a[0] - 1) * a[2] + (b[0] - 1) * b[2]) / (a[0] + b[0] - 2) if a[0] + b[0] > 2 else np.zeros_like(a[2])
    d = a[1] - b[1]
    return a[0] * b[0] / (a[0] + b[0]) * d @ np.linalg.pinv(pooled) @ d


def test_statistics_skip_non_finite_rows(spark):
    rows, _, df, _ = make(spark)
    bad = spark.createDataFrame([(1.0, float("nan"), 1.0, 1.0, 0), (1.0, None, 1.0, 1.0, 0), (float("inf"), 1.0, 1.0, 1.0, 1)],
                                ", ".join(f"`{n}` double" for n in NAMES) + ", block_id bigint")
    got = sim.block_statistics(df.unionByName(bad), "block_id", NAMES).collect()
    for r in got:
        n, mean, cov = stats_numpy(rows.loc[rows.block_id == r["block_id"], NAMES].to_numpy())
        assert r["n"] == n and np.allclose(r["mean"], mean) and np.allclose(np.reshape(r["cov"], (P, P)), cov)


def test_one_row_block_has_zero_covariance(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "block_id int, a double, b double")
    row = sim.block_statistics(df, "block_id", ["a", "b"]).head()
    assert row["n"] == 1 and row["cov"] == [0.0] * 4


def test_distance_properties(spark):
    rows, library, df, lib = make(spark)
    stats = sim.block_statistics(df, "block_id", NAMES).join(lib, "block_id")
    got = {r["block_id"]: r["t2"] for r in sim.search(stats.where("block_id = 3"), stats).collect()}
    mine = stats_numpy(rows.loc[rows.block_id == 3, NAMES].to_numpy())
    for b, t2 in got.items():
        other = stats_numpy(rows.loc[rows.block_id == b, NAMES].to_numpy())
        assert np.isclose(t2, t2_numpy(mine, other), atol=1e-9)
    back = {r["block_id"]: r["t2"] for r in sim.search(stats.where("block_id = 7"), stats).collect()}
    assert np.isclose(got[7], back[3]) and abs(got[3]) < 1e-12


@pytest.mark.parametrize("reach,k", [(8, 5), (1, 5), (3, 2)])
def test_leave_one_out_is_exact(spark, reach, k):
    rows, library, df, lib = make(spark)
    stats = sim.block_statistics(df, "block_id", NAMES).join(lib, "block_id")
    got = sim.nearest_other_patients(stats, P, k=k, reach=reach, salts=3).collect()
    every = {b: stats_numpy(g[NAMES].to_numpy()) for b, g in rows.groupby("block_id")}
    patient = dict(zip(library.block_id, library.patient_id))
    for q in every:
        ranked = sorted((t2_numpy(every[q], every[b]), patient[b], b) for b in every if patient[b] != patient[q])
        mine = sorted((r["rank"], r["block_id"]) for r in got if r["query_id"] == q)
        assert [b for _, b in mine] == [b for _, _, b in ranked[:k]]


def test_ties_and_votes(spark):
    top = spark.createDataFrame(
        [(2.0, "pb", 2, "x"), (2.0, "pa", 3, "y"), (0.0, "pa", 1, None), (4.0, "pc", 4, "y")],
        "t2 double, patient_id string, block_id bigint, class_label string",
    )
    ranked = sim.top_matches(top, 3)
    assert [r["block_id"] for r in ranked.orderBy("rank").collect()] == [1, 3, 2]
    assert ranked.where("rank = 1").head()["weight"] == 1e12
    votes = sim.class_votes(sim.top_matches(top, 4)).orderBy("position").collect()
    assert [v["class_label"] for v in votes] == ["y", "x"] and abs(sum(v["share"] for v in votes) - 1) < 1e-8
    best = sim.patient_summary(sim.top_matches(top.where("class_label is not null"), 4)).orderBy("position").head()
    assert (best["patient_id"], best["best_block"], best["class_counts"]) == ("pa", 3, "y:1")


def test_metadata_rules(spark):
    df = spark.createDataFrame(
        [(1, "7.0", True, None), (2, "seven", False, 3), (3, None, None, 4)], "id int, t string, b boolean, n int"
    )
    def ids(**filters):
        return sorted(r["id"] for r in sim.metadata_filter(df, filters).collect())

    assert ids(t=7) == [1] and ids(t="seven") == [2] and ids(t=[7, "seven"]) == [1, 2]
    assert ids(b=True) == [1] and ids(b=1) == [] and ids(n=True) == []
    assert ids(n=None) == [1] and ids(zz=None) == [1, 2, 3] and ids(zz=1) == []
    assert ids(n=[3, "4.0"], b=False) == [2]


def test_guards_and_exclusions(spark):
    df = spark.createDataFrame([(1, 4, 70), (2, 5, 70), (3, 9, 60), (4, 9, None)], "block_id int, n int, block_depth int")
    got = {r["block_id"]: r["status"] for r in sim.guard(df).collect()}
    assert got == {1: "too_few_rows", 2: "ok", 3: "depth_mismatch", 4: "ok"}
    blocks = spark.createDataFrame(
        [("s1", "p1", "s1", "/l/s1/m.csv", 9), ("s2", "p2", "lib/s2", "/l/s2/m.csv", 9), ("s3", "p3", "s3", "/l/s3/m.csv", 4)],
        "sample_identifier string, patient_id string, relpath string, path string, n int",
    )
    marked = sim.mark_exclusions(blocks, " p1 ", "s2", "/q/s3").collect()
    assert [r["excluded_by"] for r in marked] == ["patient", "reference_id", "too_few_rows"]


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for q in range(40):
        for r in range(3):
            rows.append((q, f"c{q % 3}", r + 1, f"c{rng.integers(0, 3)}", float(rng.random()), float(rng.integers(1, 4))))
    top = spark.createDataFrame(rows, "query_id int, query_class string, rank int, class_label string, t2 double, weight double")
    got = {r["class_label"]: r["auc"] for r in sim.loo_auc(top).collect()}
    shares = {}
    for q, _, _, c, _, w in rows:
        shares[q, c] = shares.get((q, c), 0) + w
    totals = {q: sum(shares.get((q, f"c{i}"), 0) for i in range(3)) for q in range(40)}
    for i in range(3):
        score = {q: round(shares.get((q, f"c{i}"), 0) / totals[q], 8) for q in range(40)}
        pos, neg = [score[q] for q in score if q % 3 == i], [score[q] for q in score if q % 3 != i]
        want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
        assert abs(got[f"c{i}"] - want) < 1e-6


def test_mask_metrics(spark):
    pred = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.5), (1, 2, 0.0), (1, 3, 1.0)], "pair int, at int, label double")
    gt = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (1, 2, 0.0), (1, 3, 0.0)], "pair int, at int, label double")
    counts = seg.confusion(seg.contingency(pred, gt, ["pair"], ["at"]), ["pair"])
    rows = {r["label"]: r for r in seg.label_metrics(counts, ["Dice", "accuracy", "nope"]).collect()}
    assert (rows[1]["tp"], rows[1]["fp"], rows[1]["fn"], rows[1]["tn"]) == (1, 1, 1, 1)
    assert rows[2]["hallucinated"] and rows[2]["class_name"] == "cracks" and rows[2]["dice"] == 0.0
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == 4 for r in rows.values())
    with pytest.raises(ValueError):
        seg.supported_metrics(["nope"])
    same = seg.label_metrics(seg.confusion(seg.contingency(gt, gt, ["pair"], ["at"]), ["pair"]))
    assert same.head()["dice"] == 1.0
    naming = spark.createDataFrame([(3, True), (3, False), (1, True)], "l int, h boolean")
    names = [r[0] for r in naming.select(seg.class_name(F.col("l"), F.col("h"))).collect()]
    assert names == ["class_3_hallucinated", "class_3", "lacunae"]


def test_leave_one_out_is_exact_for_singular_covariances(spark):
    """Collinear features without shrinkage: no pair of singular blocks may be ruled out."""
    rng = np.random.default_rng(12)
    rows = []
    for block in range(40):
        a = rng.normal(block % 7, 1, 6)
        rows += [(block, float(x), float(2 * x)) for x in a]
    df = spark.createDataFrame(rows, "block_id bigint, f0 double, f1 double")
    stats = sim.block_statistics(df, "block_id", ["f0", "f1"], shrinkage=0.0)
    stats = stats.withColumn("patient_id", (F.col("block_id") % 5).cast("string")).withColumn(
        "class_label", (F.col("block_id") % 2).cast("string")
    )
    got = {
        (r["query_id"], r["block_id"]) for r in sim.nearest_other_patients(stats, 2, k=4, reach=2).collect()
    }
    pairs = stats.select("block_id", "patient_id", F.struct("n", "mean", "cov").alias("q"))
    other = pairs.toDF("other_id", "other_patient", "r")
    scored = pairs.join(other, F.col("patient_id") != F.col("other_patient")).select(
        "block_id", "other_id", "other_patient", sim.hotelling_t2("q", "r").alias("t2")
    )
    best: dict = {}
    for r in scored.collect():
        best.setdefault(r["block_id"], []).append((r["t2"], r["other_patient"], r["other_id"]))
    assert got == {(q, b) for q, own in best.items() for _, _, b in sorted(own)[:4]}


def test_masks_that_list_foreground_only(spark):
    pred = spark.createDataFrame([(1, 1, 1.0)], "pair int, at int, label double")
    truth = spark.createDataFrame([(1, 2, 2.0)], "pair int, at int, label double")
    cells = spark.createDataFrame([(1, 10)], "pair int, cells bigint")
    rows = {r["label"]: r for r in sim_counts(pred, truth, cells)}
    assert (rows[1]["tp"], rows[1]["fp"], rows[1]["fn"], rows[1]["tn"]) == (0, 1, 0, 9)
    assert (rows[2]["tp"], rows[2]["fp"], rows[2]["fn"], rows[2]["tn"]) == (0, 0, 1, 9)
    assert seg.supported_metrics(["dice", "Dice", "x", "x"]) == (["dice"], ["x"])
    with pytest.raises(ValueError, match="At least one"):
        seg.supported_metrics([])


def sim_counts(pred, truth, cells):
    return seg.confusion(seg.contingency(pred, truth, ["pair"], ["at"], cells), ["pair"]).collect()


def test_block_moments_of_all_features_and_their_distances(spark):
    rng = np.random.default_rng(8)
    p = len(sim.FEATURES)
    parts = {b: rng.standard_normal((n, p)) * rng.uniform(0.5, 3, p) + 1e9 * (b == "far") for b, n in
             (("hot", 4000), ("far", 300), ("small", 40), ("one", 1), (None, 30))}
    rows = [(b, *r) for b, x in parts.items() for r in x.tolist()]
    rows += [("hot", *[None] * p), ("small", *[float("nan")] * p), ("gone", float("inf"), *[0.0] * (p - 1))]
    schema = "block string, " + ", ".join(f"`{f}` double" for f in sim.FEATURES)
    df = spark.createDataFrame(rows, schema).repartition(8)
    stats = sim.block_moments(df, "block")
    got = {r["block"]: r for r in stats.collect()}
    assert set(got) == set(parts)
    want = {b: stats_numpy(x) for b, x in parts.items()}
    for b, (n, mean, cov) in want.items():
        assert got[b]["n"] == n
        assert np.allclose(got[b]["mean"], mean, rtol=1e-12, atol=1e-9)
        # values near 1e9 have seven digits behind the point
        assert np.allclose(np.array(got[b]["cov"]).reshape(p, p), cov, rtol=1e-6, atol=1e-5 if b == "far" else 1e-9)
    sides = stats.select(F.struct("n", "mean", "cov").alias("l"), "block").where("block = 'hot'").drop("block")
    pairs = sides.crossJoin(stats.select("block", F.struct("n", "mean", "cov").alias("r")))
    found = {r["block"]: r["t2"] for r in pairs.select("block", sim.hotelling_t2("l", "r").alias("t2")).collect()}
    for b in ("small", "one", None):
        assert np.isclose(found[b], t2_numpy(want["hot"], want[b]), rtol=1e-6)
    assert sim.block_moments(df.limit(0), "block").count() == 0


def test_masks_are_dealt_before_they_are_grouped(spark, sf_dir, capsys):
    """Cells are nearly unique: a table of them beside the scan would hold a whole file split."""
    for name in ("contingency", "confusion", "seg_metrics", "hallucinated", "seg_batch", "sparse_confusion"):
        segmentation_plans.QUERIES[name](spark, sf_dir).explain()
        below = capsys.readouterr().out.split("REPARTITION_BY_NUM")
        assert len(below) > 1 and not any("Aggregate" in b for b in below[-1:]), name


def test_cells_listed_twice_have_their_largest_label(spark):
    pred = spark.createDataFrame([(1, 5, 1.0), (1, 5, 2.0), (1, 6, 0.0)], "pair int, at int, label double")
    truth = spark.createDataFrame([(1, 5, 1.0), (1, 6, 0.0), (1, 6, 1.0)], "pair int, at int, label double")
    got = seg.contingency(pred, truth, ["pair"], ["at"]).collect()
    assert {(r["gt"], r["pred"], r["n"]) for r in got} == {(1, 2, 1), (1, 0, 1)}
