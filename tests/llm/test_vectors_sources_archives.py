"""Exact and approximate search, mixing, archives: brute force, round trips and edge cases."""

import collections
import math
import os
import struct

import numpy as np
import pandas as pd
import pytest
import zstandard

from voxtrace.llm import forest, warc
from voxtrace.llm.forest import forest_top_k
from voxtrace.llm.mixing import hypergeometric, mix, shard_rows, split_quotas
from voxtrace.llm.topk import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score double, c string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 1, 0.5, "x") for i, e in rows], SCHEMA)


def brute_top(rows, ids, k, scale):
    good = [(i, np.array(e, np.float32).astype(float)) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q, v in ((i, e) for i, e in good if i in ids):
        scores = []
        for i, e in good:
            if i == q:
                continue
            n = min(len(v), len(e))
            if scale:
                s = int((np.floor(scale * v[:n]).astype(object) * np.floor(scale * e[:n]).astype(object)).sum()) if n else 0
            else:
                s = float(v[:n] @ e[:n])
            scores.append((-s, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def odd_vectors(rng, n=400, width=24):
    rows = [(i, rng.standard_normal(width).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + k, rows[3][1]) for k in range(30)]  # ties
    rows += [(900, None), (901, []), (902, [None] + rows[0][1][1:]), (903, [float("nan")] * width), (904, [float("inf")] * width), (905, [0.0] * width), (906, rows[1][1][:5])]
    return rows


def test_exact_top_k_against_brute_force(spark):
    rows = odd_vectors(np.random.default_rng(2))
    df = vectors(spark, rows)
    got = exact_top_k(df, df.where("vec_id % 50 = 0"), k=10, candidate_block=64, query_block=4)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, {i for i, _ in rows if i % 50 == 0}, 10, 1024)


def test_exact_top_k_of_odd_tables(spark):
    df = vectors(spark, [(0, [1.0]), (1, [2.0]), (2, [1e30])])
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_top_k(df, df.where("vec_id = 0"), k=10).collect()}
    assert got == {(0, 1): (2, 2**63 - 1), (0, 2): (1, 1024 * 2048)}
    none = vectors(spark, [])
    assert exact_top_k(none, none).count() == 0 and exact_top_k(df, none).count() == 0


def test_forest_finds_neighbours_with_exact_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(32) * (1 + i % 3)).astype(np.float32).tolist()) for i in range(9000)]
    rows += [(9000 + k, rows[40][1]) for k in range(50)] + [(9990, None), (9991, [0.0] * 32), (9992, [float("nan")] * 32), (9993, [1.0, None])]
    df = vectors(spark, rows)
    asked = {i for i, _ in rows if i % 200 == 0}
    got = forest_top_k(df, df.where("vec_id % 200 = 0"), k=20).collect()
    want = brute_top([r for r in rows if r[0] != 9991], asked, 20, None)
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(found & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    by_id = dict(rows)
    for r in got:
        exact = np.array(by_id[r["query_id"]], float) @ np.array(by_id[r["vec_id"]], float)
        assert abs(r["score"] - exact) < 1e-9
    per_query = collections.Counter(r["query_id"] for r in got)
    assert set(per_query.values()) == {20} and set(per_query) == asked
    # the copies of vector 40 come in the order of their ids
    assert [r["rank"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))][:20] == list(range(1, 21))


def recall_and_share(spark, table, step, k=20):
    """Share of the true neighbours found, and mean share of rows scored, at production parameters."""
    df = vectors(spark, list(enumerate(table.tolist())))
    got = forest_top_k(df, df.where(f"vec_id % {step} = 0"), k=k).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    exact, want = table.astype(float), set()
    for q in range(0, len(table), step):
        scores = exact @ exact[q]
        scores[q] = -np.inf
        want |= {(q, int(i)) for i in np.argsort(-scores)[:k]}
    scored = {r["query_id"]: r["n_scored"] for r in got}
    return len(found & want) / len(want), sum(scored.values()) / len(scored) / len(table)


def test_forest_finds_neighbours_among_uneven_lengths(spark):
    rng = np.random.default_rng(12)
    wide = rng.standard_normal((12000, 16))
    wide /= np.sqrt((wide**2).sum(1, keepdims=True))
    for lengths in (rng.uniform(0.05, 1, 12000), np.where(np.arange(12000) % 100 == 7, 10.0, 1.0)):
        recall, _ = recall_and_share(spark, (wide * lengths[:, None]).astype(np.float32), 200)
        assert recall >= 0.9


def test_forest_scores_few_rows_where_neighbours_are_close(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((400, 32))
    rows = centers[rng.integers(0, 400, 12000)] + 0.1 * rng.standard_normal((12000, 32))
    rows /= np.sqrt((rows**2).sum(1, keepdims=True))
    recall, share = recall_and_share(spark, rows.astype(np.float32), 100)
    assert recall >= 0.9 and share < 0.1


def test_forest_levels_by_hand():
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"vec_id": np.arange(300), "embedding": list(rng.standard_normal((300, 6)))})
    trees = forest.Forest(rows, 4, 6, 10.0, 1)
    ask = rng.standard_normal((2, 6))
    strings = trees.strings_of(ask)
    low, high = trees.ranges(strings)
    have = np.take_along_axis(trees.sorted, np.argsort(trees.order, axis=1), 1).T  # string of each row and tree
    for q in range(2):
        alike = np.array([[32 - int(a ^ b).bit_length() for a, b in zip(row, strings[q])] for row in have.tolist()])
        for bits in (0, 1, 3, 7, 32):
            assert set(trees.reached(q, bits, low, high)) == set(np.flatnonzero((alike >= bits).any(1)))
        entries = [(alike >= bits).sum() for bits in range(34)]
        assert trees.needs(q, low, high, np.arange(300)).tolist() == [entries[best + 1] for best in alike.max(1)]


def test_forest_of_odd_tables(spark):
    none = vectors(spark, [])
    assert forest_top_k(none, none).count() == 0
    df = vectors(spark, [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.5, 0.5]), (21, [0.5, 0.5])])
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in forest_top_k(df, df.where("vec_id = 0")).collect()]
    assert [g[2] for g in sorted(got)][:2] == [20, 21]
    assert forest_top_k(df, none).count() == 0
    # an id with two vectors counts once, by the better one; extra columns with clashing names
    df = vectors(spark, [(0, [1.0, 0.0]), (7, [0.5, 0.5]), (7, [0.9, 0.0]), (8, [0.6, 9.0]), (None, [5.0, 5.0])])
    df = df.selectExpr("*", "1 AS query_id", "2 AS rank", "'x' AS block", "3 AS asking")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in forest_top_k(df, df.where("vec_id = 0")).collect())
    assert [(a, b) for a, b, _ in got] == [(1, 7), (2, 8)] and abs(got[0][2] - 0.9) < 1e-6


# -- mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: float(most * sizes[s]) for s in over}


def test_mix_meets_targets_and_shards_hold_each_draw_once(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(6000):
        source = "hot" if i % 3 else [None, "a", "Z", "é", "small", "empty"][int(rng.integers(6))]
        if source == "small" and i > 300:
            source = "a"
        text = "" if source == "empty" else None if i % 97 == 0 else "w " * int(rng.integers(0, 40))
        rows.append((i, text, source, 1, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, label int, kind string")
    mixed = mix(docs, shard_words=20_000, block_docs=64)
    found = mixed.collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    want = targets(sizes)
    taken = collections.Counter()
    for r in found:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + r["target"])
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["size"] * len(r["shards"]) and len(r["shards"]) <= 3
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    again = {r["doc_id"]: r["shards"] for r in mix(docs.repartition(7), shard_words=20_000, block_docs=64).collect()}
    assert again == {r["doc_id"]: r["shards"] for r in found}
    taken_rows = shard_rows(mixed)
    assert taken_rows.count() == sum(len(r["shards"]) for r in found)
    by_shard = collections.Counter()
    for r in found:
        for s in r["shards"]:
            by_shard[s] += r["size"]
    assert max(by_shard.values()) < 1.6 * min(by_shard.values())


def test_mix_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(none).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {r["taken"] for r in mix(empty).collect()} == {0}
    same = spark.createDataFrame([(1, "a b", "s")] * 4 + [(None, "c", "t")], "doc_id long, text string, source string")
    assert mix(same).count() == 5


def test_splitting_tree_is_exact(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 0), (3, 13), (4, 100)], "source_no int, quota long")
    rows = split_quotas(quotas, 3, 5).collect()
    per_shard = collections.Counter()
    for no, quota in ((1, 40), (2, 0), (3, 13), (4, 100)):
        own = sorted((r["first"], r["last"]) for r in rows if r["source_no"] == no)
        assert own[0][0] == 0 and max(b for _, b in own) == quota
        assert sum(b - a for a, b in own) == quota
    for r in rows:
        per_shard[r["shard"]] += r["last"] - r["first"]
    assert len(per_shard) == 8 and max(per_shard.values()) - min(per_shard.values()) <= 1


def test_hypergeometric_quantiles(spark):
    cases = [(t, m, c) for t, m, c in ((1, 1, 1), (1, 0, 1), (7, 3, 4), (40, 40, 13), (50, 20, 50), (60, 0, 30), (400, 150, 200), (3000, 2900, 1500))]
    rows = [(t, m, c, (i + 0.5) / 40) for t, m, c in cases for i in range(40)] + [(0, 0, 0, 0.5)]
    df = spark.createDataFrame(rows, "t long, m long, c long, u double")
    for r in df.withColumn("k", hypergeometric(*(df[c] for c in "tmcu"))).collect():
        t, m, c, u = r["t"], r["m"], r["c"], r["u"]
        sums, total = 0, math.comb(t, c)
        for k in range(max(0, c + m - t), min(m, c) + 1):
            sums += math.comb(m, k) * math.comb(t - m, c - k)
            if sums / total > u:
                break
        assert r["k"] == k
    large = df.limit(1).selectExpr("6000000000L AS t", "2000000000L AS m", "3000000000L AS c", "0.5D AS u")
    k = large.select(hypergeometric(*(large[c] for c in "tmcu")).alias("k")).head()["k"]
    assert abs(k - 10**9) <= 5


# -- archives


def test_archives_round_trip(spark, tmp_path):
    rng = np.random.default_rng(6)
    htmls = [f"<html>{'word ' * int(rng.integers(1, 60))}{i}</html>" for i in range(80)]
    rows = [(i, f"http://x/{i}", h, 1) for i, h in enumerate(htmls)]
    rows += [(100 + i, "http://y/ \r\nz", htmls[i % 5], 1) for i in range(20)]
    rows += [(200, None, None, 1), (201, "u", "", 1), (202, "u", "é\r\n\r\nx" * 50_000, 1), (None, "u", htmls[0], 1), (None, "u", "alone", 1), (203, "u", "twin", 1), (203, "u", "twin", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    folder = str(tmp_path / "archives")
    manifest = warc.write_archives(pages, folder).collect()
    assert sum(r["records"] for r in manifest) == len(rows)
    assert sorted(os.listdir(folder)) == sorted(r["archive"] for r in manifest)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    least = {}
    for i, _, h, _ in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h, _ in rows:
        payload = (h or "").encode()
        first = least.get(h or "")
        revisit = first is not None and first != i
        want.append((i, len(payload), warc.payload_digest(payload), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    by_id = {r["page_id"]: r for r in got}
    assert bytes(by_id[202]["payload"]) == ("é\r\n\r\nx" * 50_000).encode()
    only = warc.round_trip(pages.where("page_id < 110"), least_bytes=10**6).collect()
    assert {r["record_type"] for r in only} == {"response"}
    assert warc.round_trip(pages.where("false")).count() == 0


def test_reader_finds_faults():
    record = warc.record_bytes(5, "u", b"<p>x</p>" * 40, warc.payload_digest(b"<p>x</p>" * 40), None)
    dictionary = zstandard.train_dictionary(4096, [record + bytes([k]) * 50 for k in range(60)]).as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    frame = packer.compress(record)
    plain = struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary
    for head in (warc.leading_frame(dictionary), plain):
        found = list(warc.frames(memoryview(head + frame + frame)))
        assert [f[1] for f in found] == [record, record]
        assert [f[0] for f in found] == [len(head), len(head) + len(frame)]
    none = zstandard.ZstdCompressor().compress(record)
    assert [f[1] for f in warc.frames(memoryview(none))] == [record]
    assert list(warc.frames(memoryview(b""))) == []
    assert list(warc.frames(memoryview(plain + frame[:-3])))[-1][2] is not None
    broken = bytearray(frame)
    broken[-1] ^= 1
    assert list(warc.frames(memoryview(plain + bytes(broken))))[-1][2] is not None
    assert list(warc.frames(memoryview(plain[:100])))[0][2] == "the dictionary frame is cut off"
    assert warc.parse_record(record)[2] is None
    assert warc.parse_record(record[:-1])[2] == "content-length and block differ"
    assert warc.parse_record(b"junk")[2] == "no WARC header"
    assert warc.parse_record(record.replace(b"WARC-Date", b"X-Date"))[2] == "no warc-date"


def test_archives_need_a_file_system():
    with pytest.raises(ValueError):
        warc._local("s3a://bucket/x")
    assert warc._local("file:///tmp/x") == "/tmp/x"
