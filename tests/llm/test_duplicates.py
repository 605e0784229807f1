"""Near-duplicate components and repeated windows against brute force, and edge cases."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from voxtrace.llm import neardup
from voxtrace.llm.neardup import near_duplicates
from voxtrace.llm.substring import COVERS, kept_digest, remove_repeats
from voxtrace.llm.textblocks import set_aside

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text, lower=False):
    raw = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", raw.translate(LOWER) if lower else raw)


def variants(rng, count, length, edits):
    """Texts in families: copies of a base with some words replaced."""
    vocabulary = [f"w{k}" for k in range(3000)]
    out = []
    while len(out) < count:
        base = list(rng.choice(vocabulary, length))
        for _ in range(int(rng.integers(1, 9))):
            own = list(base)
            for k in rng.integers(0, length, int(rng.integers(0, edits + 1))):
                own[k] = rng.choice(vocabulary)
            out.append(" ".join(own))
    return out[:count]


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words(t, True)
        own = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(own)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            for p in sets[a]:
                for q in sets[b]:
                    if p and q and 100 * len(p & q) >= percent * len(p | q):
                        low, high = sorted((find(a), find(b)))
                        root[high] = low
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(
    ("width", "percent", "rounds", "dense", "block"),
    [(3, 85, 2, 4, 512), (5, 80, 2, 4, 512), (5, 80, 0, 4, 3), (3, 85, 0, 0, 3)],
)
def test_components_against_all_pairs(spark, monkeypatch, width, percent, rounds, dense, block):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "DENSE", dense)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(width)
    texts = variants(rng, 150, 90, 6) + variants(rng, 30, 12, 1)
    texts += ["", " \n", None, "one", "ONE", "two words", texts[0].upper(), texts[3] + "  \t"]
    # a chain: neighbours are linked, the ends are not
    chain = [f"c{k}" for k in range(100)]
    for step in range(12):
        texts.append(" ".join(chain[:2] + [f"s{k}" for k in range(step)] + chain[2 + step :]))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    docs = spark.createDataFrame([(*r, True, 3) for r in rows], "doc_id long, text string, kept boolean, n_shingles int")
    got = near_duplicates(docs, width, percent).collect()
    want = brute_components(rows, width, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sum(r["n_shingles"] == 0 for r in got) == 3


def test_components_of_odd_tables(spark):
    schema = "doc_id long, text string, bucket long"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f", 1), (7, "a b c d e f", 1), (7, "a b c d e f", 1), (9, "a b c d e f", 1), (3, "word " * 30_000, 1), (4, "word " * 40_000, 1)]
    got = near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [
        (-1, -1, True), (3, 3, True), (4, 3, False), (7, 7, True), (7, 7, True), (9, 7, False)
    ]


def test_ids_with_several_texts_hang_together(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (9, a + " x"), (12, b + " y"), (20, c), (21, c), (5, ""), (20, c), (30, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert len(got) == len(rows)
    assert found == {5: {5}, 9: {5}, 12: {5}, 20: {20}, 21: {20}, 30: {30}}


@pytest.mark.parametrize("n", [1, 2, 3, 6, 20])
def test_blocks_pass_on_no_more_rows_than_they_have_members(n):
    # n classes of the main component and n others, all alike by their registers: n * n likely pairs
    registers = np.full(neardup.REGISTERS, 7, np.uint8).tobytes()
    side = np.repeat([0, 1], n).astype(np.int32)
    ids = np.arange(2 * n, dtype=np.int64)
    fixed = {c: np.full(2 * n, v) for c, v in (("bucket", 5), ("main", 99), ("n_shingles", 50))}
    narrow = {c: np.zeros(2 * n, np.int32) for c in ("i", "j", "band")}
    table = pa.table(
        {**fixed, **narrow, "side": side, "id": ids, "component": np.where(side == 1, 99, ids), "registers": [registers] * (2 * n)}
    )
    got = neardup._likely_in_blocks(table, 7, 85, 0.7, neardup.DENSE).to_pylist()
    assert len(got) <= 2 * n
    assert {x for r in got for x in ([r["id"]] if r["a"] is None else [r["a"], r["b"]])} == set(range(2 * n))


def test_components_grow_by_links_as_if_made_anew(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    table = lambda part: spark.createDataFrame(part, "a long, b long")
    grown = neardup.connected(table(links[:100]), "test_rounds")
    grown = neardup.merged(grown, table(links[100:180]), "test_rounds")
    grown = neardup.merged(grown, table(links[180:]), "test_rounds")
    want = neardup.connected(table(links), "test_rounds")
    own = {r["id"]: r["component"] for r in want.collect()}
    got = {r["id"]: r["component"] for r in grown.collect()}
    assert grown.count() == len(got)
    assert {i: got.get(i, i) for i in own} == own


def test_rounds_go_over_new_links_only(spark, monkeypatch):
    table = lambda part: spark.createDataFrame(part, "a long, b long")
    rounds, real = [], neardup.connected
    monkeypatch.setattr(neardup, "connected", lambda links, name: rounds.append(links.count()) or real(links, name))
    whole = real(table([(k, k + 1) for k in range(0, 200, 2)]), "test_rounds")
    grown = neardup.merged(whole, table([(1, 3), (0, 2), (5, 4)]), "test_rounds")
    assert rounds == [1]  # two of the links join the same components, one joins none
    assert {r["id"]: r["component"] for r in grown.where("id < 6").collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4}


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for common, only in ((900, 50), (500, 500), (100, 900)):
        a, b = pool[: common + only], np.concatenate([pool[:common], pool[2000 : 2000 + only]])
        got = neardup.jaccard_estimate(
            neardup.registers(a)[None], neardup.registers(b)[None], np.array([float(len(a))]), np.array([float(len(b))])
        )[0]
        assert abs(got - common / (common + 2 * only)) < 0.1
        both = np.maximum(neardup.registers(a), neardup.registers(b))
        assert (both == neardup.registers(np.concatenate([a, b]))).all()  # mergeable


def brute_kept(rows, width=50):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for i, t in rows:
        w = words(t)
        stays = [True] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and least.get(tuple(w[k : k + width]), i) < i:
                stays[k : k + width] = [False] * width
        kept = b" ".join(x for x, s in zip(w, stays, strict=True) if s)
        out.append((-1 if i is None else i, len(w), stays.count(False), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digest_rows(docs, width=50):
    return sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])
        for r in kept_digest(remove_repeats(docs, width)).collect()
    )


@pytest.mark.parametrize("width", [50, 12, 1])
def test_repeated_windows_against_brute_force(spark, width):
    rng = np.random.default_rng(width)
    vocabulary = [f"w{k}" for k in range(400)]
    passages = [list(rng.choice(vocabulary, n)) for n in (49, 50, 51, 60, 75, 80, 81, 130)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(int(rng.integers(0, 4))):
            text += list(rng.choice(vocabulary, int(rng.integers(0, 70))))
            text += passages[int(rng.integers(len(passages)))]
        rows.append((int(i), " ".join(text) + "\n" * (i % 3)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, "tick " * 300), (103, "tick " * 120), (104, "tick tock " * 60)]
    rows += [(None, rows[5][1]), (105, None), (106, ""), (107, " \t"), (108, rows[7][1]), (108, rows[7][1]), (109, "É " * 51), (110, "É " * 50)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, extra int")
    assert digest_rows(docs, width) == brute_kept(rows, width)


def test_hot_passages_and_empty_tables(spark, monkeypatch):
    from voxtrace.llm import substring

    monkeypatch.setattr(substring, "SAMPLED", 1)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest_rows(docs) == brute_kept(rows)
    none = spark.createDataFrame([], "doc_id long, text string, n_words int")
    none, back = set_aside(none, substring.REPEAT_COLUMNS)
    assert remove_repeats(none).count() == 0 and back(none).columns == ["doc_id", "text", "n_words"]


def test_covers_hold_every_difference():
    for period, places in COVERS.items():
        assert {(a - b) % period for a in places for b in places} == set(range(period))
