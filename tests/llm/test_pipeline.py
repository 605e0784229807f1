"""The pipeline's stages, each against a brute-force version on its own input."""

import collections

from pyspark.sql import functions as F
from test_duplicates import brute_components, words
from test_vectors_sources_archives import targets

import corpus_pipeline as pipeline
from voxtrace.llm.packing import CAPACITY, encoding
from voxtrace.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept_words(rows, width=50):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, t in rows:
        w = words(t)
        stays = [True] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                stays[k : k + width] = [False] * width
        kept = [x.decode() for x, s in zip(w, stays, strict=True) if s]
        if all(stays):
            out[i] = t
        elif kept:
            out[i] = " ".join(kept)
    return out


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "mix", "pack"]
    stages = dict(pipeline.STAGES)

    first = stage(stages["toxicity"](spark, docs, sf_dir), "test")
    assert first.columns == COLUMNS
    before, after = docs.collect(), first.collect()
    kept = {r["doc_id"] for r in after}
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert len(toxic - kept) >= 0.7 * len(toxic)
    clean = {r["doc_id"] for r in before} - toxic
    assert len(clean & kept) >= 0.95 * len(clean)

    second = stage(stages["near_dedup"](spark, first, sf_dir), "test")
    roots = brute_components([(r["doc_id"], r["text"]) for r in after], 5, 80)
    assert second.columns == COLUMNS
    assert {r["doc_id"] for r in second.collect()} == {i for i, root in roots.items() if i == root}

    third = stage(stages["substring_dedup"](spark, second, sf_dir), "test")
    assert third.columns == COLUMNS
    want = kept_words([(r["doc_id"], r["text"]) for r in second.collect()])
    found = third.collect()
    assert {r["doc_id"]: r["text"] for r in found} == want
    changed = {r["doc_id"]: r["n_chars"] for r in found if r["text"] != dict(second.select("doc_id", "text").collect())[r["doc_id"]]}
    assert all(n == len(want[i]) for i, n in changed.items())

    fourth = stage(stages["mix"](spark, third, sf_dir), "test")
    assert fourth.columns == COLUMNS
    size = {r["doc_id"]: len(words(r["text"])) for r in found}
    source = {r["doc_id"]: r["source"] for r in found}
    whole, taken = collections.Counter(), collections.Counter()
    for i, n in size.items():
        whole[source[i]] += n
    times = collections.Counter(r["doc_id"] for r in fourth.collect())
    for i, n in times.items():
        assert n <= 3
        taken[source[i]] += n * size[i]
    for s, target in targets(whole).items():
        assert abs(target - taken[s]) <= 0.15 * target + 5

    packed = stages["pack"](spark, fourth, sf_dir).collect()
    encode = encoding().encode_ordinary
    ids = {r["doc_id"]: len(encode(r["text"] or "")) + 1 for r in found}
    tokens = collections.Counter()
    places = collections.defaultdict(list)
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert tokens == {i: n * ids[i] for i, n in times.items()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= CAPACITY


def test_stages_take_other_columns_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 30")
    odd = docs.withColumn("size", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("score", F.lit(0.1))
    odd = odd.withColumn("shard", F.lit(1)).withColumn("source_no", F.lit(2)).withColumn("kept_text", F.lit("y"))
    for _, function in pipeline.STAGES[:-1]:
        out = function(spark, odd, sf_dir)
        assert out.columns == odd.columns and out.count() > 0
        assert function(spark, odd.where("false"), sf_dir).count() == 0
    assert pipeline.STAGES[-1][1](spark, odd.where("false"), sf_dir).count() == 0
