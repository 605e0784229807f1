"""Toxicity, licenses, context tree, packing: brute force and edge cases."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from voxtrace.llm import context_tree
from voxtrace.llm.context_tree import DEPTH, _decisions, _estimate, fit_context_tree, score_texts, training_counts
from voxtrace.llm.licenses import TEMPLATES, compile_template, scan_licenses, words_of
from voxtrace.llm.packing import pack, pack_plan, pieces
from voxtrace.llm.toxicity import fit_toxicity, toxicity_score

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ODD = [
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "word"),
    (4, "É È ünï code \U0001f600 <|endoftext|>"),
    (5, "same text twice here"),
    (5, "same text twice here"),
    (None, "a row without an id"),
    (6, "x" * 50_000),
    (7, "long " * 20_000),
]
CLASHING = "doc_id long, text string, score double, size int, row string, length string, n_words string, labels string"


def odd_documents(spark):
    return spark.createDataFrame([(i, t, 0.5, 1, "r", "l", "w", "x") for i, t in ODD], CLASHING)


def empty_documents(spark):
    return spark.createDataFrame([], CLASHING)


# -- toxicity


def labelled(spark, n=240):
    rng = np.random.default_rng(3)
    words = ["river", "stone", "green", "walk", "idle", "moon", "bread", "light"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, 30))
        toxic = int(i % 4 == 0)
        rows.append((i, text + " zorgblat" if toxic else text, toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2], 1) for r in rows], "doc_id long, toxic int, quality int")


def test_toxicity_learns_and_scores_odd_rows(spark):
    docs, labels = labelled(spark)
    train, rest = labels.where("doc_id < 180"), labels.where("doc_id >= 180")
    model = fit_toxicity(docs, train)
    scored = docs.withColumn("s", toxicity_score(model, docs["text"])).join(rest, "doc_id").collect()
    assert all((r["s"] >= 0.5) == bool(r["toxic"]) for r in scored)
    odd = odd_documents(spark)
    rows = odd.withColumn("s", toxicity_score(model, odd["text"])).collect()
    assert len(rows) == len(ODD) and all(0 <= r["s"] <= 1 for r in rows)
    by_text = {r["text"]: r["s"] for r in rows}
    assert by_text[None] == by_text[""] == by_text[" \n\t "] < 0.5


def test_toxicity_without_usable_labels(spark):
    docs, labels = labelled(spark, 20)
    for some in (labels.where("false"), labels.where("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) toxic")):
        model = fit_toxicity(docs, some)
        assert docs.withColumn("s", toxicity_score(model, docs["text"])).where("s >= 0.5").isEmpty()
    none = empty_documents(spark)
    model = fit_toxicity(none, labels)
    assert none.select(toxicity_score(model, none["text"])).count() == 0


# -- licenses


def base_of(text):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    words = words_of(text or "")
    found = []
    for phrase, label in phrases.items():
        want = words_of(phrase)
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    starts = [i for i, _ in found]
    return (
        len(words),
        len(found),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({label for _, label in found})),
    )


def test_licenses_against_brute_force(spark):
    texts = [
        "Licensed under CC BY-NC 4.0. All rights reserved. all RIGHTS, reserved",
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public Licence, version 3.",
        "cc by cc by", "general public", "public license general public license",
        "Copyright (c) 2021 Some Body. All rights reserved.", "Copyright 2021 All rights reserved",
        "x " * 3000 + "Released under the MIT License", "Licensed under the Apache License, Version 2.0 (the License)",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + ODD, "doc_id long, text string")
    got = sorted(map(tuple, scan_licenses(docs).select("n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str)
    assert got == sorted((base_of(t) for t in [*texts, *(t for _, t in ODD)]), key=str)
    labels = {r["doc_id"]: r for r in scan_licenses(docs.where("text is not null and length(text) > 9")).collect()}
    assert "GPL-3.0" in labels[1]["labels"] and labels[1]["score"] == 1.0
    assert scan_licenses(spark.createDataFrame([(1, texts[2])], "doc_id long, text string")).first()["labels"] == ""
    assert scan_licenses(empty_documents(spark)).count() == 0
    assert scan_licenses(odd_documents(spark)).count() == len(ODD)


def test_template_automaton():
    made = compile_template('one <<beginOptional>>two <<endOptional>>three <<var;name="x";match=".{1,2}">> end <<var;name="y";match="[0-9]+">>')
    assert made.accepts_from(words_of("one three x end 7")) == 5
    assert made.accepts_from(words_of("ONE, two; three x y end 42 more")) == 7
    assert made.accepts_from(words_of("one two two three x end 7")) == 0
    assert made.accepts_from(words_of("one three end 7")) == 0
    assert made.accepts_from(words_of("one three x end y")) == 0
    for bad in ("<<beginOptional>>a<<endOptional>>", "a <<beginOptional>> b", "a <<endOptional>>", "<<what>> a"):
        with pytest.raises(ValueError):
            compile_template(bad).first_words()


def test_altered_licenses_are_rejected(spark):
    def plain(label):  # the template with all optional parts and one word for each region
        return re.sub(r"<<.*?>>", " ", re.sub(r"<<var.*?>>", " something ", TEMPLATES[label]))

    whole = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "GPL-2.0", "Apache-2.0"]
    rows = [(label, plain(label)) for label in whole]
    rows += [(f"cut {label}", plain(label)[: len(plain(label)) // 2]) for label in whole]
    rows.append(("restricted MIT", plain("MIT").replace("subject to", "for non-commercial use only, subject to")))
    rows.append(("restricted BSD", plain("BSD-3-Clause").replace("Neither", "No military use. Neither")))
    rows.append(("FSF", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                 "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"))
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in scan_licenses(docs).collect()}
    for label in whole:
        assert label in got[label] and not got[label] & (set(whole) - {label})
        assert not got[f"cut {label}"] & set(whole)
    assert not got["restricted MIT"] and not got["restricted BSD"]
    assert got["FSF"] == {"GPL-3.0-grant"}


# -- context tree


def test_word_scores_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choice(words, 1 + i % 30)) + ("\n\nOnce" if i % 3 else "")) for i in range(120)] + ODD
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")

    def tokens(t):
        return [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)), b"\0end"]

    def out(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2

    seen = collections.Counter(x for i, t in rows if not out(i) for x in tokens(t))
    total, kinds = sum(seen.values()), len(seen)
    want = sorted(
        (len(tokens(t)), sum(seen[x] > 0 for x in tokens(t)), out(i),
         round(sum(math.log10((seen[x] + 1) / (total + kinds + 1)) for x in tokens(t)), 6))
        for i, t in rows
    )
    found = score_texts(docs).collect()
    got = sorted((r["n_tokens"], r["n_known"], r["held_out"], round(r["base_score"], 6)) for r in found)
    assert got == want
    assert {r["train_tokens"] for r in found} == {total}
    assert all(r["score"] < 0 for r in found)
    assert score_texts(empty_documents(spark)).count() == 0
    alone = score_texts(docs.where("doc_id = 12")) if out(12) else score_texts(docs.where("doc_id = 2"))
    assert all(np.isfinite(r["score"]) for r in alone.collect())


def weighted(tree, node, context, byte_counts, depth):
    """Context-tree weighting by recursion: log weighted probability of one decision's counts."""
    own = _estimate(byte_counts(context)[None])[0]
    if depth == DEPTH or not tree.get(context):
        return own
    rest = byte_counts(context) - sum(byte_counts(c) for c in tree[context])
    below = sum(weighted(tree, node, c, byte_counts, depth + 1) for c in tree[context]) + _estimate(rest[None])[0]
    return np.logaddexp(own, below) - np.log(2)


def test_context_tree_is_a_distribution_and_mixes_by_weight(spark):
    docs = spark.createDataFrame([(i, "abracadabra abba " * 5) for i in range(20)], "doc_id long, text string")
    counts = training_counts(docs)
    tree = fit_context_tree(counts, share=2.0**-6)
    assert np.allclose((10.0 ** tree.table.astype(float)).sum(1), 1, atol=1e-5)
    # the weight of the root, by recursion over the same tree
    grams = {r["key"]: r["n"] for r in counts.where("not is_token").collect()}

    def symbols(context):
        out = np.zeros(256)
        for key, n in grams.items():
            back = tuple((key >> 8 * k) & 255 for k in range(1, len(context) + 1))
            if back == context:
                out[key & 255] += n
        return out

    kept = {()}
    for depth, codes in enumerate(tree.contexts, 1):
        kept |= {tuple((int(c) >> 8 * k) & 255 for k in range(depth)) for c in codes}
    below = collections.defaultdict(list)
    for c in kept - {()}:
        below[c[:-1]].append(c)
    decision = 1  # the first bit of a byte
    first = {c: _decisions(symbols(c))[decision] for c in kept}

    def predict(context):
        n = first[context]
        own = (n + 0.5) / (n.sum() + 1)
        return n, own

    def mix(context, path):
        n, own = predict(context)
        if not below[context]:
            return own
        total = weighted(below, decision, context, lambda c: first[c], len(context))
        stay = np.exp(_estimate(n[None])[0] - np.log(2) - total)
        child = context + path[len(context) : len(context) + 1]
        if child in kept:
            deeper = mix(child, path)
        else:
            rest = n - sum(first[c] for c in below[context])
            deeper = (rest + 0.5) / (rest.sum() + 1)
        return stay * own + (1 - stay) * deeper

    table = 10.0 ** tree.table.astype(float)
    number = 1
    for depth, codes in enumerate(tree.contexts, 1):
        for k, code in enumerate(codes):
            path = tuple((int(code) >> 8 * j) & 255 for j in range(depth))
            got = table[number + k, :128].sum()  # first bit 0
            want = mix((), path + (300,))[0]
            assert abs(got - want) < 1e-5
        number += len(codes)


def test_scores_keep_every_context_that_occurs_twice(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "FREQUENT_GRAM", 2.0**-9)  # so that many grams are joined
    monkeypatch.setattr(context_tree, "TASK_GRAMS", 500)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé "), 6)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words, 1 + i % 25))) for i in range(150)] + [(150, None), (151, "")]
    rows.append((152, "unseen \u4e2d\u6587 wording"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = training_counts(spark.createDataFrame(training, "doc_id long, text string"))
    total = sum(len((t or "").encode()) + 1 for _, t in training)
    tree = fit_context_tree(counts, share=2 / total)
    assert len(tree.contexts[-1]) > 500
    raw = [(t or "").encode() for _, t in rows]
    offsets = np.cumsum([0, *map(len, raw)])
    want = context_tree.text_scores(tree, tree.children(), np.frombuffer(b"".join(raw), np.uint8), offsets)
    got = {r["doc_id"]: r["score"] for r in score_texts(docs).collect()}
    assert np.allclose([got[i] for i, _ in rows], want, rtol=1e-4)


# -- packing


def test_pieces_follow_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = odd_documents(spark).where("doc_id is null or doc_id <> 5")
    found = pack(pieces(docs, capacity=64), capacity=64).collect()
    for i, text in ODD:
        if i == 5:
            continue
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 64 for r in own[1:])
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    by_sequence = collections.defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_added_token_is_one_id(spark):
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n\n y ", "<|endoftext|", "é<|endoftext|>'s 12", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces(docs, specials=True).collect():
        ids = np.array([*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_packing_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "same words")] * 7, "doc_id long, text string")
    rows = pack(pieces(docs)).collect()
    assert len(rows) == 7 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 7
    assert pack(pieces(empty_documents(spark))).count() == 0


def test_pack_plan_places_every_piece_once():
    rng = np.random.default_rng(11)
    for capacity in (7, 30, 100):
        for _ in range(20):
            sizes = rng.integers(1, capacity + 1, rng.integers(1, 300))
            histogram = collections.Counter(map(int, sizes))
            plan = pack_plan(histogram, capacity)
            filled = collections.defaultdict(list)
            for size, part in plan.groupby("length"):
                part = part.sort_values("first").reset_index(drop=True)
                for number in range(histogram[size]):
                    row = part[part["first"] <= number].iloc[-1]
                    along = number - row["first"]
                    filled[row["sequence"] + along // row["per"]].append((row["offset"] + along % row["per"] * size, size))
            assert sum(map(len, filled.values())) == len(sizes)
            for places in filled.values():
                at = 0
                for offset, size in sorted(places):
                    assert offset == at
                    at += size
                assert at <= capacity
            assert len(filled) <= 1.3 * sizes.sum() / capacity + 2 or (2 * sizes > capacity).sum() >= 0.5 * len(filled)
