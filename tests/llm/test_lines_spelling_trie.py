"""Line rules, spelling variants and the conversation trie against brute force, and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from voxtrace.llm import spelling
from voxtrace.llm.conversation_trie import BalancedParentheses, conversation_trie
from voxtrace.llm.line_quality import QUALITY_COLUMNS, RULES, failed_rule, line_quality
from voxtrace.llm.spelling import near_words, roots, spelling_variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- lines


def brute_lines(text):
    """Counts of one text by the contract, without the operator's arrays."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": repeated,
        "n_repeat_words": len(covered),
        "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


PROSE = "The quick brown fox jumps over the lazy dog, and then it sleeps all day long in the warm sun."


def line_texts():
    rng = random.Random(5)
    texts = [None, "", " \n\t\r\n", "one", "é🙂 ß|x", PROSE, f"{PROSE}\n{PROSE}", "a b\x0bc\x0cd\r\ne."]
    texts.append("Home | About | Contact\n" + PROSE + "\n# # #\n" + "We use cookies on this site.\nHome\nno end here\n" + PROSE.upper())
    vocabulary = [f"w{k}" for k in range(12)] + ["#", "|", "$$", "end.", "why?", "no!"]
    for _ in range(40):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 14))) for _ in range(rng.randint(1, 9))]
        texts.append("\n".join(lines + rng.choices(lines, k=rng.randint(0, 2))))
    return texts


def test_line_counts_match_brute_force(spark):
    texts = line_texts()
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(None, PROSE, "x", 7), (3, PROSE, "y", 8)]
    # columns that the operator makes itself are not looked at
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = line_quality(docs)
    assert tuple(got.columns) == QUALITY_COLUMNS
    found = got.collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(by_id[3]) == 2 and len(by_id[None]) == 1
    for i, text in enumerate(texts):
        if i == 3:
            continue
        r = by_id[i][0]
        want = brute_lines(text)
        assert {c: r[c] for c in want} == want, text
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert r.n_lines == len(lines)
        # what is left and what is gone make up the text
        assert r.n_words_removed + len(WORD.findall(r.cleaned_text)) == r.n_words
        assert sum(r.rule_counts) == r.n_lines_removed
        assert r.kept == (not r.base_failed and 2 * r.n_words_removed <= r.n_words)


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("Home | About us | Contact", "navigation"),
        ("Menu", "navigation"),
        ("alpha beta &&& gamma ### delta.", "symbols"),
        ("Please read our Privacy Policy.", "boilerplate"),
        ("BUY!! NOW!! CHEAP", "shouting"),
        ("a line without an end", "punctuation"),
        ("It ends here.", None),
        ("He said: \"it ends.\"", None),
        ("It ended. And then it went on without", None),
        ("A 50 % share of one.", None),
    ],
)
def test_line_rules(line, rule):
    found = failed_rule(line, len(WORD.findall(line)), False)
    assert (RULES[found] if found >= 0 else None) == rule
    assert failed_rule("It was here before.", 4, True) == RULES.index("boilerplate")


def test_clean_documents_stay_and_lost_ones_go(spark):
    body = "\n".join(f"Sentence {k} tells something new about subject {k}x of the report." for k in range(60))
    junk = "\n".join(f"a{k} | b{k} | c{k}" for k in range(400))
    long = " ".join(f"word{k}" for k in range(200_000)) + "."
    docs = spark.createDataFrame([(1, body), (2, body + "\nHome | Next"), (3, body + "\n" + junk), (4, long)], "doc_id long, text string")
    found = {r.doc_id: r for r in line_quality(docs).collect()}
    assert found[1].kept and found[1].cleaned_text == body
    assert found[2].kept and found[2].cleaned_text == body
    assert not found[3].kept and not found[3].base_failed and found[3].cleaned_text == body
    assert found[4].kept and found[4].n_words == 200_000
    assert line_quality(docs.where("doc_id < 0")).count() == 0


# ---- spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def brute_spelling(rows):
    counts = {}
    for doc_id, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        last = w
        while form[last]:
            last = form[last]
        out.add((w, form[w], last, words[w], len(near[w]), words.get(form[w])))
    return out


def misspelt_texts(rng):
    letters = "abcdeé"
    base = ["".join(rng.choices(letters, k=rng.randint(7, 12))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "ÀÉàéñçü", "informatiön"]
    rows = []
    for i in range(160):
        own = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base[: rng.randint(1, len(base))])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            own.append(w.upper() if rng.random() < 0.05 and w.isascii() else w)
        rows.append((i, rng.choice([" ", "-", "\n"]).join(own)))
    return rows


@pytest.mark.parametrize("list_words", [spelling.LIST_WORDS, 4])
def test_spelling_variants_match_brute_force(spark, list_words):
    rows = misspelt_texts(random.Random(11)) + [(None, "abcdefgh " * 3), (7, None), (8, ""), (9, "seventh " * 5), (9, "seventh sevenths")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string")
    got = {tuple(r) for r in spelling_variants(docs, list_words).collect()}
    assert got == brute_spelling(rows)
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)


def test_spelling_of_long_runs_and_empty_tables(spark):
    long = "ab" * 30_000
    docs = spark.createDataFrame([(1, f"{long} {long} {long}x {long}x"), (2, "short")], "doc_id long, text string")
    assert {tuple(r) for r in spelling_variants(docs).collect()} == brute_spelling([(1, f"{long} {long} {long}x {long}x")])
    assert spelling_variants(docs.where("doc_id < 0")).count() == 0


def test_scan_of_sorted_lists():
    rng = random.Random(3)
    for trial in range(120):
        alphabet = "ab" if trial % 2 else "abcé"
        words = sorted(
            {"".join(rng.choices(alphabet, k=rng.randint(0, 7))).encode("latin-1") for _ in range(rng.randint(1, 60))}
        )
        group = np.zeros(len(words), int)
        if trial % 3 == 0:
            group[len(words) // 2 :] = 1
        length = np.array([len(w) for w in words])
        start = np.concatenate([[0], np.cumsum(length)])[:-1]
        a, b = spelling.scan(np.frombuffer(b"".join(words), np.uint8), start, length, group)
        want = {
            (i, j)
            for i in range(len(words))
            for j in range(len(words))
            if group[i] == group[j] and one_edit(words[i], words[j])
        }
        assert len(a) == len(want) and set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_long_lists_are_dealt_to_bounded_ones(spark):
    rng = random.Random(1)
    words = sorted({"prefix" + "".join(rng.choices("abcdef", k=5)) for _ in range(1500)})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    rows = spelling.lists(table, 100)
    assert rows.groupBy("list").count().agg({"count": "max"}).first()[0] <= 100
    got = {r.word: r.n_near for r in near_words(table, 100).collect()}
    by_word = {w: sum(one_edit(w, v) for v in words) for w in words}
    assert got == {w: k for w, k in by_word.items() if k}


def test_roots_follow_forms_to_the_end(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(9)] + [("x", "w4")]
    got = dict(roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert set(got.values()) == {"w9"} and len(got) == 10


# ---- trie


def brute_trie(rows):
    def order(r):
        role, text = r[2] or "", r[3] or ""
        digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        return (r[1] is not None, r[1] or 0, role, digest)

    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = set()
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        stops = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out.add(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                len(children.get(node, [])),
                sum(m not in children for m in below),
                sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
                hashlib.sha256(",".join(map(str, stops)).encode()).hexdigest(),
            )
        )
    return out


def conversation_rows(rng, count):
    texts = ["hello", "hé", "", None, "tell me more", "ok"]
    rows = []
    for c in rng.sample(range(4 * count), count):
        for t in range(rng.choice([0, 1, 2, 5, 9, 14])):
            common = rng.random() < 0.6
            rows.append((c, t, "user" if t % 2 else None, texts[t % 4] if common else rng.choice(texts)))
    rows += [(rows[0][0], None, "system", "first"), (rows[0][0], 1, "user", "tie"), rows[1], rows[1], (None, 0, "user", "lost")]
    rows += [(5000 + k, t, "user", f"same {t}") for k in range(40) for t in range(11)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("band", "shard_turns"), [(1 << 14, 1 << 17), (4, 1 << 17), (1 << 14, 7), (3, 5)])
def test_conversation_trie_matches_brute_force(spark, band, shard_turns):
    rows = conversation_rows(random.Random(band + shard_turns), 60)
    table = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, n_convs string"
    )
    got = [tuple(r) for r in conversation_trie(table, band, shard_turns).collect()]
    want = brute_trie(rows)
    assert len(got) == len(want) and set(got) == want


def test_trie_of_turnless_and_missing_conversations(spark):
    # the first of the family is absent, so what it would lend is missing
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in conversation_trie(table).collect()} == brute_trie(rows)
    assert conversation_trie(table.where("conv_id < 0")).count() == 0


def test_trie_of_a_very_long_conversation(spark):
    rows = [(10, t, "user", f"t{t}") for t in range(700)] + [(11, t, "user", f"t{t}") for t in range(650)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r[0], r[1]): r for r in conversation_trie(table, 256, 100).collect()}
    # 11 is a prefix of 10, so all of its nodes are shared
    assert len(got) == 701 and all(got[10, d].n_convs == (2 if d <= 650 else 1) for d in range(701))
    assert got[10, 0].saved_tokens == sum(len(f"t{t}") for t in range(650)) and got[10, 0].n_leaves == 1
    assert got[10, 650].ends_sha256 == hashlib.sha256(b"11").hexdigest()


def test_closing_parentheses():
    rng = np.random.default_rng(2)
    for size in (1, 3, 200, 5000, 40_000):
        bits, depth = [], 0
        for _ in range(size):
            up = depth == 0 or rng.random() < (0.9 if rng.random() < 0.5 and depth < 900 else 0.45)
            bits.append(up)
            depth += 1 if up else -1
        bits += [False] * depth
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        tree = BalancedParentheses(np.array(bits))
        assert tree.find_close(tree.opens).tolist() == [want[i] for i in tree.opens.tolist()]
