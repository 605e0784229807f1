"""Line-first cleaning: lines are judged one by one, then the document by what it has lost.

Every line with a word passes through rules in this order, and the first that fails removes it:

* ``navigation``: separators (``| > » · •``) take at least two places and a quarter of its words,
  or all of its words are one entry of a menu (``MENU``);
* ``symbols``: more than one of ``# * $ % & | < >`` to ten words, and at least two;
* ``boilerplate``: it holds a phrase of ``PHRASES``, letters of any case, or repeats an earlier
  line of at least three words;
* ``shouting``: more than one ``!`` or ``?`` to two words, and at least four;
* ``punctuation``: it neither ends in a terminal mark (closing quotes and brackets may follow)
  nor has the end of a sentence inside.

The lines left are the cleaned text. A document is rejected when the lines removed hold more than
``max_loss`` percent of its words, or when the counts of the whole text fail: fewer than 20
words, or more than 30 percent of them in windows of eight words that occur twice.

Defined results: null and empty texts have no words and are rejected, with an empty cleaned text;
a null id is carried along; rows that repeat an id are judged one by one; an empty table gives an
empty one; other columns are not looked at. A text of any length is judged whole, and a task holds
one such text and a few numbers for each of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtrace.llm.textblocks import (
    SECOND_BASE,
    SPACE,
    bounded_batches,
    chunks,
    mixed,
    span_hashes,
    text_buffers,
    word_hashes,
    word_spans,
)

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
MAX_LOSS = 50
RULES = ("navigation", "symbols", "boilerplate", "shouting", "punctuation")

#: Phrases of page furniture, in lower case.
PHRASES = (
    "accept all cookies",
    "we use cookies",
    "this site uses cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "enable javascript",
    "requires javascript",
    "subscribe to our newsletter",
    "sign up for our",
    "click here to",
    "skip to content",
    "skip to main",
    "back to top",
    "share this article",
    "follow us on",
    "powered by wordpress",
    "lorem ipsum",
)
#: Words that a line of a menu consists of, in lower case.
MENU = frozenset(
    "home menu about contact login logout search next previous prev share print "
    "sitemap faq help blog news archive archives".split()
)

BLANKS = " \t\n\v\f\r"
_word = re.compile(r"[^\x20\x09-\x0D]+")
_separator = re.compile(r"[|>»·•]")
_symbol = re.compile(r"[#*$%&|<>]")
_shout = re.compile(r"[!?]")
_phrase = re.compile("|".join(re.escape(p) for p in PHRASES))
_terminal = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*$")
_inside = re.compile(r"[.!?…。！？][\"'”’»)\]]*[\x20\x09-\x0D]")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_lines_removed long, n_words_removed long, rule_counts array<long>, cleaned_text string"
)
QUALITY_COLUMNS = (
    "doc_id",
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "kept",
    "n_lines",
    "n_lines_removed",
    "n_words_removed",
    "rule_counts",
    "cleaned_text",
)


def failed_rule(line: str, words: int, seen: bool) -> int:
    """Number (in ``RULES``) of the first rule that removes the line, or -1.

    ``seen``: an equal line came before.
    """
    separators = len(_separator.findall(line))
    lower = line.lower()
    if (separators >= 2 and 4 * separators >= words) or (
        words <= 12 and all(w.strip("|>»·•,/-") in MENU or not w.strip("|>»·•,/-") for w in lower.split())
    ):
        return 0
    symbols = len(_symbol.findall(line))
    if symbols >= 2 and 10 * symbols > words:
        return 1
    if (seen and words >= 3) or _phrase.search(lower):
        return 2
    shouts = len(_shout.findall(line))
    if shouts >= 4 and 2 * shouts > words:
        return 3
    if not _terminal.search(line.rstrip(BLANKS)) and not _inside.search(line):
        return 4
    return -1


def clean_lines(text: str) -> tuple[str, list[int]]:
    """Cleaned text, and (lines with a word, those equal to an earlier line, lines and words
    removed, lines removed by each rule)."""
    seen: set[str] = set()
    kept: list[str] = []
    lines = repeated = gone = gone_words = 0
    by_rule = [0] * len(RULES)
    for line in text.split("\n"):
        words = len(_word.findall(line))
        if not words:
            continue
        lines += 1
        again = line in seen
        repeated += again
        seen.add(line)
        rule = failed_rule(line, words, again)
        if rule < 0:
            kept.append(line)
        else:
            gone += 1
            gone_words += words
            by_rule[rule] += 1
    return "\n".join(kept), [lines, repeated, gone, gone_words, *by_rule]


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each document that lie in a window of ``width`` words which occurs twice in it.

    Windows are equal when two independent 64-bit hashes are.
    """
    n, docs = len(hashes), len(bounds) - 1
    found = np.zeros(docs, np.int64)
    if n < width:
        return found
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    at = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    key = mixed(span_hashes(hashes, at, at + width) ^ mixed(owner[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    equal = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    some = at[order[twice]]
    if not len(some):
        return found
    first, second = ranked[twice], span_hashes(hashes, some, some + width, SECOND_BASE)
    order = np.lexsort((second, first))
    first, second, some = first[order], second[order], some[order]
    equal = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    twice = np.zeros(len(some), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, some[twice], 1)
    np.add.at(edge, some[twice] + width, -1)
    covered = np.cumsum(edge)[:n] > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = np.zeros(256, bool)
    marks[[ord(c) for c in "#*$%&|<>"]] = True
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        texts = batch.column("text")
        for lo, hi in chunks(offsets):
            part = offsets[lo : hi + 1]
            own = data[part[0] : part[-1]]
            part = part - part[0]
            starts, ends, bounds = word_spans(own, part)
            repeats = repeated_words(word_hashes(own, starts, ends), bounds)
            points = np.concatenate([[0], np.cumsum(((own & 0xC0) != 0x80) & ~SPACE[own])])
            symbols = np.concatenate([[0], np.cumsum(marks[own])])
            cleaned, counts = [], []
            for text in texts.slice(lo, hi - lo).to_pylist():
                clean, count = clean_lines(text or "")
                cleaned.append(clean)
                counts.append(count)
            table = np.array(counts, np.int64).reshape(hi - lo, 4 + len(RULES))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array((points[part[1:]] - points[part[:-1]]).astype(np.int64)),
                    pa.array((symbols[part[1:]] - symbols[part[:-1]]).astype(np.int64)),
                    pa.array(table[:, 1]),
                    pa.array(repeats),
                    pa.array(table[:, 0]),
                    pa.array(table[:, 2]),
                    pa.array(table[:, 3]),
                    pa.array(table[:, 4:].tolist(), pa.list_(pa.int64())),
                    pa.array(cleaned, pa.string()),
                ],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )


def line_quality(documents: DataFrame, max_loss: int = MAX_LOSS) -> DataFrame:
    """``QUALITY_COLUMNS`` for each row of ``documents`` (doc_id, text).

    ``rule_counts`` holds the lines removed by each of ``RULES``; ``cleaned_text`` the lines left.
    """
    documents = bounded_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    judged = documents.mapInArrow(_judge, SCHEMA)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    lost = 100 * F.col("n_words_removed") > max_loss * F.col("n_words")
    return (
        judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost).select(*QUALITY_COLUMNS)
    )
