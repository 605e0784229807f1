"""License scans: fixed phrases, and license wording given as templates with markup.

A template is text with optional regions, ``<<beginOptional>> ... <<endOptional>>``, and
replaceable ones, ``<<var;name="...";match="...">>``. ``match=".{a,b}"`` stands for a to b words
of any kind; any other pattern must match one word whole. Texts are lower-cased (A-Z) words of
letters, digits and characters beyond ASCII, so punctuation and line breaks never matter.

Templates are compiled to token automata. A text carries the template's label if, from some
word on, an automaton accepts: all mandatory words stand in order, unchanged, with nothing
between them but what the regions allow.

Defined results: a null text is empty and has no words; places of a phrase may overlap those of
another; score is 1 where a template matches, 0.5 where only a phrase stands, else 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxtrace.llm.textblocks import LOWER, bounded_batches, chunks, text_buffers, word_hashes, word_spans

# fixed values: the phrases of the contract
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_GRANT = (
    'you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the '
    'Free Software Foundation; either version {version} of the License'
)
_GPL = (
    '<<beginOptional>>This <<var;name="work";match=".{{1,3}}">> is <<endOptional>>free software<<beginOptional>>, '
    "and<<endOptional>> " + _GRANT + ', or (at your option) any later version. <<beginOptional>>This <<endOptional>>'
    '<<var;name="work";match=".{{1,3}}">> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; '
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
    "Public License for more details. You should have received a copy of the GNU General Public License along with "
    '<<var;name="work";match=".{{1,3}}">><<beginOptional>>; if not, <<endOptional>><<beginOptional>>see '
    "<<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>> www.gnu.org/licenses<<endOptional>>"
    "<<beginOptional>>write to the Free Software Foundation, Inc.<<endOptional>>"
)
_SHORT_GPL = (
    '<<beginOptional>>This <<var;name="work";match=".{{1,3}}">> is <<endOptional>>licensed under the '
    "<<beginOptional>>terms of the <<endOptional>>GNU General Public License<<beginOptional>> as published by the "
    "Free Software Foundation<<endOptional>><<beginOptional>>; either<<endOptional>>, version {version}"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. {third}"
    'THIS SOFTWARE IS PROVIDED BY <<var;name="holder";match=".{{1,10}}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    'DISCLAIMED. IN NO EVENT SHALL <<var;name="holder";match=".{{1,10}}">> BE LIABLE FOR ANY DIRECT, INDIRECT, '
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
_THIRD = (
    '<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="holder";match=".{1,10}">> nor the names of its '
    "contributors may be used to endorse or promote products derived from this software without specific prior written "
    "permission. "
)

#: Whole texts of common licenses and license notices, with the parts that may vary marked up.
#: One-line notices that name a license, and grants without the rest, have labels of their own.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at <<beginOptional>>http<<endOptional>>"
    "<<beginOptional>>https<<endOptional>> www.apache.org/licenses/LICENSE-2.0<<beginOptional>>.txt<<endOptional>> "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
    "the specific language governing permissions and limitations under the License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": _GPL.format(version=3),
    "GPL-2.0": _GPL.format(version=2),
    "GPL-3.0-grant": _GRANT.format(version=3),
    "GPL-2.0-grant": _GRANT.format(version=2),
    "GPL-3.0-notice": _SHORT_GPL.format(version=3),
    "GPL-2.0-notice": _SHORT_GPL.format(version=2),
    "MIT-notice": "<<beginOptional>>Released <<endOptional>>under the MIT License",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of "
    '<<var;name="software";match=".{1,8}">> to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) "
    "<<endOptional>>shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    '<<var;name="holder";match=".{1,8}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF '
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE",
    "BSD-2-Clause": _BSD.format(third=""),
    "BSD-3-Clause": _BSD.format(third=_THIRD),
    "CC-BY": 'Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons '
    '<<endOptional>>CC BY <<var;name="version";match="[1-4]">><<beginOptional>>.0<<endOptional>>',
    "CC-BY-NC": 'Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons '
    '<<endOptional>>CC BY-NC <<var;name="version";match="[1-4]">><<beginOptional>>.0<<endOptional>>',
    "CC-BY-SA": 'Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons '
    '<<endOptional>>CC BY-SA <<var;name="version";match="[1-4]">><<beginOptional>>.0<<endOptional>>',
    "copyright-notice": 'Copyright <<beginOptional>>(c) <<endOptional>><<var;name="year";match="[0-9]{4}">> '
    '<<var;name="holder";match=".{1,8}">> All rights reserved',
}

OUTSIDE = np.ones(256, bool)
OUTSIDE[48:58] = OUTSIDE[97:123] = OUTSIDE[128:] = False
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(.*?)>>", re.S)
_ANY = re.compile(r"\.\{(\d+),(\d+)\}")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


@dataclass
class Automaton:
    """Token automaton: for each state the moves (word, pattern or None for any word; next state)
    and the moves without a word. State 0 starts; ``final`` accepts."""

    moves: list[list[tuple[object, int]]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    final: int = 0

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.free[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    def first_words(self) -> set[bytes]:
        """Words a match can begin with; a match may not begin with a replaceable region."""
        first = {what for s in self.closure({0}) for what, _ in self.moves[s]}
        if not all(isinstance(w, bytes) for w in first):
            raise ValueError("a template must begin with wording")
        return first

    def accepts_from(self, words: Iterable[bytes]) -> int:
        """Number of leading words in the longest match; 0 if there is none."""
        now, best = self.closure({0}), 0
        for n, word in enumerate(words, 1):
            after = set()
            for s in now:
                for what, nxt in self.moves[s]:
                    if what is None or what == word or (isinstance(what, re.Pattern) and what.fullmatch(word)):
                        after.add(nxt)
            if not after:
                break
            now = self.closure(after)
            if self.final in now:
                best = n
        return best


def compile_template(template: str) -> Automaton:
    """The automaton of a template with markup."""
    made = Automaton()
    here, opened = 0, []
    for k, part in enumerate(_MARK.split(template)):
        if k % 2 == 0:
            for word in words_of(part):
                nxt = made.state()
                made.moves[here].append((word, nxt))
                here = nxt
        elif part.startswith("beginOptional"):
            opened.append(here)
        elif part.startswith("endOptional"):
            if not opened:
                raise ValueError("an optional region ends that never began")
            nxt = made.state()
            made.free[here].append(nxt)
            made.free[opened.pop()].append(nxt)
            here = nxt
        else:
            match = re.search(r'match="(.*?)"', part)
            if not part.startswith("var") or not match:
                raise ValueError(f"unknown markup: {part}")
            counted = _ANY.fullmatch(match[1])
            low, high = (int(counted[1]), int(counted[2])) if counted else (1, 1)
            what = None if counted else re.compile(match[1].encode())
            end = made.state()
            for n in range(high):
                if n >= low:
                    made.free[here].append(end)
                nxt = made.state()
                made.moves[here].append((what, nxt))
                here = nxt
            made.free[here].append(end)
            here = end
    if opened:
        raise ValueError("an optional region does not end")
    made.final = here
    if made.final in made.closure({0}):
        raise ValueError("a template must have mandatory wording")
    return made


def _hash_words(words: list[bytes]) -> np.ndarray:
    joined = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return word_hashes(joined, ends - [len(w) for w in words], ends)


def scan_licenses(
    documents: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    spans (label, first word, number of words of every template match)."""
    documents = bounded_batches(documents.select("doc_id", "text"))
    automata = {label: compile_template(text) for label, text in templates.items()}
    firsts = {label: a.first_words() for label, a in automata.items()}
    split = {phrase: words_of(phrase) for phrase in phrases}
    vocabulary = sorted({w for ws in split.values() for w in ws} | {w for ws in firsts.values() for w in ws})
    number = {w: k for k, w in enumerate(vocabulary, 1)}
    hashes = _hash_words(vocabulary)
    order = np.argsort(hashes)
    schema = (
        f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, "
        "last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first:long,words:long>>"
    )
    most = {label: len(a.moves) for label, a in automata.items()}  # a match takes a state for each word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
        table = np.zeros(1 << 16, bool)
        table[(hashes & np.uint64(0xFFFF)).astype(int)] = True
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                own = LOWER[data[part[0] : part[-1]]]
                starts, ends, bounds = word_spans(own, part - part[0], OUTSIDE)
                keys = word_hashes(own, starts, ends)
                ids = np.zeros(len(keys) + 8, np.int32)
                maybe = np.flatnonzero(table[(keys & np.uint64(0xFFFF)).astype(int)])
                at = np.minimum(np.searchsorted(hashes[order], keys[maybe]), len(order) - 1)
                good = hashes[order][at] == keys[maybe]
                ids[maybe[good]] = order[at[good]] + 1
                doc_end = np.repeat(bounds[1:], np.diff(bounds))
                found: list[tuple[int, str]] = []
                for phrase, label in phrases.items():
                    sequence = [number[w] for w in split[phrase]]
                    begin = np.flatnonzero(ids[: len(keys)] == sequence[0])
                    for k, want in enumerate(sequence[1:], 1):
                        begin = begin[ids[begin + k] == want]
                    begin = begin[begin + len(sequence) <= doc_end[begin]]
                    found += [(int(b), label) for b in begin]
                found.sort()
                raw = own.tobytes()
                matches: list[tuple[int, str, int]] = []
                for label, automaton in automata.items():
                    begin = np.flatnonzero(np.isin(ids[: len(keys)], [number[w] for w in firsts[label]]))
                    for b in begin.tolist():
                        stop = min(int(doc_end[b]), b + most[label])
                        words = (raw[starts[k] : ends[k]] for k in range(b, stop))
                        length = automaton.accepts_from(words)
                        if length:
                            matches.append((b, label, length))
                matches.sort()
                places = np.searchsorted([b for b, _ in found], bounds) if found else np.zeros(len(bounds), int)
                fits = np.searchsorted([m[0] for m in matches], bounds) if matches else np.zeros(len(bounds), int)
                for d in range(hi - lo):
                    base = found[places[d] : places[d + 1]]
                    own_matches = matches[fits[d] : fits[d + 1]]
                    names = {label for _, label in base}
                    out["n_words"].append(int(bounds[d + 1] - bounds[d]))
                    out["n_base"].append(len(base))
                    out["first_word"].append(base[0][0] - int(bounds[d]) if base else None)
                    out["last_word"].append(base[-1][0] - int(bounds[d]) if base else None)
                    out["base_labels"].append(",".join(sorted(names)))
                    out["labels"].append(",".join(sorted(names | {label for _, label, _ in own_matches})))
                    out["score"].append(1.0 if own_matches else 0.5 if base else 0.0)
                    out["spans"].append([{"label": label, "first": b - int(bounds[d]), "words": n} for b, label, n in own_matches])
            whole = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), whole, strict=True))],
                ["doc_id", *out],
            )

    return documents.mapInArrow(run, schema)
