"""License scans: phrases at exact places, and an exact set-similarity join of text blocks with license templates.

The join: tokens of a template are ordered from rare to frequent, by counts over the
whole corpus.  A block that holds at least the share ``threshold`` of a template's
tokens holds one of the template's first ``size - need + 1`` tokens (prefix filter), has
at least ``need`` words (length filter), and when its first match is the template's
token number i, at most ``size - i`` tokens can match (positional filter).  What passes
all three is compared as sets.

With ``notices`` the join names licenses: templates must be met with the words that tell
them apart, also across lines, and only the best of similar templates counts at a place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import sum_slots
from .textblocks import ALNUM, blocks, hash_spans, hash_word, words

#: Phrases of the base label set.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices by which licenses ask to be named, and whole texts of the short licenses, with the label of each.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    # Public license texts and the notices that go into source files.
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you
must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would
be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. This notice may not be removed or altered from any source distribution."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("lgpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("agpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
)
#: Share of a template's distinct tokens that a block must hold.
THRESHOLD = 0.9
#: Names without which no notice counts, whatever else is there.
NAMES = frozenset({"gnu", "mozilla", "creative", "commons"})
#: Words by which matches of equal containment may differ in length and both count, as in "version 2 or 3".
NEAR = 2
#: Names of sister licenses: a run that holds one which its template lacks is the notice of another license.
SISTERS, LIBRARY = ("affero", "lesser"), ("library", "general")
#: Templates of different labels that share this much of the smaller one's tokens are similar.
SIMILAR = 0.8


def tokens(text: str) -> list[str]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    block = next(blocks(pa.array([text])))
    found = words(block, ALNUM)
    return [raw[a:b].tobytes().lower().decode() for a, b in zip(found.starts, found.ends, strict=True)]


class Ordered(NamedTuple):
    """A template: its token numbers from rare to frequent, and how many of them a block needs."""

    label: str
    order: tuple[int, ...]
    need: int

    @property
    def prefix(self) -> tuple[int, ...]:
        return self.order[: len(self.order) - self.need + 1]


class Notice(NamedTuple):
    """What a notice of a template must hold, the most words it may take, and the templates it is easily taken for."""

    required: frozenset[int]
    length: int
    similar: frozenset[int]


def make_notices(templates: tuple[tuple[str, str], ...], number: dict[str, int], threshold: float) -> list[Notice]:
    sets = [frozenset(tokens(text)) for _, text in templates]
    out = []
    for (label, text), own in zip(templates, sets, strict=True):
        others = [(k, other) for k, other in enumerate(sets) if templates[k][0] != label]
        required = own & (NAMES | set(tokens(label)))
        for _, other in others:
            if len(own & other) >= threshold * len(own) - 1e-9:
                required |= own - other
        similar = frozenset(k for k, other in others if len(own & other) >= SIMILAR * min(len(own), len(other)) - 1e-9)
        out.append(Notice(frozenset(number[w] for w in required), math.ceil(len(tokens(text)) / threshold), similar))
    return out


def tightest(codes: list[int], hit: int, template: frozenset[int], notice: Notice, need: int) -> tuple[int, int, int] | None:
    """Tokens shared, start and end of the best run of ``notice.length`` words or fewer around a place."""
    if len(template.intersection(codes)) < need or not notice.required.issubset(codes):
        return None
    best = None
    for start in range(max(0, hit - notice.length + 1), hit + 1):
        if codes[start] not in template:
            continue
        own: set[int] = set()
        for at in range(start, min(len(codes), start + notice.length)):
            if codes[at] in template and codes[at] not in own:
                own.add(codes[at])
                if at >= hit and len(own) >= need and notice.required <= own:
                    rank = len(own), start - at
                    if best is None or rank > best[0]:
                        best = rank, start, at + 1
    return best and (best[0][0], best[1], best[2])


class Vocabulary:
    """The hashes of all template and phrase tokens; a bounded table (it grows with the templates only)."""

    def __init__(self, texts: list[str]):
        self.words = sorted({w for t in texts for w in tokens(t)})
        hashes = np.array([hash_word(w) for w in self.words], dtype=np.uint64)
        self.rank = np.argsort(hashes)
        self.sorted = hashes[self.rank]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True
        self.number = {w: i for i, w in enumerate(self.words)}

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose word is in the vocabulary, and the number of that word."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        good = self.sorted[slot] == hashes[at]
        return at[good], self.rank[slot[good]]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """How often each token of the vocabulary stands in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words), dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = words(block, ALNUM)
                total += np.bincount(vocabulary.numbers(hash_spans(block, found.starts, found.ends))[1], minlength=len(total))
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["slot", "value"])

    return sum_slots(_source(docs, id_col, text_col).mapInArrow(run, "slot int, value long"), len(vocabulary.words))


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    notices: bool = False,
) -> DataFrame:
    """Find license phrases and notices in every whole text, one row for each input row.

    Words are runs of ASCII letters (A-Z as a-z), digits and non-ASCII characters; blocks are
    lines.  Returns ``doc_id, n_words, n_base`` (places of phrases, overlaps included),
    ``first_word, last_word`` (smallest and largest start of these, counted in words; null
    without any), ``base_labels``, ``labels`` (with those of the join; distinct, sorted,
    comma-joined, empty string for none), ``score`` (1 with a phrase; else the largest
    containment found, at least ``threshold``, or 0) and ``blocks`` (start and length in
    words, label and containment of each match, by start and label).

    By default every template whose tokens a line holds to the share ``threshold`` gives its
    label, so one notice also gets the labels of similar templates.  With ``notices`` a match
    must hold the words that tell the template apart (those of the label, names, and what a
    similar template lacks); it may be a run of words across lines, as long as the template and
    a share for insertions, or else a line; and where matches of similar templates overlap,
    those of the largest containment, then of most tokens, then the compact ones stay.  Words that name
    a sister license (lesser, affero, library general) which is not the template's make no match. So "version 2 or 3" names both, but of
    "version 2 or version 3", which is too long for a run, only the first is told.

    A very long text is scanned whole, by itself, at some tens of bytes for each of its words.
    Null and empty texts have no words and no labels.  Repeated rows and null ids give a row
    each; other columns are ignored whatever their names; an empty table gives no rows.
    """
    vocabulary = Vocabulary([*phrases, *(t for _, t in templates), *SISTERS, *LIBRARY])
    counts = token_counts(docs, vocabulary, id_col, text_col)
    ordered = []
    for label, text in templates:
        order = sorted({vocabulary.number[w] for w in tokens(text)}, key=lambda k: (counts[k], vocabulary.words[k]))
        ordered.append(Ordered(label, tuple(order), math.ceil(threshold * len(order) - 1e-9)))
    lookups: dict[int, list[tuple[int, int]]] = {}
    for k, template in enumerate(ordered):
        for place, token in enumerate(template.prefix):
            lookups.setdefault(token, []).append((k, place))
    is_prefix = np.zeros(len(vocabulary.words), dtype=bool)
    is_prefix[list(lookups)] = True
    sequences = [([vocabulary.number[w] for w in tokens(p)], label) for p, label in phrases.items()]

    wanted = make_notices(templates, vocabulary.number, threshold)
    sets = [frozenset(t.order) for t in ordered]

    sisters = frozenset(vocabulary.number[w] for w in SISTERS)
    library, general = (vocabulary.number[w] for w in LIBRARY)

    def foreign(run: list[int], k: int) -> bool:
        """Whether words name a sister license that the template is not of."""
        return bool((sisters - sets[k]).intersection(run)) or library not in sets[k] and any(x == library and y == general for x, y in zip(run, run[1:], strict=False))

    def compact(code: np.ndarray, rare: np.ndarray, first: np.ndarray) -> dict[int, list[tuple]]:
        """For each text, matches of all templates within runs of words, as (rank, start, end, template)."""
        out: dict[int, set[tuple]] = {}
        for at, text in zip(rare.tolist(), (np.searchsorted(first, rare, side="right") - 1).tolist(), strict=True):
            for k, _ in lookups[int(code[at])]:
                begin = max(int(first[text]), at - wanted[k].length + 1)
                run = code[begin : min(int(first[text + 1]), at + wanted[k].length)].tolist()
                if (found := tightest(run, at - begin, sets[k], wanted[k], ordered[k].need)) is not None:
                    shared, start, end = found
                    if foreign(run[start:end], k):
                        continue
                    out.setdefault(text, set()).add(((shared / len(sets[k]), shared, True), begin + start, begin + end, k))
        return {text: list(x) for text, x in out.items()}

    def lines_of(line: np.ndarray, a: int, b: int, known: list[tuple]) -> list[tuple]:
        """Matches of the line of words a..b-1 with templates that have no compact match in it."""
        own = line[line >= 0]
        present, out = set(own.tolist()), []
        for k in {k for token in present for k, _ in lookups.get(token, ())}:
            shared = len(present & sets[k])
            if shared >= ordered[k].need and wanted[k].required <= present and not foreign(line.tolist(), k) and not any(m[3] == k and m[1] < b and a < m[2] for m in known):
                out.append(((shared / len(sets[k]), shared, False), a, b, k))
        return out

    def best_of(found: list[tuple]) -> list[tuple]:
        """Matches without those that overlap a better one of a similar template."""
        out: list[tuple] = []
        for m in sorted(found, key=lambda m: (tuple(-x for x in m[0]), m[2] - m[1], *m[1:])):
            beats = lambda o: o[0] > m[0] or o[0] == m[0] and o[2] - o[1] + NEAR < m[2] - m[1]  # noqa: B023, E731
            if not any(o[3] in wanted[m[3]].similar and beats(o) and o[1] < m[2] and m[1] < o[2] for o in out):
                out.append(m)
        return out

    def matches(line: np.ndarray, n_words: int) -> dict[str, float]:
        """Labels and containments of the templates that a line, given by its vocabulary tokens, meets."""
        own, out, done = set(line.tolist()), {}, set()
        for token in own:
            for k, place in lookups.get(token, ()):
                template = ordered[k]
                size = len(template.order)
                if k in done or n_words < template.need or size - place < template.need:
                    continue
                done.add(k)
                shared = len(own.intersection(template.order))
                if shared >= template.need:
                    out[template.label] = max(out.get(template.label, 0.0), shared / size)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                n = len(block.offsets) - 1
                found = words(block, ALNUM)
                at, number = vocabulary.numbers(hash_spans(block, found.starts, found.ends))
                code = np.full(len(found.starts) + 64, -1, dtype=np.int32)
                code[at] = number
                n_base, first, last = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
                base: list[set[str]] = [set() for _ in range(n)]
                labels: list[set[str]] = [set() for _ in range(n)]
                spans: list[list[dict]] = [[] for _ in range(n)]
                score = np.zeros(n)
                for sequence, label in sequences:
                    starts = at[number == sequence[0]]
                    for i, token in enumerate(sequence[1:], 1):
                        starts = starts[code[starts + i] == token]
                    text = np.searchsorted(found.first, starts, side="right") - 1
                    whole = starts + len(sequence) <= found.first[text + 1]
                    for k, start in zip(text[whole].tolist(), (starts - found.first[text])[whole].tolist(), strict=True):
                        n_base[k] += 1
                        first[k] = start if first[k] < 0 else min(first[k], start)
                        last[k] = max(last[k], start)
                        base[k].add(label)
                        score[k] = 1.0
                # lines that hold a token of some template's prefix
                rare = at[is_prefix[number]]
                if len(rare):
                    breaks = np.flatnonzero(block.data == 10)
                    edges = np.unique(np.concatenate([block.offsets, breaks + 1]))
                    lines = np.unique(np.searchsorted(edges, found.starts[rare], side="right") - 1)
                    near = compact(code, rare, found.first) if notices else {}
                    for begin, end in zip(edges[lines].tolist(), edges[np.minimum(lines + 1, len(edges) - 1)].tolist(), strict=True):
                        a, b = np.searchsorted(found.starts, [begin, end])
                        own = code[a:b]
                        if notices:
                            text = int(np.searchsorted(found.first, a, side="right")) - 1
                            near[text] = near.get(text, []) + lines_of(own, int(a), int(b), near.get(text, []))
                            continue
                        for label, share in matches(own[own >= 0], int(b - a)).items():
                            k = int(np.searchsorted(found.first, a, side="right")) - 1
                            labels[k].add(label)
                            spans[k].append({"start": int(a - found.first[k]), "n_words": int(b - a), "label": label, "containment": share})
                            score[k] = max(score[k], share)
                    for k, all_matches in near.items():
                        for (share, _, _), a, b, t in best_of(all_matches):
                            labels[k].add(ordered[t].label)
                            spans[k].append({"start": int(a - found.first[k]), "n_words": b - a, "label": ordered[t].label, "containment": share})
                            score[k] = max(score[k], share)
                none = first < 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, n),
                        pa.array(np.diff(found.first).astype(np.int64)),
                        pa.array(n_base),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array([",".join(sorted(x)) for x in base]),
                        pa.array([",".join(sorted(x | y)) for x, y in zip(base, labels, strict=True)]),
                        pa.array(score),
                        pa.array([sorted(x, key=lambda s: (s["start"], s["label"])) for x in spans], SPANS),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
                )

    return _source(docs, id_col, text_col).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "blocks array<struct<start: long, n_words: long, label: string, containment: double>>",
    )


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
