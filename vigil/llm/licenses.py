"""Licence scan: a generalised suffix automaton over licence templates.

The automaton holds every word sequence of the templates. Documents stream
through it word by word, which gives at each word the longest suffix that
occurs in a template (the matching statistics). Only runs of words the
templates know can extend a match, so runs are found with whole-array
operations and only they are streamed. Long matches are chained in order of
template position; the chain's covered share of a template is its score. Of
templates that share most of their matched words in the text, as the versions
of one notice do, the one of the largest share gives its label (of equal ones
the first in the list).

Base phrases are templates too: a phrase stands where the matched suffix ends
with it, which the automaton's suffix links tell.

Defined results: null and empty texts have no words; repeated rows keep their
multiplicity; a null id stays null; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textops as T

# Base phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# Template texts of well-known licence notices and their labels.
TEMPLATES = (
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("as-is-text", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
     "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache-text", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
     "KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
     "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
     "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
     "the GNU General Public License for more details."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: 1. Redistributions of source code must retain the above "
     "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
     "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
     "and/or other materials provided with the distribution."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
     "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all "
     "copies."),
    ("bsd-3-clause-text", "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-disclaimer-text", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
     "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
     "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
     "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
     "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
     "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
     "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
     "DAMAGE."),
    ("isc-disclaimer-text", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
     "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
     "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
     "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
     "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mpl-2-text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("gpl-2-text", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
     "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
     "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
     "General Public License for more details."),
    ("lgpl-text", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
     "(at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT "
     "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
     "GNU Lesser General Public License for more details."),
    ("agpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
     "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
     "GNU Affero General Public License for more details."),
)
#: Matches shorter than this many words are not chained.
MIN_MATCH = 5
#: Covered share of a template from which its label is given.
MIN_SCORE = 0.5


def _words(text: str) -> list[bytes]:
    part = next(T.slices(pa.array([text])))
    w = T.Words(part, "alnum")
    return [part.data[a:b].tobytes().lower() for a, b in zip(w.starts, w.ends)]


class Automaton:
    """Generalised suffix automaton over several id sequences."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.end = [-1], [0], [(0, 0)]  # end: (text, position after) of one occurrence
        for t, ids in enumerate(texts):
            last = 0
            for i, c in enumerate(ids):
                last = self._extend(last, c, (t, i + 1))

    def _new(self, length: int, link: int, nxt: dict, end: tuple) -> int:
        self.next.append(dict(nxt))
        self.link.append(link)
        self.len.append(length)
        self.end.append(end)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.len[p] + 1, self.link[q], self.next[q], self.end[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, end: tuple) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another text has put this word here already
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur, p = self._new(self.len[last] + 1, 0, {}, end), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def stream(self, ids: list[int]) -> list[tuple[int, int]]:
        """Matching statistics: (state, matched length) after each word."""
        nxt, link, length = self.next, self.link, self.len
        s = n = 0
        out = []
        for c in ids:
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            t = nxt[s].get(c)
            if t is None:
                s = n = 0
            else:
                s, n = t, n + 1
            out.append((s, n))
        return out


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        texts = [_words(p) for p, _ in phrases] + [_words(t) for _, t in templates]
        vocab = sorted({w for t in texts for w in t})
        self.id = {w: i for i, w in enumerate(vocab)}
        ids = [[self.id[w] for w in t] for t in texts]
        self.sam = Automaton(ids)
        self.phrases, self.templates = phrases, templates
        self.lengths = [len(t) for t in texts]
        # words of the templates by their 64-bit hash
        col = pa.array([w.decode() for w in vocab])
        part = next(T.slices(col))
        h = T.Words(part, "alnum").hashes(lower=True)
        order = np.argsort(h)
        self.hashes, self.hash_id = h[order], order
        # phrase p ends at a match (state, n) if its state is the match's state or above it
        self.ends: list[tuple[int, ...]] = []
        home = [self._state(ids[k]) for k in range(len(phrases))]
        for s in range(len(self.sam.len)):
            up, found = s, []
            while up > 0:
                found += [k for k, at in enumerate(home) if at == up]
                up = self.sam.link[up]
            self.ends.append(tuple(found))
        # where each state's longest sequence stands in every template
        self.spots: list[list[tuple[int, int]]] = [[] for _ in self.sam.len]
        for t in range(len(phrases), len(texts)):
            s = 0
            for i, c in enumerate(ids[t]):
                s = self.sam.next[s][c]
                up = s
                while up > 0:
                    self.spots[up].append((t - len(phrases), i + 1))
                    up = self.sam.link[up]

    def _state(self, ids: list[int]) -> int:
        s = 0
        for c in ids:
            s = self.sam.next[s][c]
        return s

    def vocabulary(self, w: T.Words) -> np.ndarray:
        """Template word id of each word, -1 where the templates lack it."""
        h = w.hashes(lower=True)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.hash_id[at], -1)

    def scan(self, ids: np.ndarray, off: np.ndarray):
        """Per row: phrase places (start, phrase), and covered template share."""
        inside = ids >= 0
        first = np.zeros(len(ids) + 1, dtype=bool)
        first[off] = True
        # a match has two words at least: keep runs of two and more
        pair = inside[:-1] & inside[1:] & ~first[1:-1]
        keep = np.zeros(len(ids), dtype=bool)
        keep[:-1] |= pair
        keep[1:] |= pair
        starts = np.flatnonzero(keep & np.concatenate([[True], ~keep[:-1] | first[1:-1]]))
        stops = np.flatnonzero(keep & np.concatenate([~keep[1:] | first[1:-1], [True]])) + 1
        rows = np.searchsorted(off, starts, side="right") - 1
        places: dict[int, list[tuple[int, int]]] = {}
        matches: dict[int, list[tuple[int, int, int, int]]] = {}
        for a, b, r in zip(starts.tolist(), stops.tolist(), rows.tolist()):
            stats = self.sam.stream(ids[a:b].tolist())
            base = a - int(off[r])
            for i, (s, n) in enumerate(stats):
                for k in self.ends[s]:
                    if n >= self.lengths[k]:
                        places.setdefault(r, []).append((base + i + 1 - self.lengths[k], k))
                # a match is long where the next word does not extend it
                if n >= MIN_MATCH and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                    for t, end in self.spots[s]:
                        if end >= n:
                            matches.setdefault(r, []).append((t, base + i + 1 - n, end - n, n))
        return places, {r: self._chain(m) for r, m in matches.items()}

    def _chain(self, matches: list[tuple[int, int, int, int]]) -> dict[int, tuple[float, list[tuple[int, int]]]]:
        """Best share of each template covered by matches in the template's
        order (greedy by text position, never going back in the template; of
        equal shares the first), and the words of the text in these matches."""
        best: dict[int, tuple[float, list[tuple[int, int]], int]] = {}
        # template -> (template position reached, words covered, places in the text)
        open_: dict[int, tuple[int, int, list[tuple[int, int]]]] = {}
        for t, pos, at, n in sorted(matches, key=lambda m: (m[1], m[2])):
            reached, got, spans = open_.get(t, (0, 0, []))
            if at + n <= reached:  # the template begins anew
                reached, got, spans = 0, 0, []
            new = n - max(0, reached - at)
            spans.append((pos, pos + n))
            open_[t] = (at + n, got + new, spans)
            share = min(1.0, (got + new) / self.lengths[len(self.phrases) + t])
            if share > best.get(t, (0.0,))[0]:
                best[t] = (share, spans, len(spans))
        return {t: (share, spans[:k]) for t, (share, spans, k) in best.items()}

    def found(self, shares: dict[int, tuple[float, list[tuple[int, int]]]]) -> set[str]:
        """Labels of the templates that stand in a text."""
        order = sorted((-share, t) for t, (share, _) in shares.items() if share >= MIN_SCORE)
        if not order:
            return set()
        first = min(a for _, t in order for a, _ in shares[t][1])
        taken = np.zeros(max(b for _, t in order for _, b in shares[t][1]) - first, dtype=bool)
        labels = set()
        for _, t in order:
            lo, hi = (np.array(x) - first for x in zip(*shares[t][1]))
            own = T.covered(len(taken), lo, hi)
            if 2 * int(taken[own].sum()) <= int(own.sum()):
                taken |= own
                labels.add(self.templates[t][0])
        return labels


@lru_cache(maxsize=2)
def scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, n_words, n_base, first_word, last_word,
    base_labels, labels, score."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"{id_col} {id_type}, n_words long, n_base long, first_word long, last_word long, "
              "base_labels string, labels string, score double")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        sc = scanner()
        label = [x for _, x in sc.phrases]
        for batch in batches:
            for part in T.slices(batch.column(1)):
                w = T.Words(part, "alnum")
                places, shares = sc.scan(sc.vocabulary(w), w.off) if len(w) else ({}, {})
                cols: list[list] = [[] for _ in range(6)]
                for i in range(len(part)):
                    found = places.get(i, ())
                    own = {label[k] for _, k in found}
                    share = shares.get(i, {})
                    more = sc.found(share)
                    at = [p for p, _ in found]
                    row = (len(found), min(at, default=None), max(at, default=None), ",".join(sorted(own)),
                           ",".join(sorted(own | more)), max((x for x, _ in share.values()), default=1.0 if own else 0.0))
                    for c, v in zip(cols, row):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part)), pa.array(w.counts.astype(np.int64))]
                    + [pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
