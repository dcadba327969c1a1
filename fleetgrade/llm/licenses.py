"""Licence scans with a generalised suffix automaton of licence tokens (operator 10).

All licence templates (fixed texts, a parameter) become one automaton over word numbers.
A text is streamed through it once: after each word the automaton knows the longest
suffix of the text that occurs in any template (matching statistics). Matches that cannot
grow are kept from ``MIN_MATCH`` words on (or a whole template, if that is shorter), at every
place of the template where their words stand. Per template, the chain of matches that follow
each other in both texts, at most ``MAX_GAP`` words apart, with the most covered template
words becomes a span; matches beside it may form further spans. A span that covers
``MIN_COVER`` of its template, and the words that its label requires (a version), gives the
label; the score is the best coverage.

Base phrases are templates as well: an occurrence is a position whose current match has
the phrase as its suffix.

The automaton has a few hundred states whatever the input; it is built once per worker.
Rows are independent: no shuffle, no driver data. Edge cases: texts of any length are streamed whole; null and empty texts have no
words, no labels and score 0; repeated rows are scanned row by row; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

MIN_MATCH, MAX_GAP, MIN_COVER = 4, 12, 0.6

# Base phrases and labels of the contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Public licence texts and notices (label, text).
TEMPLATES = (
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
              "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
              "the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
             "by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
            "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
            "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
            "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
            "IN THE SOFTWARE"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                 "in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                 "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                 "implied. See the License for the specific language governing permissions and limitations under the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("bsd-2", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
              "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list "
              "of conditions and the following disclaimer in the documentation and/or other materials provided with the "
              "distribution"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
              "promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
              "was not distributed with this file, You can obtain one at"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work"),
)
# Words that a span must cover for its label: a version, or what tells a licence from its kin.
REQUIRED = {"gpl-3": "version 3", "gpl-2": "version 2", "lgpl": "lesser", "apache-2": "license", "mpl-2": "mozilla public license v 2 0",
            "cc-by": "attribution 4 0", "cc-by-sa": "sharealike 4 0"}

_KEEP = re.compile(rb"[0-9a-z\x80-\xff]")
_MAP = bytes(b | 32 if 65 <= b <= 90 else b if _KEEP.match(bytes([b])) else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased."""
    return text.encode().translate(_MAP).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, required=REQUIRED):
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.labels = [x for x, _ in templates] + [x for _, x in phrases]
        texts = [plain_words(t) for _, t in templates] + [plain_words(p) for p, _ in phrases]
        self.sizes = [len(t) for t in texts]
        self.n_templates = len(templates)
        coded = [[self.number.setdefault(w, len(self.number)) for w in t] for t in texts]
        for seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        # Every place of a template where a state's words end, for states long enough to match.
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for t, seq in enumerate(coded[: self.n_templates]):
            v = 0
            for i, c in enumerate(seq):
                v = self.next[v][c]
                u = v
                while u > 0 and self.len[u] >= min(MIN_MATCH, self.sizes[t]):
                    self.ends[u].append((t, i + 1))
                    u = self.link[u]
        # Templates in which a state's words stand; a step that leaves one of them ends its match there.
        self.within = [frozenset(t for t, _ in ends) for ends in self.ends]
        self.leaves: dict[tuple[int, int], bool] = {}
        # Places of the required words of each template (none: no requirement, or the template lacks them).
        self.required: list[list[range]] = []
        for t, (label, text) in enumerate(templates):
            need, ws = plain_words(required.get(label, "")), plain_words(text)
            self.required.append([range(i, i + len(need)) for i in range(len(ws) - len(need) + 1) if need and ws[i: i + len(need)] == need])
        whole = {}
        for t in range(self.n_templates, len(coded)):
            v = 0
            for c in coded[t]:
                v = self.next[v][c]
            whole.setdefault(v, []).append((len(coded[t]), t))
        self.finals: list[list[tuple[int, int]]] = []
        for v in range(len(self.next)):
            u, got = v, []
            while u > 0:
                got += whole.get(u, [])
                u = self.link[u]
            self.finals.append(got)

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur = self._state(self.len[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _state(self, size: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.len.append(size)
        self.link.append(link)
        return len(self.next) - 1

    def _left(self, v: int, c: int) -> bool:
        """Whether some template that a state or its shorter forms stand in has no such words followed by ``c``."""
        key, out = (v, c), False
        if key in self.leaves:
            return self.leaves[key]
        while v > 0 and self.within[v] and not out:
            out = not self.within[v] <= self.within[self.next[v][c]]
            v = self.link[v]
        self.leaves[key] = out
        return out

    def stream(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(base places as (start, phrase), maximal matches as (end, length, state))."""
        base, found = [], []
        v, size = 0, 0
        nxt, link, length, finals = self.next, self.link, self.len, self.finals
        for i, c in enumerate(map(self.number.get, ws)):
            if c is None:
                if size > 1:
                    found.append((i, size, v))
                v, size = 0, 0
                continue
            if c not in nxt[v]:
                if size > 1:
                    found.append((i, size, v))
                while v and c not in nxt[v]:
                    v = link[v]
                    size = length[v]
            elif size > 1 and self.within[v] and self._left(v, c):
                found.append((i, size, v))
            if c in nxt[v]:
                v, size = nxt[v][c], size + 1
                for need, t in finals[v]:
                    if need <= size:
                        base.append((i + 1 - need, t))
            else:
                v, size = 0, 0
        if size > 1:
            found.append((len(ws), size, v))
        return base, found

    def _chains(self, t: int, matches: list[tuple[int, int, int]]):
        """Best chains of one template's matches (end in the text, size, end in the template): spans that
        share no word of the text, each with the template words that it covers."""
        matches = sorted(matches)
        while matches:
            best: list[tuple[int, int | None]] = []      # covered words of the best chain up to a match, and what it goes on from
            lo = 0
            for i, (end, size, at) in enumerate(matches):
                mine = (size, None)
                while matches[lo][0] < end - self.sizes[t] - MAX_GAP:
                    lo += 1
                for j in range(lo, i):
                    last_end, _, last_at = matches[j]
                    new = min(size, at - last_at, end - last_end)
                    if new > 0 and end - size - last_end <= MAX_GAP and best[j][0] + new > mine[0]:
                        mine = (best[j][0] + new, j)
                best.append(mine)
            i = max(range(len(best)), key=lambda x: (best[x][0], -matches[x][0]))
            covered, last, first = set(), matches[i][0], matches[i][0]
            while i is not None:
                end, size, at = matches[i]
                back = best[i][1]
                new = size if back is None else min(size, at - matches[back][2], end - matches[back][0])
                covered.update(range(at - new, at))
                first, i = end - new, back
            yield first, last, covered
            matches = [m for m in matches if m[0] <= first or m[0] - m[1] >= last]

    def scan(self, text: str | None) -> dict:
        """Base places, covered template spans (label, first word, last word, coverage, complete) and counts."""
        ws = plain_words(text)
        base, found = self.stream(ws)
        of: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, v in found:
            # The state's own places and those of its shorter forms that are long enough.
            while v > 0 and size >= 1:
                for t, at in self.ends[v]:
                    if size >= min(MIN_MATCH, self.sizes[t]):
                        of.setdefault(t, []).append((end, size, at))
                v = self.link[v]
                size = self.len[v]
                if size < MIN_MATCH:
                    break
        spans = []
        for t, matches in of.items():
            for first, last, covered in self._chains(t, list(dict.fromkeys(matches))):
                whole = not self.required[t] or any(set(r) <= covered for r in self.required[t])
                spans.append((self.labels[t], first, last - 1, len(covered) / self.sizes[t], whole))
        return {"n_words": len(ws), "base": base, "spans": spans}


_WORKER: dict = {}


def automaton(templates, phrases) -> Automaton:
    key = (templates, phrases)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Automaton(templates, phrases)
    return _WORKER[key]


def scan_documents(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Counts, labels, score and the covered spans of every row."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(templates, phrases)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                got = a.scan(text)
                starts = [s for s, _ in got["base"]]
                base = sorted({a.labels[t] for _, t in got["base"]})
                good = sorted({s[:4] for s in got["spans"] if s[3] >= MIN_COVER and s[4]}, key=lambda s: s[1:])
                score = max([1.0] * bool(base) + [s[3] for s in got["spans"]], default=0.0)
                rows.append((doc_id, got["n_words"], len(starts), min(starts, default=None), max(starts, default=None),
                             ",".join(base), ",".join(sorted({*base, *(s[0] for s in good)})), min(score, 1.0),
                             [{"label": s[0], "first": s[1], "last": s[2], "coverage": s[3]} for s in good]))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                                              "labels", "score", "spans"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64", "doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
             "labels string, score double, spans array<struct<label:string,first:long,last:long,coverage:double>>")


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    from fleetgrade.llm.common import table

    return scan_documents(table(spark, sf_dir, "documents"))
