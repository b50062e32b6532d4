"""License scan by patience alignment.

Words that occur once in a stretch of text and once in a license template anchor the alignment; the
longest increasing subsequence of anchors is kept and the gaps between them are aligned the same way,
or, where a gap has no anchor, by its longest common subsequence. Coverage is the share of the
template's words that are aligned. Licenses that differ in few words are told apart by what is not aligned: a
template's numbers and qualifiers must be, and no other qualifier may stand inside the stretch; of templates
that fit the same stretch the one that explains most words and leaves fewest unexplained is reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least share of a template's words that is aligned, and of a stretch's.
MIN_COVERAGE, MIN_EXPLAINED = 0.8, 0.8
WORD = re.compile(r"[^\W_]+")
#: Words that make another license of one.
QUALIFIERS = frozenset("noncommercial nc sharealike sa noderivatives noderivs nd lesser library affero clear zero".split())
#: Those that make another license of one of a family, by the family's names; words that end a license's name.
FAMILIES = {
    "cc": frozenset("noncommercial nc sharealike sa noderivatives noderivs nd".split()),
    "gpl": frozenset("lesser library affero".split()), "lgpl": frozenset(["affero"]), "agpl": frozenset("lesser library".split()),
    "bsd": frozenset(["clear"]), "mit": frozenset(["zero"]), "isc": frozenset(["zero"]),
}
NAME_ENDS = frozenset("license licence international unported".split())
#: Marks that may stand inside a license's name, between two of its words.
INSIDE_NAME = re.compile(r"[\s\-_/(,]*\Z")

# License texts, notices and statements.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_REST = """subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"""
_BSD_TWO = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_ADVERTISING = """All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"""
_BSD_ENDORSE = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_NOTICE = """provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_REST = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU_NOTICE = """you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}"""
_GNU_KINDS = (("gpl-2.0", "General Public License", "2"), ("gpl-3.0", "General Public License", "3"), ("lgpl-2.1", "Lesser General Public License", "2.1"), ("lgpl-3.0", "Lesser General Public License", "3"), ("agpl-3.0", "Affero General Public License", "3"))
_APACHE_BODY = """Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."""
_MPL_BODY = """Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a Larger Work"""
_GNU_BODY = """The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public {} intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."""
_GPL3_BODY = """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."""
_CC_KINDS = (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))

TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": _APACHE_NOTICE,
    "apache-2.0-notice-whole": f"{_APACHE_NOTICE} {_APACHE_REST}",
    "apache-2.0-body": _APACHE_BODY,
    "mpl-2.0-body": _MPL_BODY,
    "gpl-2.0-body": _GNU_BODY.format("License is"),
    "lgpl-2.1-body": _GNU_BODY.format("Licenses are"),
    "gpl-3.0-body": _GPL3_BODY,
    "mit": "Released under the MIT License.",
    "mit-grant": f"{_MIT_GRANT}, subject to the following conditions",
    "mit-text": f"{_MIT_GRANT}, {_MIT_REST} {_MIT_WARRANTY}",
    "mit-0-text": f"{_MIT_GRANT}. {_MIT_WARRANTY}",
    "bsd-grant": _BSD_GRANT,
    "bsd-2-text": f"{_BSD_GRANT}: {_BSD_TWO} {_BSD_WARRANTY}",
    "bsd-3-text": f"{_BSD_GRANT}: {_BSD_TWO} {_BSD_ENDORSE} {_BSD_WARRANTY}",
    "bsd-4-text": f"{_BSD_GRANT}: {_BSD_TWO} {_BSD_ADVERTISING} the organization. {_BSD_ENDORSE} {_BSD_WARRANTY}",
    "isc-grant": f"{_ISC_GRANT}, {_ISC_NOTICE}",
    "isc-text": f"{_ISC_GRANT}, {_ISC_NOTICE} {_ISC_WARRANTY}",
    "0bsd-text": f"{_ISC_GRANT}. {_ISC_WARRANTY}",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "cc0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    **{name: f"This work is licensed under the GNU {title}, version {version}." for name, title, version in _GNU_KINDS},
    **{f"{name}-notice": _GNU_NOTICE.format(title, f"version {version} of the License.") for name, title, version in _GNU_KINDS},
    **{f"{name}-or-later-notice": _GNU_NOTICE.format(title, f"either version {version} of the License, or (at your option) any later version.") for name, title, version in _GNU_KINDS},
    **{f"cc-{k}-{v}": f"Licensed under CC {k.upper()} {v}." for k, _ in _CC_KINDS for v in ("3.0", "4.0")},
    **{f"cc-{k}-4.0-statement": f"This work is licensed under a Creative Commons {title} 4.0 International License." for k, title in _CC_KINDS},
    **{f"cc-{k}-3.0-statement": f"This work is licensed under a Creative Commons {title} 3.0 Unported License." for k, title in _CC_KINDS},
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, by the table."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        above, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def patience_align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned index pairs of two word lists, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        if not anchors:
            if in_a.keys() & in_b.keys():
                out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        kept = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:])]
    return sorted(out)


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    seeds: frozenset[str]

    @staticmethod
    def of(name: str, text: str, min_coverage: float = MIN_COVERAGE) -> Template:
        """seeds: so many of the longest words that no alignment of min_coverage can do without all of them."""
        words, seeds, covered = words_of(text), set(), 0
        counts = Counter(words)
        for w in sorted(counts, key=lambda w: (-len(w), w)):
            seeds.add(w)
            covered += counts[w]
            if len(words) - covered < min_coverage * len(words):
                break
        return Template(name, tuple(words), frozenset(seeds))

    def distinctive(self, word: str) -> bool:
        """Whether a match can't lack this word of the template."""
        return word.isdigit() or word in QUALIFIERS

    @property
    def family(self) -> frozenset[str]:
        """Words that make another license of this one."""
        return FAMILIES.get(self.name.split("-")[0], frozenset())

    @property
    def ends_in_name(self) -> bool:
        return bool(self.words) and (self.words[-1].isdigit() or self.words[-1] in NAME_ENDS)


def goes_on(words: list[str], marks: list[str], last: int, rest: tuple[str, ...], family: frozenset[str]) -> bool:
    """Whether a license's name, aligned up to words[last], goes on with a word of its family: "CC BY 4.0 NC" is no CC BY.

    rest: the template's words behind the last aligned one, which are passed over. marks[i]: what stands between words i and
    i + 1; the name ends at a full stop or any other mark that no name has inside.
    """
    while last + 1 < len(words) and INSIDE_NAME.match(marks[last]):
        last += 1
        if words[last] in family:
            return True
        if words[last] not in rest:
            return False
    return False


def fit(words: list[str], lo: int, hi: int, t: Template, min_coverage: float = MIN_COVERAGE, min_explained: float = MIN_EXPLAINED, marks: list[str] | None = None) -> dict | None:
    """The template aligned with words[lo:hi]: a finding, if it covers enough, lacks no distinctive word and has no word inside, or behind its name, that makes another license of it."""
    pairs = patience_align(words[lo:hi], list(t.words))
    n = len(t.words)
    if len(pairs) < min_coverage * n:
        return None
    first, last = lo + pairs[0][0], lo + pairs[-1][0]
    span = last - first + 1
    if len(pairs) < min_explained * span:
        return None
    of_text, of_template = {lo + i for i, _ in pairs}, {j for _, j in pairs}
    if any(j not in of_template and t.distinctive(w) for j, w in enumerate(t.words)):
        return None
    if any(i not in of_text and words[i] in t.family for i in range(first, last + 1)):
        return None
    if t.ends_in_name and goes_on(words, [" "] * len(words) if marks is None else marks, last, t.words[pairs[-1][1] + 1 :], t.family):
        return None
    return {"license": t.name, "coverage": len(pairs) / n, "first_word": first, "last_word": last, "score": 2 * len(pairs) - n - (span - len(pairs))}


def candidates(words: list[str], t: Template, min_coverage: float = MIN_COVERAGE, min_explained: float = MIN_EXPLAINED) -> Iterator[tuple[int, int]]:
    """Stretches (lo, hi) that hold every possible match: windows as long as a match can be, wherever they have enough of the template's words, in small steps."""
    n = len(t.words)
    width, need, want = int(n / min_explained) + 1, min_coverage * n, Counter(t.words)
    step = max(1, width // 16)
    have: Counter = Counter()
    common, last = 0, None  # last: the end of the window before, in this run of full windows
    for end in range(len(words) + width):
        if end < len(words) and (w := words[end]) in want:
            have[w] += 1
            common += have[w] <= want[w]
        start = end - width
        if start >= 0 and (w := words[start]) in want:
            common -= have[w] <= want[w]
            have[w] -= 1
        full = common >= need
        if full and (last is None or end - last >= step) or not full and last is not None:
            yield max(0, end - width - step), min(len(words), end + 1)
            last = end
        if not full:
            last = None


def seed_index(templates: list[Template]) -> ahocorasick.Automaton:
    """The templates' seeds, to be looked for in one pass over a text."""
    at: dict[str, list[int]] = {}
    for i, t in enumerate(templates):
        for s in t.seeds:
            at.setdefault(s, []).append(i)
    index = ahocorasick.Automaton()
    for s, own in at.items():
        index.add_word(s, own)
    index.make_automaton()
    return index


def find_licenses(text: str | None, templates: list[Template], min_coverage: float = MIN_COVERAGE, min_explained: float = MIN_EXPLAINED, index: ahocorasick.Automaton | None = None) -> list[dict]:
    """Every stretch that is a license: name, coverage, the words of the text from first to last aligned one (word indexes).

    Of findings that overlap, the one with the most aligned words less the unexplained ones (of the template
    and of the stretch) stays; ties go to the name that sorts first. Best covered first.
    """
    low, found = (text or "").lower(), []
    hit = [templates[i] for i in sorted({i for _, own in (index or seed_index(templates)).iter(low) for i in own})]
    at = list(WORD.finditer(low)) if hit else []
    words, marks = [m[0] for m in at], [low[m.end() : n.start()] for m, n in zip(at, at[1:])]
    for t in hit:
        seen = set()
        for lo, hi in candidates(words, t, min_coverage, min_explained):
            f = fit(words, lo, hi, t, min_coverage, min_explained, marks)
            if f and (f["first_word"], f["last_word"]) not in seen:
                seen.add((f["first_word"], f["last_word"]))
                found.append(f)
    return settle(found)


def settle(found: list[dict]) -> list[dict]:
    """Of findings that overlap the best; without their scores."""
    kept: list[dict] = []
    for f in sorted(found, key=lambda f: (-f["score"], -f["coverage"], f["license"], f["first_word"])):
        if all(f["last_word"] < k["first_word"] or k["last_word"] < f["first_word"] for k in kept):
            kept.append(f)
    return [{k: v for k, v in f.items() if k != "score"} for f in sorted(kept, key=lambda f: (-f["coverage"], f["license"], f["first_word"]))]


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, license (the best covered, else null), coverage (0 if none), licenses array of struct(license, coverage, first_word, last_word).

    Every row of docs, whole texts, every stretch of them that is a license, very long ones too; null texts
    have none; ties go to the name that sorts first; repeated rows stay; an empty table gives no rows. Each batch of rows stands alone: no shuffle.
    """
    known = [Template.of(name, body, min_coverage) for name, body in templates.items()]
    found_type = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = seed_index(known)
        for batch in batches:
            found = [find_licenses(t, known, min_coverage, index=index) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0]["license"] if f else None for f in found], pa.string()), pa.array([f[0]["coverage"] if f else 0.0 for f in found], pa.float64()), pa.array(found, found_type)],
                names=["doc_id", "license", "coverage", "licenses"],
            )

    schema = "doc_id long, license string, coverage double, licenses array<struct<license:string,coverage:double,first_word:long,last_word:long>>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)
