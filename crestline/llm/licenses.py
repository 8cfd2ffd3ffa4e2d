"""License scans by conditional compression.

Candidates are stretches of words around each word that mentions a license, as far to both sides as twice the longest
template reaches, across lines and paragraphs; stretches that overlap are one. A stretch is read in blocks of bounded
size. Each block is compressed alone and with every template as raw zstandard dictionary; the templates are ranked by the
bytes that they save and confirmed in that order by their exact wording: a template's words are aligned in order with those
of the block, at most a fifth of them may be missing, no more than GAP other words may stand between two of them, all of
them within twice the template's length and GAP words more, and the words that tell licenses apart (names and versions) must all be there. A
confirmed notice claims its words. One that ranks lower counts only if at least one of the words that tell it apart is
still free, so that no license is put together from the words of others; "version 2 or 3" is two licenses. A template is
compressed against a block only if the block has the words that it must have, and enough of the others: without them its
wording cannot be confirmed, whatever it saves.

Templates are short notices as well as whole texts; a whole text takes in the notices that it begins with.

Defined results: a null or empty text has no license; rows that repeat are scanned each on its own; a span covers the
whole lines of the aligned words; of templates that save the same the first by name is tried first; a text of any length is
scanned whole, in time linear in its length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, texts_as_bytes

#: Clauses that several of the texts below have in the same wording.
AS_IS_MIT = """the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright
holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."""
AS_IS_BSD = """this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are
disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data,
or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility
of such damage."""
BSD_CLAUSES = """{redistribution} and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = "3. {neither} the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
MIT_GRANT = """{permission} is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be
included in all copies or substantial portions of the software."""
ISC_TEXT = """{permission} to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided "as is" and the
author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever
resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."""
ZLIB_TEXT = """this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. {permission} is granted to anyone to use this software for any purpose,
including commercial applications, and to {alter} it and redistribute it freely, subject to the following restrictions: 1. the origin of this software must not be {misrepresented}; you must not claim that you wrote the original software. if you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. this notice may
not be removed or altered from any source distribution."""
UNLICENSE_TEXT = """this is {free} and {unencumbered} software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. we make this dedication for the benefit of the public at
large and to the detriment of our heirs and successors. we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
APACHE_HEADER = """licensed under the {apache} license, version {2.0} (the "license"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or
agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under
the license."""
GPL_HEADER = """this program is free software: you can redistribute it and/or modify it under the terms of the {gnu} {general} public license as published by the free software foundation, either version {3} of the license, or (at your option) any later version. this
program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details."""
MPL_HEADER = "this source code form is subject to the terms of the {mozilla} public license, v. {2.0}. if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/."
#: Names, and for each its notices and texts as published; words in braces must be present as they are.
TEMPLATES = {
    "Apache-2.0": ["licensed under the {apache} license, version {2.0}", 'licensed under the {apache} license, version {2.0} (the "license"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0', APACHE_HEADER],
    "BSD-2-Clause": [f"{BSD_CLAUSES} {AS_IS_BSD}", "{redistribution} and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-3-Clause": [f"{BSD_CLAUSES} {BSD_THIRD} {AS_IS_BSD}", "released under the {bsd} {3-clause} license", "{neither} the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "CC-BY-4.0": ["licensed under {cc} {by} {4.0}", "this work is licensed under a {creative} {commons} {attribution} {4.0} international license"],
    "CC-BY-NC-4.0": ["licensed under {cc} {by-nc} {4.0}", "this work is licensed under a {creative} {commons} {attribution-noncommercial} {4.0} international license"],
    "CC-BY-SA-4.0": ["licensed under {cc} {by-sa} {4.0}", "this work is licensed under a {creative} {commons} {attribution-sharealike} {4.0} international license"],
    "GPL-2.0": ["this work is licensed under the {gnu} {general} public license, version {2}"],
    "GPL-3.0": ["this work is licensed under the {gnu} {general} public license, version {3}", "this program is free software: you can redistribute it and/or modify it under the terms of the {gnu} {general} public license as published by the free software foundation, either version {3} of the license, or (at your option) any later version", GPL_HEADER],
    "LGPL-3.0": ["this work is licensed under the {gnu} {lesser} general public license, version {3}"],
    "ISC": [ISC_TEXT, "{permission} to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MIT": [f"{MIT_GRANT} {AS_IS_MIT}", "released under the {mit} license", '{permission} is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction'],
    "MPL-2.0": [MPL_HEADER, "this source code form is subject to the terms of the {mozilla} public license, v. {2.0}"],
    "Unlicense": [UNLICENSE_TEXT, "this is {free} and {unencumbered} software released into the public domain"],
    "Zlib": [ZLIB_TEXT],
}
TRIGGER = re.compile(rb"(?i:licen[sc]e|permission|redistribut|public domain|unencumbered|neither the name)")
_WORD, _WORD_BYTES = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Words that may join two versions of a license.
_JOIN = {"or", "and", "version", "v"}
MOST_DIFFERENT, GAP = 0.2, 45


class Template:
    """A notice, its words and those that must be there."""

    def __init__(self, name: str, notice: str, params: zstandard.ZstdCompressionParameters):
        bare = notice.replace("{", "").replace("}", "")
        dictionary = zstandard.ZstdCompressionDict(bare.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.name, self.compressor = name, zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)
        self.words = _WORD.findall(bare)
        self.needed = {w for braced in re.findall(r"\{([^}]*)\}", notice) for w in _WORD.findall(braced)}
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.places.setdefault(w, []).append(i)
        # the first place of each needed word is that in braces
        marks = sorted(self.places[w][0] for w in self.needed)
        self.marks, self.first, self.last = set(marks), marks[0], marks[-1]
        self.enough = math.ceil((1 - MOST_DIFFERENT) * len(self.words) - 1e-9)
        self.is_mark = np.isin(np.arange(len(self.words)), marks)
        self.after = np.cumsum(self.is_mark)  # marks up to a place, and before it
        self.rank = self.after - self.is_mark
        self.spots = {w: np.array(at) for w, at in self.places.items()}
        #: by word: the marks that must follow on the mark before them, or that are versions
        self.close = {w: [(n, i) for n, i in enumerate(at) if i in self.marks and i and (w[0].isdigit() or i - 1 in self.marks)] for w, at in self.places.items()}
        self.extent = 2 * len(self.words) + GAP
        self.bits = {w: sum(1 << i for i in at) for w, at in self.places.items()}

    def possible(self, present: set[str]) -> bool:
        """Whether a text of these words can hold the notice."""
        return self.needed <= present and sum(w in present for w in self.words) / len(self.words) >= 1 - MOST_DIFFERENT

    def longest(self, words: list[str]) -> int:
        """Words in the template's order, whatever the gaps: no alignment has more. One bit for each place of the template."""
        full = row = (1 << len(self.words)) - 1
        for w in words:
            if bits := self.bits.get(w):
                row = (row + (row & bits) | row & ~bits) & full
        return len(self.words) - row.bit_count()

    def exchanged(self, words: list[str]) -> list[int]:
        """Places of the equal words of as many words as the template's, from its first to its last; empty if too few."""
        if words[0] != self.words[0] or words[-1] != self.words[-1]:
            return []
        same = [k for k, (a, b) in enumerate(zip(words, self.words, strict=True)) if a == b]
        near = all(b - a <= GAP + 1 for a, b in itertools.pairwise(same))
        return same if len(same) >= self.enough and near and self.marks.issubset(same) else []

    def align(self, words: list[str]) -> list[int]:
        """Places of the most words that stand in the template's order, the latest and closest of these; empty if too few.

        best[j + GAP + 1, i] is the best alignment that ends with place i at word j: its last mark's number, its count and its
        first word, in one integer, so that the greatest of those before a place is also one that leaves no mark out.
        """
        size, m = GAP + 1, len(self.words)
        best = np.full((len(words) + size, m), -1, dtype=np.int64)
        mark = np.full(best.shape, -1, dtype=np.int32)
        back = np.full((*best.shape, 2), -1, dtype=np.int32)
        number, end, top = -1, None, (0, 0)
        for j, w in enumerate(words):
            if top[0] >= self.enough and j > end[0] + size:
                break  # nothing can be added to it: what follows is another notice
            if w in self.spots:
                spots = self.spots[w]
                ring = best[j : j + size]
                reached = np.maximum.accumulate(ring.max(axis=0))
                keys = np.where(spots > 0, reached[spots - 1], -1)
                cols = np.searchsorted(reached, keys)
                rows = ring[:, cols].argmax(axis=0)
                strict = w[0].isdigit() and number > -1 and not self._joined(words, number, j)
                for n, i in self.close.get(w, ()):
                    if strict or i - 1 in self.marks:
                        # marks side by side stay so; between a name and its version stands no other number
                        lo = size - 1 if i - 1 in self.marks else 0
                        part = np.where(mark[j + lo : j + size, :i] >= number, ring[lo:, :i], -1) if strict else ring[lo:, :i]
                        rows[n], cols[n] = np.unravel_index(part.argmax(), part.shape)
                        keys[n] = part[rows[n], cols[n]]
                        rows[n] += lo
                follows = keys >> 48 == self.rank[spots]  # all marks before the place are in it
                ok = follows | (self.rank[spots] == 0)
                own = np.where(follows, (keys & (1 << 48) - 1) + (1 << 32), 1 << 32 | j)
                here = j + size
                best[here, spots[ok]] = own[ok] + (self.after[spots[ok]] << 48)
                mark[here, spots[ok]] = np.where(self.is_mark[spots] | ~follows, j, mark[j + rows, cols])[ok]
                back[here, spots[follows]] = np.stack([rows + j - size, cols], axis=1)[follows]
                late = np.where(ok & (spots >= self.last), own, -1)
                key = int(late.max())
                if key >= 0 and (key >> 32, (key & 0xFFFFFFFF) - j) > top:
                    top, end = (key >> 32, (key & 0xFFFFFFFF) - j), (j, int(spots[late.argmax()]))
            if w[:1].isdigit():
                number = j
        found, gained = [], 0
        while top[0] >= self.enough and end[1] >= 0:
            place = tuple(back[end[0] + size, end[1]].tolist())
            found, gained = [*found, end[0]], gained + 1
            if place[1] >= self.last and end[0] - place[0] - 1 > gained and top[0] - gained >= self.enough:
                top, found, gained = (top[0] - gained, 0), [], 0  # last words that stand farther off than they are many
            end = place
        return found[::-1]

    @staticmethod
    def _joined(words: list[str], number: int, j: int) -> bool:
        """Whether the numbers at these places are versions joined by or."""
        between = set(words[number + 1 : j])
        return between <= _JOIN and bool({"or", "and"} & between)

    def notices(self, words: list[str], first: int, taken: set[int]) -> Iterator[list[int]]:
        """Places of the aligned words of each occurrence: first those word for word or with words exchanged, then those with
        words added or left out.

        An occurrence counts only if a word that tells the license apart is not taken, so the others are sought near these.
        """
        size, parts, j = len(self.words), [[0, len(words)]], 0
        while j + size <= len(words):
            if words[j + self.first] == self.words[self.first] and (same := self.exchanged(words[j : j + size])):
                yield [first + j + k for k in same]
                parts[-1][1] = j
                j += size
                parts.append([j, len(words)])
            else:
                j += 1
        near: list[list[int]] = []
        for lo, hi in parts:
            for k in range(lo, hi):
                if words[k] in self.needed and first + k not in taken:
                    if near and near[-1][0] >= lo and k - self.extent <= near[-1][1]:
                        near[-1][1] = min(hi, k + self.extent)
                    else:
                        near.append([max(lo, k - self.extent), min(hi, k + self.extent)])
        words = list(words)
        while near:
            lo, hi = near.pop()
            part = words[lo:hi]
            if not self.possible(set(part)) or all(w not in self.needed or first + lo + k in taken for k, w in enumerate(part)):
                continue
            if self.longest(part) >= self.enough and (found := self.align(part)):
                yield [first + lo + k for k in found]
                # the last words may have been taken from the head of the next notice, which goes on without them
                for k in found:
                    words[lo + k] = ""
                near += [[lo, lo + found[0]], [lo + found[0] + 1, hi]]


class LicenseScanner:
    """Templates with their compressors; made once in each Python worker."""

    def __init__(self) -> None:
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        params = zstandard.ZstdCompressionParameters.from_level(3, **plain)
        self.templates = [Template(name, notice, params) for name, notices in sorted(TEMPLATES.items()) for notice in notices]
        self.reach = 2 * max(len(t.words) for t in self.templates)

    def ranked(self, block: bytes, present: set[str]) -> list[Template]:
        """The templates that the block may hold, those first that save most bytes of it as dictionary."""
        possible = [t for t in self.templates if t.possible(present)]
        raw = b" ".join(block.split())
        return sorted(possible, key=lambda t: (self.size(t, raw), t.name)) if len(possible) > 1 else possible

    @staticmethod
    def size(template: Template, raw: bytes) -> int:
        """Bytes of a text with the template as dictionary; what a block takes alone is the same for all templates."""
        return len(template.compressor.compress(raw))

    def stretches(self, text: bytes, starts: list[int]) -> list[tuple[int, int]]:
        """First and end of the words within reach of a trigger, joined where they overlap."""
        found: list[tuple[int, int]] = []
        for m in TRIGGER.finditer(text):
            at = bisect.bisect_right(starts, m.start()) - 1
            lo, hi = max(0, at - self.reach), min(len(starts), at + self.reach + 1)
            if found and lo <= found[-1][1]:
                found[-1] = (found[-1][0], hi)
            else:
                found.append((lo, hi))
        return found

    def scan(self, text: bytes) -> list[tuple[str, int, int, float]]:
        """(license, start, end, likeness) of each notice, start and end in bytes."""
        if not TRIGGER.search(text):
            return []
        low = text.lower()
        places = [m.span() for m in _WORD_BYTES.finditer(low)]
        found: list[tuple[str, int, int, float]] = []
        holder: dict[int, set[str]] = {}  # by place: names of the notices confirmed that have it
        for lo, hi in self.stretches(text, [a for a, _ in places]):
            for at in range(lo, hi, 3 * self.reach):
                # a notice that begins in this step is whole in the block; one that begins later is the next block's
                words = [low[a:b].decode() for a, b in places[at : min(hi, at + 4 * self.reach)]]
                step = hi if at + 4 * self.reach >= hi else at + 3 * self.reach
                own: dict[int, set[str]] = {}
                for t in self.ranked(low[places[at][0] : places[at + len(words) - 1][1]], set(words)):
                    taken = {k for k in range(at, at + len(words)) if k in holder or k in own}
                    free = ["" if t.name in holder.get(at + k, ()) else w for k, w in enumerate(words)]
                    for notice in t.notices(free, at, taken):
                        marks = [k for k in notice if words[k - at] in t.needed]
                        names = set().union(*(names.get(k, ()) for k in notice for names in (holder, own)))
                        if notice[-1] - notice[0] >= t.extent or t.name in names or taken.issuperset(marks):
                            continue
                        for k in notice:
                            own.setdefault(k, set()).add(t.name)
                        if notice[0] < step:
                            found.append((t.name, places[notice[0]][0], places[notice[-1]][1], len(notice) / len(t.words)))
                            for k in notice:
                                holder.setdefault(k, set()).add(t.name)
                if step == hi:
                    break
        lines = []
        for name, begin, end, likeness in found:
            stop = text.find(b"\n", end)
            lines.append((name, text.rfind(b"\n", 0, begin) + 1, stop if stop >= 0 else len(text), likeness))
        return sorted(lines, key=lambda f: (f[1], f[2], f[0]))


_SCANNERS: list[LicenseScanner] = []


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the licenses found (distinct, sorted), spans (name:start:end in code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNERS:
            _SCANNERS.append(LicenseScanner())
        for batch in batches:
            rows = []
            for text in texts_as_bytes(batch, "text"):
                found = _SCANNERS[0].scan(text)
                spans = [f"{n}:{a}:{b}" for a, b, n in code_points(text, [(a, b, n) for n, a, b, _ in found])]
                rows.append((sorted({n for n, _, _, _ in found}), ",".join(spans), min((s for *_, s in found), default=None)))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            kinds = [pa.list_(pa.string()), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "licenses", "spans", "likeness"])

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(run, "doc_id long, licenses array<string>, spans string, likeness double")
