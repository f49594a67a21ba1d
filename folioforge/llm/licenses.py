"""License scans by conditional compression.

Candidate blocks of a text are its paragraphs that hold a license cue (parts of very long ones, around the cues). A block is
compressed with zstandard alone and with each license template as a raw dictionary; what the dictionary saves ranks the
templates. All that save anything are confirmed, or dropped, by the exact differences in wording between the
template and the place in the block where it stands; of templates at one place the best ranked stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import map_arrow
from .common import table, text_or_empty

_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."


def _gnu(name: str, version: str) -> tuple[str, ...]:
    short = f"This work is licensed under the GNU {name}, version {version}."
    return short, _GNU.format(name, version), f"{_GNU.format(name, version)} {_GNU_WARRANTY.format(name)}"


def _cc(code: str, name: str) -> tuple[str, ...]:
    return f"Licensed under CC {code} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"Creative Commons {name} 4.0 International"


#: Wordings of common licenses by SPDX id: short notices, opening passages, and whole texts where these are short. Fixed values.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        _MIT,
        f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": _gnu("General Public License", "3"),
    "GPL-2.0": _gnu("General Public License", "2"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "BSD": (_BSD,),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", f"{_BSD} {_BSD_2}", f"{_BSD} {_BSD_2} {_AS_IS}"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", f"{_BSD} {_BSD_2} {_BSD_3}", f"{_BSD} {_BSD_2} {_BSD_3} {_AS_IS}"),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC0-1.0": ("Released under CC0 1.0 Universal.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
CUE = re.compile(r"licen[sc]|copyright|permission is hereby|permission to use|redistribution and use|public domain|free software|creative commons|all rights reserved|released under|\bcc0\b|source code form", re.I)
WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
LEVEL = 3
#: The share of a template's words that must stand in the block, in order, and how many in a row may be missing or put in.
MIN_WORDS, MAX_RUN = 0.8, 8
#: A longer block is taken in parts: this much around each cue, joined where they overlap.
MOST_CHARS, BEFORE, AFTER = 6000, 500, 1500
FINDING = "doc_id long, block int, start int, license string, saved_bytes int, plain_bytes int, score double, missing string, extra string"


def blocks(text: str) -> list[tuple[int, str]]:
    """(start, text) of the candidate blocks: paragraphs with a cue, long ones in parts.

    A paragraph with a cue is joined to one with a cue right before it, since whole licenses run over paragraphs.
    """
    cues = [m.start() for m in CUE.finditer(text)]
    if not cues:
        return []
    spans: list[list[int]] = []
    edges = [(0, 0), *((m.start(), m.end()) for m in BLANK.finditer(text)), (len(text), len(text))]
    joined = False
    for (_, a), (b, _) in zip(edges, edges[1:], strict=False):
        if bisect_left(cues, a) == bisect_left(cues, b):
            joined = False
            continue
        if joined and b - spans[-1][0] <= MOST_CHARS:
            spans[-1][1] = b
        else:
            spans.append([a, b])
        joined = True
    out: list[list[int]] = []
    for a, b in spans:
        if b - a <= MOST_CHARS:
            out.append([a, b])
            continue
        own = len(out)
        for cue in cues[bisect_left(cues, a) : bisect_left(cues, b)]:
            s, e = max(a, cue - BEFORE), min(b, cue + AFTER)
            if len(out) > own and s < out[-1][1] and e - out[-1][0] <= MOST_CHARS:
                out[-1][1] = e
            elif len(out) == own or cue >= out[-1][1] - AFTER // 2:  # else it stands in the last part, with room
                out.append([s, e])
    return [(a, text[a:b]) for a, b in out]


@lru_cache(maxsize=1)
def _templates() -> list[tuple[str, list[str], zstandard.ZstdCompressor]]:
    out = []
    for name, texts in TEMPLATES.items():
        for t in texts:
            raw = zstandard.ZstdCompressionDict((" ".join(t.lower().split()) + "\n").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, WORDS.findall(t.lower()), zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_dict_id=False, write_checksum=False, write_content_size=False)))
    return out


def _runs(flags: list[bool]) -> int:
    longest = run = 0
    for f in flags:
        run = run + 1 if f else 0
        longest = max(longest, run)
    return longest


def wording(template: list[str], words: list[str]) -> tuple[float, list[str], list[str], int, int, int]:
    """How a template stands in `words`, at the place round their longest common run.

    The share of its words that stand there in order, those missing, those put between them, from where to where, and
    the longest run of words missing or put in.
    """
    match = SequenceMatcher(None, template, words, autojunk=False)
    anchor, slack = match.find_longest_match(), 3 + len(template) // 4
    from_ = max(0, anchor.b - anchor.a - slack)
    place = words[from_ : anchor.b - anchor.a + len(template) + slack]
    same = [m for m in SequenceMatcher(None, template, place, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return 0.0, template, [], 0, 0, len(template)
    held, used = {i for m in same for i in range(m.a, m.a + m.size)}, {i for m in same for i in range(m.b, m.b + m.size)}
    inside = range(same[0].b, same[-1].b + same[-1].size)
    longest = max(_runs([i not in held for i in range(len(template))]), _runs([i not in used for i in inside]))
    return len(held) / len(template), [w for i, w in enumerate(template) if i not in held], [place[i] for i in inside if i not in used], from_ + inside.start, from_ + inside.stop, longest


def telling(word: str) -> bool:
    """Words that tell licenses of one family apart: with a digit, or part of a license's name."""
    return any(c.isdigit() for c in word) or word in _NAMES


_NAMES = frozenset("mit apache gnu lesser library affero mozilla bsd isc cc cc0 by by-sa by-nc by-nd by-nc-sa by-nc-nd creative commons attribution sharealike noncommercial noderivatives noderivs".split())
_NAMES |= {f"attribution-{x}" for x in ("sharealike", "noncommercial", "noderivatives", "noderivs", "noncommercial-sharealike", "noncommercial-noderivatives", "noncommercial-noderivs")}


def parts(block: str) -> list[tuple[int, str]]:
    """(words before it, text) of what is compressed of a block: the whole, each line with a cue, and such a line with
    its neighbours. A short notice would be lost in the noise of a long block's size."""
    lines = block.split("\n")
    if len(lines) == 1:
        return [(0, block)]
    before = [0, *accumulate(len(WORDS.findall(x)) for x in lines)]
    near = [(max(0, k - d), k + d + 1) for k, x in enumerate(lines) if CUE.search(x) for d in (0, 1)]
    return [(0, block), *((before[a], "\n".join(lines[a:b])) for a, b in dict.fromkeys(near))]


def classify(block: str, min_words: float = MIN_WORDS) -> list[tuple[str, int, int, float, list[str], list[str]]]:
    """Confirmed licenses of one block: (license, bytes saved, bytes without dictionary, share of words, missing, extra).

    Templates are ranked by the bytes saved on a part of the block, and all that save any are compared word by word.
    Confirmed are those that have `min_words` of the template at one place, MAX_RUN words in a row neither missing nor put
    in, and no telling word missing or put in. Of those whose places overlap the best ranked stays; one finding per
    license.
    """
    ranked = []
    for at, part in parts(block):
        flat, words = " ".join(part.lower().split()).encode("utf-8", "replace"), WORDS.findall(part.lower())
        plain = len(zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False).compress(flat))
        there = set(words)
        for name, template, c in _templates():
            saved = plain - len(c.compress(flat))
            if saved > 0 and sum(w in there for w in template) >= min_words * len(template):
                ranked.append((saved, plain, name, template, at, words))
    out, taken = [], []
    for saved, plain, name, template, at, words in sorted(ranked, key=lambda x: (-x[0], x[2], x[4])):
        share, missing, extra, a, b, longest = wording(template, words)
        if share < min_words or longest >= MAX_RUN or any(map(telling, missing)) or any(map(telling, extra)):
            continue
        if not any(at + a < y and x < at + b for x, y in taken) and name not in [o[0] for o in out]:
            out.append((name, saved, plain, share, missing, extra))
        taken.append((at + a, at + b))
    return out


def find_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: float = MIN_WORDS) -> DataFrame:
    """One row per confirmed license of each block: (doc_id, block, start, license, saved_bytes, plain_bytes, score, missing, extra).

    Blocks are numbered from 0 and start at a code point of the whole text. Null and empty texts have no blocks. Every
    row of `docs` stands for itself; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("start", pa.int32()), ("license", pa.string()), ("saved_bytes", pa.int32()), ("plain_bytes", pa.int32()), ("score", pa.float64()), ("missing", pa.string()), ("extra", pa.string())])
        memo: dict[str, list] = {}
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, (start, block) in enumerate(blocks(text)):
                    if block not in memo:
                        if len(memo) > 5000:
                            memo.clear()
                        memo[block] = classify(block, min_words)
                    for name, saved, plain, share, missing, extra in memo[block]:
                        rows.append((doc, k, start, name, saved, plain, share, " ".join(missing), " ".join(extra)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    found = map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, FINDING)
    return found.withColumnRenamed("doc_id", id_col)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))
