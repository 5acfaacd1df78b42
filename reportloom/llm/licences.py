"""License scans with DataFrame functions only: normalised text against licence templates by Dice over word bigrams.

A document is scanned as a whole, by paragraphs (set off by blank lines) and by lines, so that a licence file, a header
and a single notice line are each compared as one piece, and by windows, so that a licence within more text or a notice
within a line is compared, too. A window has the number of words of a template and begins where an eighth or more of the
template's bigrams would have it begin, by the places at which text and template hold them. Dice(a, b) = 2 |a n b| /
(|a| + |b|) over the distinct bigrams of a piece or window and of a template (the single word, for one word).

Dice >= t needs |a| within t / (2 - t) and (2 - t) / t of |b|: pieces outside of these bounds of all templates are dropped
before bigrams are made, templates outside for a piece are not compared. A match shares at least t |b| / (2 - t) bigrams:
texts that do not hold as many of a template have no windows of it. A piece or window that reaches t also holds one word
of each template's shortest set of bigrams that a match cannot miss; texts and pieces without one are dropped, too. One
pass, no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: Notices and short licence texts in their published words. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "AGPL-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.',
    "LGPL-2.1-header": 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: How text is brought to words: lower case, any run of what is neither letter nor digit parts words. Fixed value.
APART = r"[^\p{L}\p{N}]+"


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> list[str]:
    w = words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w))


#: Words that many texts hold. Fixed values.
COMMON = frozenset("a an and as at be by for from in is it of on or that the this to was with you".split())


def least_shared(size: int, least: float) -> int:
    """How many of a template's bigrams a match shares at least, since it is no smaller than what it shares."""
    return max(1, -(-int(least * size / (2 - least) * 1e6) // 10**6))


def votes(size: int) -> int:
    """How many places of bigrams, an eighth of a template's, must agree on where a window begins."""
    return max(1, -(-size // 8))


def needed(grams: list[str], least: float) -> set[str]:
    """First words of the fewest bigrams of which any match shares one: all but (the least shared) - 1, rarer words first."""
    shared = least_shared(len(grams), least)
    rare_first = sorted(grams, key=lambda g: (g.split()[0] in COMMON, -len(g.split()[0]), g))
    return {g.split()[0] for g in rare_first[: len(grams) - shared + 1]}


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def _pairs(w: Column) -> Column:
    return F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))


def _dice(grams: Column, t: Column) -> Column:
    return F.round(2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["size"]), 6)


def _windows(in_words: Column, table: Column, every: Column) -> Column:
    """(license, dice) of the windows of a text's words."""

    def scored(w: Column, t: Column, held: Column) -> Column:
        starts = F.flatten(F.transform(held, lambda h: F.transform(F.filter(t["places"], lambda p: p["gram"] == h["gram"]), lambda p: F.greatest(h["i"] - p["k"], F.lit(0)))))
        agreed = _let(F.array_sort(starts), lambda v: F.array_distinct(F.filter(v, lambda x, i: F.get(v, i + t["votes"] - 1) == x)))
        grams = lambda s: F.array_distinct(_pairs(F.slice(w, s + 1, t["n_words"])))
        return F.transform(agreed, lambda s: _let(grams(s), lambda g: F.struct(t["license"].alias("license"), _dice(g, t).alias("dice"))))

    def of_text(w: Column, grams: Column) -> Column:
        known = F.array_intersect(grams, every)
        able = lambda k: F.filter(table, lambda t: F.size(F.array_intersect(k, t["grams"])) >= t["shared"])
        held = lambda k: F.filter(F.transform(grams, lambda g, i: F.struct(i.alias("i"), g.alias("gram"))), lambda h: F.array_contains(k, h["gram"]))
        return _let(known, lambda k: _let(able(k), lambda ts: F.when(F.size(ts) > 0, _let(held(k), lambda h: F.flatten(F.transform(ts, lambda t: scored(w, t, h)))))))

    return _let(in_words, lambda w: F.when(F.size(w) > 1, _let(_pairs(w), lambda g: of_text(w, g))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and licence found: doc_id, license, score (best Dice, 6 places), n_pieces (distinct pieces), n_windows.

    Null and empty texts hold none. A piece that fits several templates counts for each. Repeated rows are reported each.
    Extra columns are not read. Templates without a word are left out, those of one word have no windows; they are constants
    of the query, not data. A licence that begins a text may have its window begin there, although words before are missing.
    """
    known = {k: t for k, t in (TEMPLATES if templates is None else templates).items() if words(t)}
    rows = []
    for k, t in sorted(known.items()):
        g, w = bigrams(t), words(t)
        places = [{"gram": f"{x} {y}", "k": i} for i, (x, y) in enumerate(zip(w, w[1:], strict=False))]
        rows.append({"license": k, "size": len(g), "grams": g, "n_words": len(w), "shared": least_shared(len(g), least), "votes": votes(len(g)), "places": places})
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    if not rows:
        return out.where("false").select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("score"), F.lit(0).alias("n_pieces"), F.lit(0).alias("n_windows"))
    kind = "array<struct<license:string,size:int,grams:array<string>,n_words:int,shared:int,votes:int,places:array<struct<gram:string,k:int>>>>"
    table, placed = (F.from_json(F.lit(json.dumps(x)), kind) for x in (rows, [r for r in rows if r["places"]]))
    ratio = least / (2 - least)
    low, high = int(min(r["size"] for r in rows) * ratio), int(max(r["size"] for r in rows) / ratio) + 1
    must = sorted(set().union(*(needed(r["grams"], least) for r in rows)))
    text_col = F.lower(F.col("text"))
    some = lambda w: F.arrays_overlap(w, _texts(must))
    out = out.where(some(F.split(text_col, APART)))
    pieces = F.concat(F.split(text_col, r"\n"), F.split(text_col, r"\n[ \t\r\f]*\n\s*"), F.array(text_col))
    in_words = lambda p: F.filter(F.split(p, APART), lambda w: w != "")
    # distinct bigrams may be fewer than words: only the lower bound holds for the number of words
    fits = F.filter(F.array_distinct(F.transform(pieces, in_words)), lambda w: (F.size(w) >= low) & some(w))
    made = F.transform(fits, lambda w: F.when(F.size(w) > 1, F.array_distinct(_pairs(w))).otherwise(w))
    sized = F.filter(made, lambda g: (F.size(g) >= low) & (F.size(g) <= high))
    near = lambda g: F.filter(table, lambda t: (F.size(g) >= t["size"] * ratio - 1e-9) & (F.size(g) * ratio <= t["size"] + 1e-9))
    scored = F.flatten(F.transform(sized, lambda g: F.transform(near(g), lambda t: F.struct(t["license"].alias("license"), _dice(g, t).alias("dice")))))
    no_hits = F.array().cast("array<struct<license:string,dice:double>>")
    windows = F.coalesce(_windows(in_words(text_col), placed, _texts(sorted({p["gram"] for r in rows for p in r["places"]}))), no_hits)
    good = lambda hits: F.filter(hits, lambda x: x["dice"] >= least)
    out = out.select("doc_id", good(scored).alias("hits"), good(windows).alias("seen"))
    found = F.array_distinct(F.transform(F.concat("hits", "seen"), lambda x: x["license"]))
    out = out.select("doc_id", "hits", "seen", F.explode(found).alias("license"))
    own = lambda hits: F.filter(hits, lambda x: x["license"] == F.col("license"))
    best = F.array_max(F.transform(own(F.concat("hits", "seen")), lambda x: x["dice"]))
    return out.select("doc_id", "license", best.alias("score"), F.size(own(F.col("hits"))).alias("n_pieces"), F.size(own(F.col("seen"))).alias("n_windows"))
