"""Licence scan: normalised passages against templates, by the Dice coefficient of their word bigrams."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import one_of
from gleaner.llm.common import apart

#: Public licence texts, paragraph by paragraph, and notices in their usual wording. A key names a licence; with "#" and a
#: number, one of its passages.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#2": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.',
    "Apache-2.0#3": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0#4": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause#2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-2-Clause#3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-2-Clause#4": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0#2": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0#2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0#2": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0#3": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT#2": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MIT#3": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT#4": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT#5": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0#2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: What parts a text into paragraphs (lines without a letter or digit) and into sentences. scan tells the same places from the run of other
#: characters between two words, as these patterns may look at a long run again and again.
PARAGRAPHS = r"\n[^A-Za-z0-9]*\n"
SENTENCES = rf"[.!?;][^A-Za-z0-9]*[ \t\n\r]|{PARAGRAPHS}"
THRESHOLD = 0.9


#: Of a run of other characters: two line ends; one, and the end of a sentence; the latter only; one line end. Each is tried where a run starts,
#: and gives nothing back, so a run is looked at a fixed number of times, however long, and nothing is matched by recursion.
_START, _OTHER = "(?<![^A-Za-z0-9])", "[^A-Za-z0-9]*+"
_STOP = rf"[^A-Za-z0-9.!?;]*+[.!?;][^A-Za-z0-9 \t\n\r]*+[ \t\n\r]{_OTHER}"
_ENDS = (
    ("P", rf"{_START}[^A-Za-z0-9\n]*+\n[^A-Za-z0-9\n]*+\n{_OTHER}"),
    ("B", rf"{_START}(?=[^A-Za-z0-9\n]*+\n){_STOP}"),
    ("S", rf"{_START}{_STOP}"),
    ("L", rf"{_START}[^A-Za-z0-9\n]*+\n{_OTHER}"),
    (" ", "[^A-Za-z0-9]++"),
)


def passages_of(text: Column) -> Column:
    """The lines, sentences and paragraphs of a text, each in normal form: words apart by one space. The text is normalised once, with a capital letter
    for what parts it, as no others are left then."""
    marked = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for mark, pattern in _ENDS:
        marked = F.regexp_replace(marked, pattern, mark)
    cut = lambda m: F.concat(*[F.split(F.translate(m, inside, " " * len(inside)), f"[{ends}]") for ends, inside in (("PBL", "S"), ("PBS", "L"), ("P", "BSL"))])
    # Within a lambda the marked text is made once, for all three.
    return F.transform(F.flatten(F.transform(F.array(marked), cut)), lambda x: F.trim(x))


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order."""
    words = re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def needles(grams: list[list[str]], threshold: float) -> list[str]:
    """Words of templates, given by their bigrams, of which every passage that reaches the threshold for one of them has one at least.

    Such a passage has t / (2 - t) of the template's bigrams at least; so one that lacks all words of more than the rest cannot reach t.
    Long words come first, as they are rare; a word that holds another needle is not needed.
    """
    words = [{w for g in own for w in g.split()} for own in grams]
    found: set[str] = set()
    for own, names in zip(grams, words):
        may_lack, out = (1 - threshold / (2 - threshold)) * len(own), set()
        for word in sorted(names, key=lambda w: (-len(w), w)):
            if sum(any(w in out for w in g.split()) for g in own) > may_lack:
                break
            out.add(word)
        found |= out
    return sorted(w for w in found if not any(v != w and v in w for v in found))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with license (null: none found), dice of the best passage, and license_passages, how many different ones reach the threshold.

    Passages are the lines, the sentences and the paragraphs of a text, so a notice may be wrapped over lines, marked as a comment, or
    stand among others. All word bigrams of a passage, repeats included, are compared with the different ones of a template only if their
    numbers are within t / (2 - t) and its inverse of each other; outside that the coefficient cannot reach t. So most passages are dropped on
    the number of their words, or as they have none of the needles, and most texts before they are cut at all. Ties go to the
    licence that sorts first. A null or empty text, or one in which nothing reaches the threshold, has null, null and 0; an empty table has no
    rows, and each row is told for itself, whether it repeats or not. Texts of any length are taken whole, in time that follows
    their length, whatever they are made of. Columns of those three names, in any case, are replaced. Nothing is shuffled.
    """
    own_docs, back = apart(docs, (text,), ("license", "dice", "license_passages"))
    own = [(k.split("#")[0], b) for k, v in sorted(templates.items()) if (b := bigrams(v))]
    if not own:
        return back(own_docs, license=F.lit(None).cast("string"), dice=F.lit(None).cast("double"), license_passages=F.lit(0))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    fewest, most = min(len(b) for _, b in own) * low, max(len(b) for _, b in own) * high
    # One literal, so that plans stay small however many templates there are.
    known = json.dumps([{"license": k, "n": len(b), "grams": b} for k, b in own])
    known = F.from_json(F.lit(known), "array<struct<license: string, n: int, grams: array<string>>>")
    hint = one_of(needles([b for _, b in own], threshold))
    whole = F.coalesce(F.col(text), F.lit(""))
    gaps = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    passages = F.filter(passages_of(whole), lambda x: gaps(x).between(fewest, most) & x.rlike(hint))
    words = F.transform(F.array_distinct(passages), lambda x: F.split(x, " "))
    grams = F.transform(words, lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))

    def best_of(g: Column) -> Column:
        near = F.filter(known, lambda t: F.size(g).between(t["n"] * low, t["n"] * high))
        # The least of these is the highest coefficient, and of equal ones the licence that sorts first.
        return F.array_min(F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("less"), t["license"].alias("license"))))

    hits = F.filter(F.transform(grams, best_of), lambda s: s["less"] <= -threshold)
    hits = F.when(F.lower(whole).rlike(hint), hits).otherwise(F.array().cast("array<struct<less: double, license: string>>"))
    best = F.array_min("__gleaner_hits")
    found = own_docs.withColumn("__gleaner_hits", hits)
    return back(found, license=best["license"], dice=-best["less"], license_passages=F.size("__gleaner_hits"))
