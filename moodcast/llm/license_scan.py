"""License scan by canonical digest lookup.

A text is brought to a canonical form (lower case; copyright lines dropped;
equivalent spellings replaced; everything but letters and digits one space) and
its MD5 digest is joined with the digests of known licence texts and notices.
The whole text of a document is looked up, and so is each of its paragraphs and
lines, as notices stand in larger documents. A licence of several paragraphs in a
larger document is looked up as well: from each paragraph that begins like a known
text, the paragraphs whose canonical forms are together as long as that text. So are
the comments of source files: block comments and lines with a comment mark, with
paragraphs where a line is empty or has marks only. The known texts are the notices below and the published texts in ``licenses/``, with
and without their titles and what follows their terms.

Defined cases: null and empty texts match nothing, and so do units without a
letter or digit; a run of paragraphs is one of at least two and not the whole text; one found as a run
has ``ANCHOR`` characters or more; a licence whose comment is the whole text is found as text and as comment; a text of one paragraph or one line is looked up once, as a
text, and a paragraph of one line as a line; repeated rows are scanned each; null ids stay
null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodcast.llm.common import let, quoted, running

# Licence names, texts and notices as published.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC),
    ("BSD-2-Clause", BSD2),
    ("Apache-2.0", APACHE_HEADER),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# BSD-3-Clause: the third condition between the second and the disclaimer
_BSD_HEAD, _BSD_END = BSD2.split("\nTHIS SOFTWARE", 1)
BSD3 = (_BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE" + _BSD_END)
TITLED = (("ISC", "ISC License\n" + ISC), ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD2), ("BSD-3-Clause", BSD3),
          ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD3))
PUBLISHED = Path(__file__).parent / "licenses"   # name.txt
TERMS_END = "END OF TERMS AND CONDITIONS"
PARAGRAPH = r"\n[ \t]*\n\s*"
ANCHOR = 24   # first characters of a canonical form that mark where a known text may begin
# Equivalent spellings, each replaced as whole words by the second.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("favour", "favor"), ("judgement", "judgment"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("sub license", "sublicense"), ("per cent", "percent"),
    ("v 2", "version 2"), ("v 3", "version 3"), ("v2", "version 2"), ("v3", "version 3"),
    ("https", "http"), ("copyright holders", "copyright holder"), ("copyright owner", "copyright holder"),
)
# What follows "copyright" in licence terms, and words that stand in a holder's line.
TERMS_AFTER = ("notice", "notices", "holder", "holders", "owner", "owners", "and", "or", "law", "laws", "license", "licenses",
               "licence", "licences", "interest", "interests", "in", "is", "of", "to", "on", "for", "as", "that", "which",
               "statement", "statements", "treaty", "act", "protection", "doctrine", "disclaimer")
HOLDER_WORDS = ("inc", "ltd", "llc", "corp", "corporation", "company", "gmbh", "foundation", "project", "authors", "author",
                "contributors", "developers", "developer", "team", "university", "institute", "et al", "[12][0-9]{3}")
COPYRIGHT_LINE = (
    r"(?m)^[^A-Za-z0-9\n]*(?:(?:portions )?copyright\b(?:[^A-Za-z\n]*(?:\(c\)|©|[0-9])|"
    rf"(?! (?:{'|'.join(TERMS_AFTER)})\b) [^\n]*\b(?:{'|'.join(HOLDER_WORDS)})\b)|\(c\) |© ?[0-9]|all rights reserved)[^\n]*$")
NOT_A_WORD = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\u0080-\u00bf\u2000-\u206f]+"
# comments: blocks, lines that begin with a mark, lines of marks only
COMMENTED = r"(?m)^[ \t]*(?:/\*|//|#|;|--|%)"
COMMENT_BLOCK = r"/\*[\s\S]*?\*/"
CODE_LINE = r"(?m)^(?![ \t]*(?://|#|;|--|%))[^\n]*$"
MARKS_ONLY = r"(?m)^[ \t]*(?:/\*+!?|\*+/?|//+|#+|;+|--+|%+)[ \t]*$"


def _plain(text: str) -> str:
    """SQL: words of a-z, 0-9 and other letters between single spaces, without copyright lines."""
    return (f"trim(regexp_replace(regexp_replace(lower({text}), {quoted(COPYRIGHT_LINE)}, ' '), {quoted(NOT_A_WORD)}, ' '))")


def _spelled(form: str, spellings: tuple[tuple[str, str], ...] = SPELLINGS) -> str:
    """SQL: ``form`` with equivalent spellings replaced, one after the other."""
    for old, new in spellings:
        form = f"regexp_replace({form}, r'\\b{old}\\b', '{new}')"
    return form


def _has_spelling(form: str, spellings: tuple[tuple[str, str], ...] = SPELLINGS) -> str:
    first = "".join(sorted({old[0] for old, _ in spellings}))
    return f"{form} rlike r'\\b(?=[{first}])(?:{'|'.join(old for old, _ in spellings)})\\b'"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "), NOT_A_WORD, " "))
    first = "".join(sorted({old[0] for old, _ in SPELLINGS}))
    spelled = rf"\b(?=[{first}])(?:{'|'.join(old for old, _ in SPELLINGS)})\b"

    def step(c: Column) -> Column:
        out = c
        for old, new in SPELLINGS:
            out = F.regexp_replace(out, rf"\b{old}\b", new)
        return F.when(c.rlike(spelled), out).otherwise(c)

    return F.get(F.transform(F.array(plain), step), F.lit(0))   # the plain form is computed once


def _paragraphs(text: str) -> str:
    """SQL: canonical forms of all paragraphs (an empty one for those without a word)."""
    plain = f"transform(split({text}, {quoted(PARAGRAPH)}), x -> {_plain('x')})"
    return let("pp", plain, f"if({_has_spelling('array_join(pp, chr(10))')}, transform(pp, x -> {_spelled('x')}), pp)")


def published() -> tuple[tuple[str, str], ...]:
    """``(license, text)`` of the published texts: whole and up to the end of the terms, with and without the title."""
    out = list(TITLED)
    for path in sorted(PUBLISHED.glob("*.txt")):
        text = path.read_text(encoding="utf-8").strip()
        ends = [text] + [text[:text.index(mark) + k] for mark in (TERMS_END,) if mark in text for k in (0, len(mark))]
        for t in ends:
            out += [(path.stem, t), (path.stem, re.split(r"\n[ \t]*\n\s*", t, maxsplit=1)[1])]
    return tuple(out)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """``(digest, license, anchor, n_chars)`` of the known texts, ``KNOWN`` and ``published()`` if not given;
    the last two are the first characters and the length of the canonical form."""
    rows = list(KNOWN + published() if known is None else known)
    joined = F.expr(f"array_join(filter({_paragraphs('text')}, c -> c != ''), ' ')")
    return (spark.createDataFrame(rows, "license string, text string")
            .select("license", F.explode(F.array(canonical(F.col("text")), joined)).alias("c"))
            .select(F.md5("c").alias("digest"), "license", F.substring("c", 1, ANCHOR).alias("anchor"),
                    F.length("c").alias("n_chars")).distinct())


_NO_UNITS = "cast(array() as array<struct<unit:string,position:int,c:string>>)"


def _runs(forms: str, unit: str, least: int, lengths: str) -> str:
    """SQL: units of the runs of at least ``least`` paragraphs that are as long as a known text with the same
    beginning (``lengths``: a map from beginnings to lengths), but for the run of all paragraphs.

    ``fe`` holds the end of each paragraph in the joined forms, so the paragraphs of
    a known length are found by position; no run is joined but those looked up.
    """
    start = "if(i = 0, 0, get(fe, i - 1))"
    # a run of n characters has at most n div 2 + 1 paragraphs
    count = f"cast(array_position(slice(fe, i + 1, n div 2 + 1), {start} + n + 1) as int)"
    run = (f"transform(filter(transform(element_at(lm, get(fa, i)), n -> named_struct('i', i, 'k', {count})), "
           f"r -> r.k >= {least} and (r.i > 0 or r.k < size(fp) or {least} = 1)), "
           f"r -> named_struct('unit', '{unit}', 'position', r.i, 'c', array_join(slice(fp, r.i + 1, r.k), ' ')))")
    at = "filter(sequence(0, size(fp) - 1), i -> map_contains_key(lm, get(fa, i)))"
    # the first characters from each paragraph on
    begin = (f"transform(fp, (c, i) -> substring(if(length(c) >= {ANCHOR}, c, array_join(transform("
             f"slice(fp, i + 1, {ANCHOR // 2 + 1}), x -> substring(x, 1, {ANCHOR})), ' ')), 1, {ANCHOR}))")
    body = let("fe", running("transform(fp, c -> length(c) + 1)", "{a} + {b}"),
               let("fa", begin, f"flatten(transform({at}, i -> {run}))"))
    return let("lm", lengths, let("fp", f"filter({forms}, c -> c != '')", f"if(size(fp) = 0, {_NO_UNITS}, {body})"))


def _units(text: str, lengths: str) -> str:
    """SQL: all units of a text with their canonical forms (empty ones are left out)."""
    lines = let("ls", "split(tx, chr(10))", let("lu", f"transform(ls, x -> {_plain('x')})", let(
        "lj", "array_join(filter(lu, c -> c != ''), ' ')", let("lg", _has_spelling("lj"), f"""concat(
            array(named_struct('unit', 'text', 'position', 0, 'c', if(lg, {_spelled('lj')}, lj))),
            if(size(ls) > 1, transform(lu, (c, i) -> named_struct('unit', 'line', 'position', i, 'c', if(lg, {_spelled('c')}, c))),
               {_NO_UNITS}))"""))))
    paragraphs = let("pt", f"split(tx, {quoted(PARAGRAPH)})", f"if(size(pt) > 1, " + let("pf", _paragraphs("tx"), f"""concat(
        filter(transform(pf, (c, i) -> named_struct('unit', if(contains(get(pt, i), chr(10)), 'paragraph', ''), 'position', i, 'c', c)),
               u -> u.unit = 'paragraph'),
        {_runs('pf', 'paragraphs', 2, lengths)})""") + f", {_NO_UNITS})")
    block = f"array_join(regexp_extract_all(tx, {quoted(COMMENT_BLOCK)}, 0), '\n\n')"
    comment = (f"regexp_replace(concat({block}, '\n\n', regexp_replace(tx, {quoted(CODE_LINE)}, '')), {quoted(MARKS_ONLY)}, '')")
    comments = (f"if(tx rlike {quoted(COMMENTED)}, "
                + let("ct", comment, _runs(_paragraphs("ct"), "comment", 1, lengths)) + f", {_NO_UNITS})")
    return let("tx", text, f"filter(concat({lines}, {paragraphs}, {comments}), u -> u.c != '')")


def scan(docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each licence found: ``id_col``, ``unit`` (text, paragraph, line, paragraphs or comment), ``position``
    (of the unit among those of its kind, from 0; of a run of paragraphs the first one's among those with a
    letter or digit, in the text or in its comments), ``license``, ``digest``."""
    beginnings: dict[str, list[int]] = {}
    for r in digests.select("anchor", "n_chars").distinct().collect():   # a few for each known text
        beginnings.setdefault(r["anchor"], []).append(r["n_chars"])
    pairs = ", ".join(f"'{a}', array({', '.join(map(str, sorted(n)))})" for a, n in sorted(beginnings.items()))
    lengths = f"map({pairs})" if pairs else "cast(map() as map<string,array<int>>)"
    found = (docs.where(F.length(F.trim(F.col(text_col))) > 0)
             .select(F.col(id_col), F.explode(F.expr(_units(f"`{text_col}`", lengths))).alias("u"))
             .select(id_col, "u.unit", "u.position", F.md5("u.c").alias("digest")))
    # a caller's table of any size: Spark broadcasts it by its size, or shuffles
    return found.join(digests.select("digest", "license").distinct(), "digest").select(
        id_col, "unit", "position", "license", "digest")
