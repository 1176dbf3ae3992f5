"""License scans (operator 10): sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A unit is a line of a file, a run of adjacent lines that are all comments or all
not (a header, a paragraph), or a file as a whole (a licence file). A unit's
terms are its runs of letters and digits, A-Z lower-cased, weighted by how often
they stand in it and by the inverse document frequency over the templates, so
comment marks and line breaks do not count, and what a file states does not
depend on what lies beside it. A term of no template weighs as one of none.
Which licence a directory has is joined to the ancestors of every directory that
holds a file, and the nearest one is handed down.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, short_batches
from tidemark.llm.textvec import Block, blocks, row_numbers

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_END = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
_BSD_2 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."

#: Licences and their usual notices: short statements, headers, first paragraphs of long licences, whole short ones. Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", _MIT),
    ("MIT", f"MIT License\n{_MIT}\n{_MIT_END}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {_GPL}"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD}\n{_BSD_2}\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD}\n{_BSD_2}\n{_BSD_3}\n{_BSD_END}"),
    ("BSD-3-Clause", _BSD),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Bytes that part terms: all ASCII but letters and digits.
_PARTS = np.ones(256, bool)
_PARTS[48:58] = _PARTS[65:91] = _PARTS[97:123] = _PARTS[128:] = False
#: First marks of a line that make it a comment.
_COMMENT = np.isin(np.arange(256), np.frombuffer(b"#/*;%!|<", np.uint8))
#: File names, without what follows a dot, that make a licence file.
LICENCE_NAMES = ("license", "licence", "copying", "unlicense")


@dataclass(frozen=True)
class Params:
    """The least cosine at which a unit states a template's licence."""

    min_cosine: float = 0.7


def terms_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct terms of each text and how often it has them."""
    out = []
    for b in blocks(pa.array(texts, pa.large_string()), size=1 << 30, space=_PARTS):
        out += [np.unique(b.hash[slice(*b.row_words(i))], return_counts=True) for i in range(b.hi - b.lo)]
    return out


@dataclass
class Weighted:
    """The templates in the space of their own terms, as every task holds them."""

    terms: np.ndarray  # sorted
    idf: np.ndarray
    other: float  # idf of any other term
    unit: np.ndarray  # templates x terms, rows of length 1


def weigh() -> Weighted:
    """The templates, weighted by document frequencies over the templates."""
    found = terms_of([t for _, t in TEMPLATES])
    terms, df = np.unique(np.concatenate([t for t, _ in found]), return_counts=True)
    idf = np.log((1 + len(found)) / (1 + df)) + 1
    unit = np.zeros((len(found), len(terms)))
    for i, (t, n) in enumerate(found):
        at = np.searchsorted(terms, t)
        unit[i, at] = n * idf[at]
    return Weighted(terms, idf, float(np.log(1 + len(found)) + 1), unit / np.linalg.norm(unit, axis=1, keepdims=True))


def best_units(b: Block, unit: np.ndarray, w: Weighted, least: float) -> Iterator[tuple[int, int, float, float]]:
    """Unit, template, cosine and cosine times length of the units whose best cosine is at least least; unit: of each word, ascending.

    Exact: with all terms weighing a cosine is at most what the template terms
    have of the unit's length, and only units that pass this bound are compared.
    """
    if not len(unit):
        return
    at = np.minimum(np.searchsorted(w.terms, b.hash), len(w.terms) - 1)
    hit = w.terms[at] == b.hash
    weight = np.where(hit, w.idf[at], w.other)
    edges = np.concatenate(([0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]))
    starts = edges[:-1]
    inside, whole = np.add.reduceat(weight * hit, starts), np.add.reduceat(weight**2, starts)
    for k in np.flatnonzero(inside**2 >= least**2 * whole - 1e-9).tolist():
        s = slice(edges[k], edges[k + 1])
        _, of, n = np.unique(b.hash[s], return_index=True, return_counts=True)
        x = n * weight[s][of]
        mine = hit[s][of]
        length = np.linalg.norm(x)
        cosine = w.unit[:, at[s][of][mine]] @ x[mine] / length
        i = int(np.argmax(np.round(cosine, 9)))
        if cosine[i] >= least:
            yield int(unit[edges[k]]), i, float(cosine[i]), float(cosine[i] * length)


def lines_of(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its line and of its run of lines, counted over the block; a row begins a line and a run.

    A run ends before a line without a term, and where comments begin or end.
    """
    starts = np.unique(np.concatenate((b.offs[:-1], np.flatnonzero(b.data == 10) + 1)))
    line = np.searchsorted(starts, b.start, "right") - 1
    marks = np.append(np.flatnonzero((b.data > 32) | (b.data == 10)), len(b.data))
    first = marks[np.searchsorted(marks, starts)]
    comment = _COMMENT[np.append(b.data, 10)[np.minimum(first, len(b.data))]]
    full = np.bincount(line, minlength=len(starts)) > 0
    new = np.ones(len(starts), bool)
    new[1:] = ~full[:-1] | (comment[1:] != comment[:-1])
    new[np.isin(starts, b.offs[:-1])] = True
    return line, np.cumsum(new)[line]


def stated(files: DataFrame, w: Weighted, p: Params) -> DataFrame:
    """files with licence and score (of the unit of which most is its template's: a whole text counts more than its first paragraph), and edge: its first or last line or run of lines, or its whole, says so."""
    shared = files.sparkSession.sparkContext.broadcast(w)  # as large as the templates
    kept = [f for f in files.columns if f != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "text") + ", licence string, score double, edge boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            licence, score, edge, most = [None] * n, [0.0] * n, [False] * n, [0.0] * n
            text = batch.column(batch.schema.get_field_index("text"))
            for b in blocks(text, space=_PARTS):
                row = row_numbers(b)
                for unit in (*lines_of(b), row):
                    for u, t, c, x in best_units(b, unit, m, p.min_cosine):
                        r = int(row[np.searchsorted(unit, u)])
                        a, z = b.row_words(r)
                        edge[b.lo + r] |= bool(u == unit[a] or u == unit[z - 1])
                        if round(x, 6) > most[b.lo + r]:
                            licence[b.lo + r], score[b.lo + r], most[b.lo + r] = TEMPLATES[t][0], round(c, 9), round(x, 6)
            columns = [batch.column(batch.schema.get_field_index(f)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(licence, pa.string()), pa.array(score, pa.float64()), pa.array(edge, pa.bool_())], names=[*kept, "licence", "score", "edge"])

    return files.mapInArrow(run, schema)


def directory(path: Column) -> Column:
    """What stands before the last slash; the empty directory is the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def is_licence_file(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/.]*)[^/]*$", 1))
    return F.coalesce(name.isin(*LICENCE_NAMES), F.lit(False))


def inherit(found: DataFrame) -> DataFrame:
    """found (path, licence, score, gives) with origin, and licence and from_dir handed down where a file states none.

    A directory's licence is that of its giving file of the highest score, ties
    by licence name. Only distinct directories are joined with their ancestors.
    Both joins are merge joins: Spark takes found's compressed files for its size
    and a row for each directory's ancestors, so it would choose to broadcast many
    times what it reckons with, and keeps to that when it has counted. Keys of an
    aggregate pass through max, so that they are dealt out once more for the join
    and Spark can split a directory of very many files or directories.
    """
    found = found.withColumn("dir", directory(F.col("path")))
    gives = found.where("gives and licence is not null").groupBy("dir").agg(F.max("dir").alias("from_dir"), F.min(F.struct((-F.col("score")).alias("k"), "licence"))["licence"].alias("handed")).drop("dir")
    dirs = found.select("dir").distinct()
    parts = F.split("dir", "/")
    # the root, and each prefix of the parts
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    nearest = dirs.select("dir", F.explode(above).alias("from_dir")).join(gives.hint("merge"), "from_dir").groupBy("dir").agg(F.max("dir").alias("of"), F.max_by(F.struct("handed", "from_dir"), F.length("from_dir")).alias("near")).select(F.col("of").alias("dir"), "near")
    out = found.join(nearest.hint("merge"), "dir", "left")
    own = F.col("licence").isNotNull()
    return out.withColumns(
        {
            "origin": F.when(own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none"),
            "from_dir": F.when(~own, F.col("near.from_dir")),
            "licence": F.coalesce("licence", F.col("near.handed")),
        }
    ).drop("near")


def scan(files: DataFrame, p: Params = Params(), by_place: bool = False) -> DataFrame:
    """The licence of every file.

    files has path and text. Returns its other columns with path, licence (null
    if there is none), origin (own, inherited, none), score (cosine of the file's
    own statement, 0 without) and from_dir (the directory it inherits from);
    columns of files that have these names, or dir, gives, edge or near, are
    replaced or left behind. Of equal templates the first one's licence counts. A
    licence file, by its name, hands its licence down; by_place also lets every
    file do so whose first or last line or run of lines states one. A null path lies in the root;
    null and empty texts state nothing; repeated rows give repeated results, each
    with its own score; an empty table gives an empty one.
    """
    short_batches(files.sparkSession)
    files = files.drop("licence", "score", "edge", "gives", "dir", "near", "origin", "from_dir", "handed")
    files = files.withColumns({"path": F.coalesce(F.col("path").cast("string"), F.lit("")), "text": F.col("text").cast("string")})
    found = cut(stated(files, weigh(), p), "licences")
    gives = is_licence_file(F.col("path"))
    found = found.withColumn("gives", gives | F.col("edge") if by_place else gives)
    return inherit(found).drop("gives", "edge", "dir")


def document_path(docs: DataFrame) -> Column:
    """A tree for documents, which have no file names: source, language, the digits of doc_id above the hundreds, doc_id."""
    doc_id = F.col("doc_id").cast("long").cast("string")
    upper = F.regexp_replace(doc_id, r".?.$", "")
    digits = F.when(F.length(upper) > 0, F.array_join(F.split(upper, ""), "/"))
    none = F.lit("unknown")
    clean = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), "/", "_"), none)
    return F.concat_ws("/", clean("source"), clean("lang"), digits, F.coalesce(doc_id, none))


def production(docs: DataFrame) -> DataFrame:
    """The licence of every document in its tree of document_path; those whose first or last line states one stand for licence files."""
    files = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_path(docs).alias("path"), "text")
    return scan(files, by_place=True).select("doc_id", "path", "licence", "origin", "score", "from_dir")
