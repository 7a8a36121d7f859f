"""Licence scans: sparse TF-IDF cosine to templates, then inheritance by path.

Passages of a file (its lines, and the file as a whole) and the templates are
sparse TF-IDF vectors. A passage whose cosine to a template is high enough
names a licence: a line does so for its own file, a whole file for its
directory too. A file without a licence of its own takes that of the nearest
directory above it that has one. DataFrame functions only.

The words of a passage travel to be weighed only if its cosine could reach the
threshold with all words of no template at weight 1, the least there is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercata.llm.common import shared_table

# The public wording of notices, file headers and short licence texts, by SPDX id.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LGPL-3.0", "This library is free software under the GNU Lesser General Public License, version 3."),
)
HEADERS = (
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "LGPL-3.0",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
)
TEXTS = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
)
#: Every template, also the tag line that names a licence by its id.
TEMPLATES = (*NOTICES, *HEADERS, *TEXTS, *((name, f"SPDX-License-Identifier: {name}") for name, _ in NOTICES))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many words of passages are told to all tasks (some tens of MB).
TOLD_WORDS = 500_000
#: What the bound of a cosine may lack by rounding.
BOUND_SLACK = 1e-5
#: What separates words: ASCII that is neither letter nor digit.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Words of a text with A-Z lower-cased (may hold empty strings)."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN)


def template_counts(templates: DataFrame) -> DataFrame:
    """(license, text, word, tf) of (license, text) templates; a licence may have several."""
    words = templates.select("license", "text", F.explode(tokens(F.col("text"))).alias("word")).where("word <> ''")
    return words.groupBy("license", "text", "word").agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequency(files: DataFrame, words: list[str]) -> tuple[dict[str, float], float]:
    """Weight of each template word by the files that hold it, and of any other word.

    Counts all files; at most one row a template word reaches the driver.
    ln((1 + files) / (1 + files with the word)) + 1; a word of no template
    weighs as one that no file holds.
    """
    from math import log

    wanted = F.array(*[F.lit(w) for w in words])
    total = files.count()
    held = {
        r["word"]: r["n"]
        for r in files.select(F.explode(F.array_intersect(tokens(F.col("text")), wanted)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    return {w: log((1 + total) / (1 + held.get(w, 0))) + 1 for w in words}, log(1 + total) + 1


def any_word(words: list[str]) -> str:
    """Pattern of any of the words as a whole word; those of one first letter stand together."""
    letters: dict[str, list[str]] = {}
    for w in words:
        letters.setdefault(w[0], []).append(re.escape(w[1:]))
    inner = "|".join(f"{re.escape(a)}(?:{'|'.join(rest)})" for a, rest in sorted(letters.items()))
    return f"(?:^|[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F])(?i:{inner})(?:$|[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F])"


def prefix_words(vectors: dict, threshold: float, idf: dict[str, float] | None = None) -> list[str]:
    """Words one of which any passage at the threshold to any template must hold.

    Per template the rarest words (without ``idf`` the heaviest), until those
    left over could not reach the threshold by themselves. Rarity comes first
    as a long text repeats common words, which would let every passage in.
    """
    out: set[str] = set()
    for weights in vectors.values():
        norm = sum(v * v for v in weights.values())
        left = norm
        for word, v in sorted(weights.items(), key=lambda x: (-(idf or weights)[x[0]], x[0])):
            if left < threshold * threshold * norm * (1 - 1e-9):
                break
            out.add(word)
            left -= v * v
    return sorted(out)


def _parents(directory: Column) -> Column:
    """A directory and all above it, itself first; the root is ''."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), (F.size(parts) - i).cast("int")), "/"),
    )


def scan(
    files: DataFrame,
    id_col: str = "id",
    path_col: str = "path",
    text_col: str = "text",
    templates: DataFrame | None = None,
    threshold: float = 0.7,
    file_threshold: float = 0.5,
    count_all: bool = False,
) -> DataFrame:
    """(id, path, license, origin, cosine, directory) per row of ``files``.

    ``count_all``: words of no template weigh by the files that hold them, as
    template words do; else as words that no file holds.

    ``origin``: "header" if a line of the file, or a run of adjacent lines
    between empty ones, has a cosine of at least ``threshold`` to a template; "file" if the whole text has one of at least
    ``file_threshold`` (it then counts for its directory too); "inherited" if
    the nearest directory above (its own included) with a licence file gives
    it; null if there is none. A whole file comes before its lines; then the
    highest cosine wins, then the first licence by name; of several licence files of a directory the one with the highest
    cosine, then the first path. ``directory`` is where an inherited licence
    comes from. Cosines are rounded to 6 digits before they are compared.

    Null and empty texts hold no words and can only inherit; null paths are
    files of the root. Each row is a file: rows that repeat are scanned alike
    and stay. Templates without words match nothing. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    spark = files.sparkSession
    if templates is None:
        templates = spark.createDataFrame(list(TEMPLATES), "license string, text string")
    # texts are known by digest: copies are scanned once, and a re-run task names them alike
    base = files.select(
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    counted = template_counts(templates).collect()
    words = sorted({r["word"] for r in counted})
    none = base.select(
        "row", F.lit(None).cast("string").alias("license"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("double").alias("cosine")
    ).where(F.lit(False))
    own = none
    if words:
        idf, other = inverse_frequency(files.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), words)
        vectors: dict[tuple[str, str], dict[str, float]] = {}
        for r in counted:
            vectors.setdefault((r["license"], r["text"]), {})[r["word"]] = r["tf"] * idf[r["word"]]
        own = _own(base, vectors, idf, other, threshold, file_threshold, count_all)

    found = shared_table(own, "licenses")
    marked = base.select("row", "id", "path").join(found, "row", "left")
    directory = F.regexp_replace(F.regexp_replace("path", "^/+", ""), "/*[^/]*$", "")
    marked = shared_table(marked.withColumn("own_dir", F.regexp_replace(directory, "/+", "/")), "licensed-files")

    declared = (
        marked.where("origin = 'file'")
        .groupBy(F.col("own_dir").alias("directory"))
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("best"))
        .select("directory", "best.license", (-F.col("best.c")).alias("cosine"))
    )
    # each directory in use is resolved once, not once a file
    above = marked.where("origin IS NULL").select("own_dir").distinct().select("own_dir", F.posexplode(_parents(F.col("own_dir"))).alias("up", "directory"))
    nearest = (
        above.join(declared, "directory")
        .groupBy("own_dir")
        .agg(F.min(F.struct("up", "directory", "license", "cosine")).alias("n"))
        .select("own_dir", F.col("n.directory").alias("d"), F.col("n.license").alias("l"), F.col("n.cosine").alias("c"))
    )
    return marked.join(nearest, "own_dir", "left").select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("license", "l").alias("license"),
        F.when(F.col("origin").isNotNull(), F.col("origin")).when(F.col("l").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("origin").isNotNull(), F.col("cosine")).otherwise(F.col("c")).alias("cosine"),
        F.when(F.col("origin").isNull(), F.col("d")).alias("directory"),
    )


def passage_frequency(base: DataFrame, words: DataFrame, other: float) -> DataFrame:
    """(word, idf) of every one of ``words`` (distinct), by the files that hold it.

    Words are counted with map-side combine, so a word that every file holds
    is one row a task; at most ``TOLD_WORDS`` words of passages are broadcast,
    so that no other word is counted at all. ``other`` is ln(1 + files) + 1.
    """
    wanted = shared_table(words.select("word"), "passage-vocabulary")
    every = base.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    # of all words only those of passages are counted: where they are read, if their number allows it
    if wanted.count() <= TOLD_WORDS:
        held = every.join(F.broadcast(wanted), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    else:
        held = every.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(wanted, "word", "left_semi")
    return held.select("word", (F.lit(other) - F.log(F.col("n") + 1)).alias("idf"))


def measured(counts: DataFrame, vectors: dict[tuple[str, str], dict[str, float]], idf: dict[str, float]) -> DataFrame:
    """A row per passage of (row, line, word, tf): ``known``, the squares of its template words' weights,
    ``tf2``, the squares of its other words' counts, ``dots`` with the templates in their order, and the other ``words``."""
    names = sorted(vectors)
    matrix = counts.sparkSession.createDataFrame(
        [(w, idf[w], [vectors[n].get(w, 0.0) for n in names]) for w in sorted(idf)], "word string, idf double, v array<double>"
    )
    joined = counts.join(F.broadcast(matrix), "word", "left").withColumn("w", F.col("tf") * F.col("idf"))
    zero, other = F.lit(0.0), F.col("idf").isNull()
    return joined.groupBy("row", "line").agg(
        F.coalesce(F.sum(F.col("w") * F.col("w")), zero).alias("known"),
        F.coalesce(F.sum(F.when(other, (F.col("tf") * F.col("tf")).cast("double"))), zero).alias("tf2"),
        F.array(*[F.coalesce(F.sum(F.col("w") * F.col("v")[i]), zero) for i in range(len(names))]).alias("dots"),
        F.collect_list(F.when(other, F.struct("word", "tf"))).alias("words"),
    )


def _cosines(norm: Column, sizes: list[float]) -> Column:
    """The cosines to all templates of a passage with ``dots`` and this square of its length."""
    return F.array(*[F.round(F.col("dots")[i] / F.sqrt(norm * F.lit(size)), 6) for i, size in enumerate(sizes)])


def _own(
    base: DataFrame,
    vectors: dict[tuple[str, str], dict[str, float]],
    idf: dict[str, float],
    other: float,
    threshold: float,
    file_threshold: float,
    count_all: bool,
) -> DataFrame:
    """(row, license, origin, cosine) of the rows whose own text names a licence."""
    needed = prefix_words(vectors, min(threshold, file_threshold), idf)
    hint = any_word(needed)
    held = base.where(F.col("text").rlike(hint)).select("row", "text").dropDuplicates(["row"])
    lines = held.select("row", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.col("text").rlike(hint))
    # notices over several lines: runs of adjacent lines between empty ones, counted from -2 down
    # (a text of one run is a passage already, at the lower threshold)
    several = held.where(F.col("text").contains("\n\n"))
    runs = several.select("row", F.posexplode(F.split("text", "\n\n+")).alias("at", "text")).where(F.col("text").contains("\n") & F.col("text").rlike(hint))
    passages = (
        lines.unionByName(held.select("row", F.lit(-1).alias("line"), "text"))
        .unionByName(runs.select("row", (F.lit(-2) - F.col("at")).alias("line"), "text"))
    )
    counts = (
        passages.select("row", "line", F.explode(tokens(F.col("text"))).alias("word"))
        .where("word <> ''")
        .groupBy("row", "line", "word")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    names = sorted(vectors)
    sizes = [sum(x * x for x in vectors[n].values()) for n in names]
    whole = F.col("line") == -1
    limit = F.when(whole, F.lit(file_threshold)).otherwise(F.lit(threshold))
    passed = measured(counts, vectors, idf)
    if count_all:
        # a word weighs 1 at least, so a passage that fails with words of that weight fails with any
        near = F.array_max(_cosines(F.col("known") + F.col("tf2"), sizes)) >= limit - F.lit(BOUND_SLACK)
        passed = shared_table(passed.where(near), "passages")
        each = passed.select("row", "line", F.explode("words").alias("e")).select("row", "line", "e.word", "e.tf")
        weights = passage_frequency(base, each.select("word").distinct(), other)
        w = F.col("tf") * F.coalesce("idf", F.lit(other))
        squares = each.join(weights, "word", "left").groupBy("row", "line").agg(F.sum(w * w).alias("more"))
        passed = passed.drop("words").join(squares, ["row", "line"], "left")
        norm = F.col("known") + F.coalesce("more", F.lit(0.0))
    else:
        norm = F.col("known") + F.col("tf2") * F.lit(other * other)
    scored = passed.select(
        "row", "line", F.explode(F.arrays_zip(F.array(*[F.lit(n[0]) for n in names]).alias("license"), _cosines(norm, sizes).alias("cosine"))).alias("m")
    ).select("row", "line", "m.license", "m.cosine")
    return (
        scored.where(F.col("cosine") >= limit)
        .withColumn("origin", F.when(whole, "file").otherwise("header"))
        .groupBy("row")
        .agg(F.min(F.struct(F.col("origin").alias("o"), (-F.col("cosine")).alias("c"), "license")).alias("b"))
        .select("row", F.col("b.license").alias("license"), F.col("b.o").alias("origin"), (-F.col("b.c")).alias("cosine"))
    )
