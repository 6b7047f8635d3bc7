"""Licences of files: sparse TF-IDF cosine of their statements to templates, then inheritance from the nearest directory.

Every line of a text that has an anchor word is compared with short templates. The comment that a file begins with, and the whole text of
a file named like a licence file, are compared with them and with the usual headers and full texts of licences; a header or full text that fits
counts before any single line, and an SPDX identifier before both. Terms are words and version numbers;
inverse document frequencies are counted over all files for the terms of the templates and of what is compared, so that a verdict
does not depend on how many files there are. Files named like licence
files speak for their directory; a file without a licence of its own takes that of its nearest ancestor directory. A licence file that nothing
fits ends inheritance there, and a file that declares an identifier not known here inherits none.

Only templates, their terms and directories are joined to files, never files to files. DataFrame expressions throughout.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regfeed.llm.common import stored
from regfeed.session import broadcast_if_small

# Usual statements of each licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
)
# Notices that licences ask for at the head of a file, and full texts (``licence_texts``).
_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software
Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
HEADERS: tuple[tuple[str, str], ...] = (
    *(
        (licence, _GNU.format(what=what, name=f"GNU {kind}General Public License", version=licence.split("-")[1].removesuffix(".0")))
        for what in ("program", "library")
        for licence, kind in (("AGPL-3.0", "Affero "), ("GPL-2.0", ""), ("GPL-3.0", ""), ("LGPL-2.1", "Lesser "), ("LGPL-3.0", "Lesser "))
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under
the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
)
TEXTS: tuple[tuple[str, str], ...] = tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
BLOCK_COMMENT = r"(?s)^\s*+(?:#![^\n]*+\n\s*+)?+(?:/\*.*?\*/|<!--.*?-->|\x22{3}.*?\x22{3}|\x27{3}.*?\x27{3})"
LINE_COMMENT = r"^[ \t\r]*(?:$|#|//|--|;|%|\(\*|(?i:rem)\b)"
ANCHORS = r"(?i)licen[cs]e|copyright|public domain|rights reserved|\bcc[ -]?(by|0)\b|\bspdx\b|\b[al]?gpl\b"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([-._].*)?$"
# Files that end inheritance even if no template fits them; a notice need not name a licence.
STATED_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([-._].*)?$"
SPDX = r"(?i)spdx-licen[cs]e-identifier:[ \t]*([^\n]*)"
IDENTIFIER = r"[a-z0-9][a-z0-9.+-]*"
# What joins identifiers, and what may follow the name of a licence.
OPERATORS = ("and", "or", "with")
SUFFIX = r"(-only|-or-later|\+)$"
IDENTIFIERS = tuple(sorted({name for name, _ in (*TEMPLATES, *HEADERS, *TEXTS)} - {"Proprietary"}))
LEAST = 0.6


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def templates(spark: SparkSession, given: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(text).alias("text")) for name, text in given])
    return spark.range(1).select(F.inline(rows))


def leading_comment(text: Column) -> Column:
    """The comment that a text begins with, after blank lines and a ``#!`` line; '' without one."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.startswith("#!"))
    end = F.array_position(F.transform(lines, lambda x: ~x.rlike(LINE_COMMENT)), True)
    head = F.array_join(F.slice(lines, 1, F.when(end > 0, end.cast("int") - 1).otherwise(F.size(lines))), "\n")
    block = F.regexp_extract(text, BLOCK_COMMENT, 0)
    return F.when(text.rlike(r"^\s*+(?:#![^\n]*+\n\s*+)?+(?:/\*|<!--|\x22{3}|\x27{3})"), block).when(text.rlike(r"^\s*+(?:#|//|--|;|%|\(\*|(?i:rem)\b)"), head).otherwise("")


def declared_licences(files: DataFrame) -> DataFrame:
    """``path, declared``: files with SPDX lines, and the licence that these name. Of several the first by name, NULL if none is known."""
    expressions = F.regexp_extract_all("text", F.lit(SPDX), 1)
    found = F.flatten(F.transform(expressions, lambda x: F.regexp_extract_all(F.lower(x), F.lit(IDENTIFIER), 0)))
    named = F.transform(F.filter(found, lambda x: ~x.isin(*OPERATORS)), lambda x: F.regexp_replace(x, SUFFIX, ""))
    known = F.array(*[F.lit(name) for name in IDENTIFIERS])
    first = F.array_min(F.filter(known, lambda name: F.array_contains(named, F.lower(name))))
    return files.where(F.col("text").rlike(SPDX)).select("path", first.alias("declared")).groupBy("path").agg(F.min("declared").alias("declared"))


def term_weights(files: DataFrame, vocabulary: DataFrame, template_terms: list[str] | None = None) -> DataFrame:
    """``term, idf``, counted over all files, for each term of ``vocabulary`` (column ``term``, may repeat).

    ``template_terms``: the whole vocabulary where it is short. Under NULL: the weight of a term that no file has.
    """
    found = F.array_distinct(terms(F.coalesce("text", F.lit(""))))
    if template_terms is not None:
        found = F.array_intersect(found, F.array(*[F.lit(t) for t in template_terms]))
    counts = files.select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    listed = vocabulary.select(F.col("term").alias("word")).distinct()
    total = files.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    per_term = listed.join(counts, F.col("word") == F.col("term"), "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    other = files.sparkSession.range(1).select(F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("n"))
    joined = per_term.unionByName(other).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one", "left")
    # One row per term; written once, as several joins read it.
    return stored(joined.select(F.col("word").alias("term"), (F.log((F.coalesce("total", F.lit(0)) + 1.0) / (F.col("n") + 1.0)) + 1.0).alias("idf")), "idf")


def own_licences(files: DataFrame, given: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST, whole: bool = False) -> DataFrame:
    """``path, own_licence, score``: the template closest to one of the file's statements, if its cosine is ``least`` or more.

    ``whole``: leading comments and licence files are compared too, also with ``HEADERS`` and ``TEXTS``, and the files with a term are counted
    for all terms compared; an SPDX identifier counts before any of these, and a file whose identifiers are not known and that nothing else fits has
    a row without a licence. Otherwise they are for template terms alone and any other term weighs as one that no file has, so that
    scores fall as files are added.
    """
    spark = files.sparkSession
    text = F.coalesce("text", F.lit(""))
    known = templates(spark, given).withColumn("long", F.lit(False))
    lines = files.select("path", F.posexplode(F.filter(F.split(text, "\n"), lambda x: x.rlike(ANCHORS))).alias("line", "words"))
    if whole:
        lines = lines.where(~F.col("words").rlike(SPDX))
        notices = templates(spark, HEADERS).withColumn("long", F.lit(True))
        texts = templates(spark, TEXTS).withColumn("long", F.lit(True))
        known = known.unionByName(notices).unionByName(texts)
        named = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
        # Below 0: whole texts and comments instead of a line.
        blocks = F.array(F.struct(F.lit(-2).alias("line"), F.when(named, text).alias("words")), F.struct(F.lit(-1).alias("line"), leading_comment(text).alias("words")))
        lines = lines.unionByName(files.select("path", F.inline(blocks)).where("words != ''"))
    # Licences have several templates, each a vector of its own.
    parts = known.withColumn("template", F.md5(F.concat_ws(" ", "licence", "text").cast("binary")))
    parts = parts.select("template", "licence", "long", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "licence", "long", "term").agg(F.count("*").alias("tf"))
    parts = stored(parts.coalesce(1), "template-terms")
    tf = lines.select("path", "line", F.explode(terms(F.col("words"))).alias("term")).groupBy("path", "line", "term").agg(F.count("*").alias("tf"))
    tf = stored(tf, "statements")
    if whole:
        weights = term_weights(files, tf.select("term").unionByName(parts.select("term")))
    else:
        weights = term_weights(files, parts, sorted(r["term"] for r in parts.select("term").distinct().collect()))
    other = weights.where("term is null").select(F.col("idf").alias("_other"), F.lit(1).alias("_one"))
    listed = weights.where("term is not null")
    shape = F.broadcast(parts).join(listed, "term").select("template", "licence", "long", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    norms = shape.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    shape = shape.join(norms, "template").select("template", "licence", "long", "term", (F.col("weight") / F.col("norm")).alias("template_weight"))
    shape = stored(shape.coalesce(1), "templates")

    tf = tf.join(broadcast_if_small(listed), "term", "left").withColumn("_one", F.lit(1)).join(F.broadcast(other), "_one")
    tf = stored(tf.select("path", "line", "term", (F.col("tf") * F.coalesce("idf", "_other")).alias("weight")), "weighed")
    length = tf.groupBy("path", "line").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    # Single lines are compared with short templates only.
    met = tf.alias("a").join(F.broadcast(shape.alias("b")), (F.col("a.term") == F.col("b.term")) & ((F.col("line") < 0) | ~F.col("long")))
    dots = met.groupBy("path", "line", "template", "licence", "long").agg(F.sum(F.col("weight") * F.col("template_weight")).alias("dot"))
    cosines = dots.join(length, ["path", "line"]).select("path", "licence", "long", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    order = F.struct(~F.col("long"), -F.col("score"), F.col("licence"))
    best = cosines.where(F.col("score") >= least).groupBy("path").agg(F.min_by("score", order).alias("score"), F.min_by("licence", order).alias("own_licence"))
    if whole:
        best = best.join(declared_licences(files.select("path", text.alias("text"))), "path", "full").select(
            "path",
            F.coalesce("declared", "own_licence").alias("own_licence"),
            F.when(F.col("declared").isNotNull(), F.lit(1.0)).otherwise(F.col("score")).alias("score"),
        )
    return stored(best.select("path", "own_licence", "score"), "own")


def directory_licences(own: DataFrame, paths: DataFrame) -> DataFrame:
    """``directory, from, licence`` for each directory of ``paths`` (column ``path``) with a licence file in it or above it.

    Of several licence files in one directory the closest to its template counts, then the first by path. If none of them is recognised the
    directory has the licence NULL.
    """
    name = F.element_at(F.split("path", "/"), -1)
    files = paths.select("path").where(name.rlike(LICENCE_FILE)).distinct().join(own, "path", "left")
    files = files.where(F.col("own_licence").isNotNull() | name.rlike(STATED_FILE)).withColumn("from", _directory(F.col("path")))
    order = F.struct(F.col("own_licence").isNull(), -F.col("score"), "path")
    speaks = files.groupBy("from").agg(F.min_by("own_licence", order).alias("licence"))
    directories = paths.select(_directory(F.col("path")).alias("directory"))
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ancestors = directories.distinct().select("directory", F.posexplode(above).alias("depth", "from"))
    return ancestors.join(speaks, "from").groupBy("directory").agg(
        F.max_by("licence", "depth").alias("licence"), F.max_by("from", "depth").alias("from")
    )


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame) -> DataFrame:
    """``files`` (columns ``path`` and ``text``, others are passed on) with ``licence, inherited_from``.

    ``inherited_from`` is NULL for a licence of the file's own and where there is none. Directories above the first slash are the root, ''. A NULL path is a
    file in the root without a name; rows of one path count as one file. NULL and empty texts have no statement. Columns
    ``licence`` and ``inherited_from`` of the input are replaced.
    """
    given = files.drop("licence", "inherited_from")
    named = given.withColumn("_path", F.coalesce("path", F.lit("")))
    own = own_licences(named.select(F.col("_path").alias("path"), "text"), whole=True)
    found = directory_licences(own, named.select(F.col("_path").alias("path")))
    rest = own.select(F.col("path").alias("_path"), "own_licence", F.lit(True).alias("_stated"))
    above = found.select(F.col("directory").alias("_directory"), F.col("licence").alias("_licence"), F.col("from").alias("_from"))
    joined = named.join(rest, "_path", "left").withColumn("_directory", _directory(F.col("_path"))).join(above, "_directory", "left")
    name = F.element_at(F.split("_path", "/"), -1)
    heir = F.col("_stated").isNull() & ~name.rlike(STATED_FILE) & F.col("_licence").isNotNull()
    return joined.select(
        *given.columns,
        F.coalesce("own_licence", F.when(heir, F.col("_licence"))).alias("licence"),
        F.when(heir, F.col("_from")).alias("inherited_from"),
    )
