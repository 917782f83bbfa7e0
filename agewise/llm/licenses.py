"""License scan of source files, in DataFrame operations only.

A file's lines are gathered into header blocks: runs of lines with a word (a run of letters and digits, lower
case), ended by lines without one, so that comment marks don't matter.  From each line of a block on, the
windows of whole lines that just reach the length of some notice are possible headers; the whole text of a
licence file (``LICENSE``, ``LICENCE``, ``COPYING``, ``UNLICENSE``, by name) is one more.  Their words become
TF-IDF vectors, which are compared by cosine with the templates below (notices, titles, whole short licences);
the file gets the template of its best window of at least ``THRESHOLD``.  The idf is that of the templates
(terms they don't have count as unseen there).  Files without a license of their own inherit from the nearest
ancestor directory that has a licence file.

A window, or a licence file's text, is a header only if a word of it contains one of ``STEMS`` (every template
has such a word), so other texts are passed over unread.  A window is compared in the row that holds it, so terms
are never shuffled; what is shuffled are the few findings, paths and one row a directory.

A notice of a GNU license without its version gives the name without one; a version that no template has
gives the nearest template.  Long licences (Apache, MPL, GNU) are told by their title lines.  Repeated paths
are one file (its best window counts); null paths have no directory, null texts no line; empty tables give
empty results.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7

# License names, the customary notices that name them, and whole licences.
_GNU = (  # short name, name, versions with the dates of their titles
    ("GPL", "GNU General Public License", (("2.0", "June 1991"), ("3.0", "29 June 2007"))),
    ("LGPL", "GNU Library General Public License", (("2.0", "June 1991"),)),
    ("LGPL", "GNU Lesser General Public License", (("2.1", "February 1999"), ("3.0", "29 June 2007"))),
    ("AGPL", "GNU Affero General Public License", (("3.0", "19 November 2007"),)),
)
_GNU_NOTICES = (
    "This work is licensed under the {name}, version {v}.",
    "Licensed under the {name}, version {v}.",
    "Licensed under the {name}, version {v} or later.",
    "Licensed under the {short} v{v}.",
    "Licensed under the {short}v{v}.",
    "SPDX-License-Identifier: {short}-{version}-only",
    "SPDX-License-Identifier: {short}-{version}-or-later",
    "{name} Version {v}, {date}",
    "This program is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; version {v} of the License.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:")
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission.")
_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies.")
_ISC_REST = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
    "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
    "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", _MIT_GRANT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", _ISC_GRANT),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
)
_WHOLE = (
    ("MIT", f"{_MIT_GRANT} {_MIT_REST}"),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_REST}"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD} {_BSD_REST}"),
    ("ISC", f"{_ISC_GRANT} {_ISC_REST}"),
)
#: Parts of words of which a header has one at least.
STEMS = ("licen", "spdx", "copyright", "permi", "redistribut", "software", "apache", "mozilla", "gnu", "gpl", "bsd", "commons", "cc0", "unencumbered")
_TERM = r"[\p{L}\p{N}]+"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([-._][^/]*)?$"


def _templates() -> tuple[list[tuple[str, str]], int]:
    """``(license, text)`` of every template, notices first; the number of notices."""
    notices = list(_NOTICES)
    for short, name, versions in _GNU:
        for version, date in versions:
            v = version.removesuffix(".0")
            notices += [(f"{short}-{version}", n.format(short=short, name=name, version=version, v=v, date=date)) for n in _GNU_NOTICES]
        notices += [(short, name), (short, f"Licensed under the {name}.")]
    return notices + list(_WHOLE), len(notices)


def _terms(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_table() -> tuple[list[tuple], dict[str, float], float, list[int]]:
    """Rows ``(template number, license, term, weight)`` of length-1 vectors; idf of each term; idf of any other;
    the lengths of notices, in terms."""
    templates, n_notices = _templates()
    bags = [Counter(_terms(t)) for _, t in templates]
    df = Counter(t for b in bags for t in b)
    unseen = math.log(1 + len(bags)) + 1
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for i, (bag, (name, _)) in enumerate(zip(bags, templates, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(i, name, t, n * idf[t] / norm) for t, n in sorted(bag.items())]
    if not all(any(s in t for s in STEMS for t in b) for b in bags):
        raise ValueError("a template has no word with a stem")
    return rows, idf, unseen, sorted({sum(b.values()) for b in bags[:n_notices]})


def _constants(rows: list[tuple], idf: dict[str, float]) -> tuple:
    """The idf of known terms as a map, and the templates as an array; the optimizer makes them literals."""
    templates = {}
    for i, name, term, weight in rows:
        templates.setdefault(i, {"i": i, "license": name, "terms": []})["terms"].append({"t": term, "w": weight})
    schema = "array<struct<i:int,license:string,terms:array<struct<t:string,w:double>>>>"
    constant = lambda value, of: F.from_json(F.lit(json.dumps(value)), of)
    return constant(idf, "map<string,double>"), constant(list(templates.values()), schema)


def _possible_headers(files: DataFrame, lengths: list[int]) -> DataFrame:
    """``(path, line, words)`` of every window of a header block and every licence file's text (line 0) with a stem."""
    has_stem = lambda text: " or ".join(f"contains({text}, '{s}')" for s in STEMS)
    some = files.select(F.coalesce("path", F.lit("")).alias("path"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).where(has_stem("text"))
    words = lambda of: f"regexp_extract_all({of}, '{_TERM}', 0)".replace("\\", "\\\\")
    whole = some.where(F.col("path").rlike(LICENCE_FILE)).selectExpr("path", "0 as line", f"{words('text')} as words")
    # from each line on, no more lines than the longest notice has words; a window ends where its block does
    lines = some.selectExpr("path", "split(text, '\n') as lines").selectExpr("path", "lines", "explode(sequence(1, size(lines))) as line")
    near = lines.selectExpr("path", "line", f"slice(lines, line, {lengths[-1]}) as near").where(f"near[0] rlike '{_TERM}' and exists(near, l -> {has_stem('l')})".replace("\\", "\\\\"))
    block = near.selectExpr("path", "line", f"transform(near, l -> {words('l')}) as near")
    block = block.selectExpr("path", "line", "near", "cast(array_position(transform(near, l -> size(l)), 0) as int) as blank")
    block = block.selectExpr("path", "line", "if(blank > 0, slice(near, 1, blank - 1), near) as block")
    sums = block.selectExpr("path", "line", "block", "transform(sequence(1, size(block)), k -> aggregate(slice(block, 1, k), 0, (n, l) -> n + size(l))) as sums")
    wanted = f"array({', '.join(map(str, lengths))})"
    # an array of one row is worked out once; a column named inside a lambda might be once an element
    least = f"transform(array(struct(size(block) as most, sums)), b -> transform({wanted}, n -> least(b.most, 1 + size(filter(b.sums, s -> s < n)))))[0]"
    ends = sums.selectExpr("path", "line", "block", f"explode(array_distinct({least})) as n")
    windows = ends.selectExpr("path", "line", "flatten(slice(block, 1, n)) as words")
    return windows.unionByName(whole).where(f"exists(words, w -> {has_stem('w')})")


def own_licenses(files: DataFrame) -> DataFrame:
    """``(path, license, similarity, line)`` of the best window of each file that has one; line 0: the whole text."""
    rows, idf, unseen, lengths = template_table()
    known, templates = _constants(rows, idf)
    # words in order: where each term begins, and so how often it occurs
    terms = (_possible_headers(files, lengths).select("path", "line", F.array_sort("words").alias("words"))
             .selectExpr("*", "filter(sequence(0, size(words) - 1), i -> i = 0 or words[i] <> words[i - 1]) as at")
             .selectExpr("path", "line", "transform(at, (p, k) -> words[p]) as terms", "transform(at, (p, k) -> coalesce(get(at, k + 1), size(words)) - p) as counts"))
    idfs = terms.select("path", "line", "terms", "counts", F.transform("terms", lambda t: F.element_at(known, t)).alias("idfs"))
    weighed = idfs.selectExpr(
        "path", "line", f"sqrt(aggregate(zip_with(counts, idfs, (c, f) -> c * coalesce(f, {unseen!r}D)), 0D, (s, w) -> s + w * w)) as norm",
        "map_from_entries(filter(zip_with(terms, zip_with(counts, idfs, (c, f) -> c * f), (t, w) -> struct(t, w)), x -> x.w is not null)) as weights")
    dot = lambda unit, terms: F.aggregate(terms, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.element_at(unit["weights"], x["t"]), F.lit(0.0)))
    like = lambda unit: F.array_min(F.transform(templates, lambda t: F.struct(
        (-F.round(dot(unit, t["terms"]) / unit["norm"], 6)).alias("s"), t["i"].alias("i"), F.col("line").alias("line"), t["license"].alias("license"))))
    best = F.transform(F.array(F.struct("norm", "weights")), like)
    # filtered as an array: a condition on the column would be worked out again in front of every step above
    found = weighed.select("path", F.explode(F.filter(best, lambda b: b["s"] <= -THRESHOLD)).alias("b"))
    return found.groupBy("path").agg(F.min("b").alias("b")).select(
        "path", "b.license", (-F.col("b.s")).alias("similarity"), F.col("b.line").cast("long").alias("line"))


def directory(path):
    """The directory of a path: what stands before the last slash, or the empty text."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def inherited(files: DataFrame, own: DataFrame) -> DataFrame:
    """``(dir, from_license, from_path)`` of every directory of ``files`` under one with a licence file."""
    holders = (own.where(F.col("path").rlike(LICENCE_FILE)).select(directory(F.col("path")).alias("ancestor"), "path", "license", "similarity")
               .groupBy("ancestor").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("h")))
    dirs = files.where(F.col("path").isNotNull()).select(directory(F.col("path")).alias("dir")).distinct()
    up = dirs.select("dir", F.posexplode(F.expr(
        "transform(sequence(0, size(split(dir, '/'))), n -> array_join(slice(split(dir, '/'), 1, n), '/'))")).alias("depth", "ancestor"))
    return (up.join(holders, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "h.license", "h.path")).alias("n"))
            .select("dir", F.col("n.license").alias("from_license"), F.col("n.path").alias("from_path")))


def scan(files: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """For every row of ``files(path, text)``: ``path``, ``license`` (null if none), ``how`` (own, inherited, none),
    ``similarity`` and ``line`` of the own one (0 and -1 without), ``from_path`` of an inherited one, and the columns in ``carry``."""
    own = own_licenses(files)
    heirs = inherited(files, own)
    rows = files.select("path", *carry, F.coalesce("path", F.lit("")).alias("_path"), directory(F.col("path")).alias("_dir"))
    out = (rows.join(own.select(F.col("path").alias("_path"), F.col("license").alias("_own"), "similarity", "line"), "_path", "left")
           .join(heirs.withColumnRenamed("dir", "_dir"), "_dir", "left"))
    has = F.col("_own").isNotNull()
    return out.select(*carry, "path", F.coalesce("_own", "from_license").alias("license"),
                      F.when(has, "own").when(F.col("from_license").isNotNull(), "inherited").otherwise("none").alias("how"),
                      F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("line", F.lit(-1)).alias("line"), F.when(~has, F.col("from_path")).alias("from_path"))


#: The stand-in's paths: documents as files of source/lang/hundred; some are named as licence files of the
#: source or of the language (by id, whatever their text).
STAND_IN_PATH = (
    "concat(coalesce(source, 'none'), '/', case when doc_id % 50 = 0 then '' when doc_id % 50 = 25 then concat(coalesce(lang, 'none'), '/') "
    "else concat(coalesce(lang, 'none'), '/', cast(floor(doc_id / 100) as bigint), '/') end, "
    "case when doc_id % 25 = 0 then 'LICENSE-' else 'file-' end, doc_id)")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licenses of all ``documents``, seen as files of a repository."""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", f"{STAND_IN_PATH} as path")
    return scan(files, ("doc_id",))


def oracle() -> str:
    """The same in DuckDB SQL."""
    rows, idf, unseen, lengths = template_table()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(n)}, {quoted(t)}, {w!r}e0)" for i, n, t, w in rows)
    known = ", ".join(f"({quoted(t)}, {v!r}e0)" for t, v in sorted(idf.items()))
    return f"""
WITH templates(template, license, term, weight) AS (VALUES {templates}),
known(term, idf) AS (VALUES {known}),
files AS (SELECT doc_id, coalesce(text, '') AS text, {STAND_IN_PATH} AS path FROM documents),
texts AS (SELECT path, string_split(lower(text), chr(10)) AS l FROM files),
lines AS (
  SELECT *, len(words) AS n, sum(len(words)) OVER w AS upto, count(*) FILTER (len(words) = 0) OVER w AS block
  FROM (SELECT path, generate_subscripts(l, 1) AS line, regexp_extract_all(unnest(l), '{_TERM}') AS words FROM texts)
  WINDOW w AS (PARTITION BY path ORDER BY line)),
ends AS (
  SELECT DISTINCT path, line, coalesce(reached, most) AS last FROM (
    SELECT a.path, a.line, wanted, min(z.line) FILTER (z.upto - a.upto + a.n >= wanted) AS reached, max(z.line) AS most
    FROM lines a JOIN lines z ON a.path = z.path AND a.block = z.block AND z.line BETWEEN a.line AND a.line + {lengths[-1] - 1}
      CROSS JOIN (SELECT unnest({lengths}) AS wanted) WHERE a.n > 0 AND z.n > 0 GROUP BY ALL)),
bags AS (
  SELECT e.path, e.line, last, unnest(words) AS term FROM ends e JOIN lines l ON e.path = l.path AND l.line BETWEEN e.line AND last
  UNION ALL SELECT path, 0, 0, unnest(regexp_extract_all(lower(text), '{_TERM}')) FROM files WHERE regexp_matches(path, '{LICENCE_FILE}')),
headers AS (SELECT DISTINCT path, line, last FROM bags WHERE regexp_matches(term, '{'|'.join(STEMS)}')),
terms AS (SELECT path, line, last, term, count(*) AS tf FROM bags SEMI JOIN headers USING (path, line, last) GROUP BY ALL),
weighed AS (SELECT path, line, last, t.term, tf * coalesce(idf, {unseen!r}e0) AS w FROM terms t LEFT JOIN known USING (term)),
norms AS (SELECT path, line, last, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
found AS (
  SELECT path, line, template, license, round(dot / norm, 6) AS similarity
  FROM (SELECT path, line, last, template, license, sum(w * weight) AS dot FROM weighed JOIN templates USING (term) GROUP BY ALL) JOIN norms USING (path, line, last)),
own AS (
  SELECT path, license, similarity, line FROM found WHERE similarity >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY similarity DESC, template, line, license) = 1),
holders AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, path, license FROM own WHERE regexp_matches(path, '{LICENCE_FILE}')
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY similarity DESC, path, license) = 1),
heirs AS (
  SELECT f.path, h.license, h.path AS from_path FROM files f JOIN holders h
    ON h.dir = '' OR starts_with(f.path, h.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(h.dir) DESC) = 1)
SELECT doc_id, f.path, coalesce(o.license, h.license) AS license,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN h.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  coalesce(o.similarity, 0) AS similarity, CAST(coalesce(o.line, -1) AS BIGINT) AS line, CASE WHEN o.license IS NULL THEN h.from_path END AS from_path
FROM files f LEFT JOIN own o USING (path) LEFT JOIN heirs h USING (path)"""
