"""Licence scans, with DataFrame operations only.

A file's candidate headers are its windows of one to WINDOW consecutive lines and
its paragraphs (lines between blank ones; comment signs make no word, so a comment
line without words is blank); a licence file (basename LICENSE, LICENCE, COPYING,
NOTICE, any extension) also offers its whole text.  Each becomes a sparse TF-IDF
vector over words [a-z0-9]+ (A-Z lowered), and its cosine with every template that
shares a word is taken.  A template fits if the cosine is `least` or above and the
header holds the words that tell the licence from its relatives (its name, its
version); the nearest one (ties: the smaller name) is the file's licence.
idf = 1 + log((1 + N) / (1 + df)), df over all files for template words; words
outside the templates weigh as if in no other file.

Most files and windows are passed over without a vector: only what holds all needed
words of some template can fit, so a word that is common in another language (mit)
selects nothing by itself.

A file without a licence inherits that of the nearest ancestor directory with a
licence file, its own directory first.  Directories are resolved once each and
files then join on their directory, so a directory of many files costs one row.

Defined cases: null text has no header.  A null path inherits nothing.  Of a
directory's licence files the highest cosine counts, then the smaller name.
Repeated rows each get a row, no rows give none.  Texts of any length are scanned
whole.  Columns other than id, path and text are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, durable, small_table

WINDOW = 4

# The texts by which these public licences are granted or declared.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_LIMITS = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."

#: licence: [(words that must be there, text)]
TEMPLATES: dict[str, list[tuple[str, str]]] = {
    "Apache-2.0": [("apache 2", "Licensed under the Apache License, Version 2.0"), ("apache 2", _APACHE), ("apache 2", f"{_APACHE} {_APACHE_LIMITS}"), ("apache 2", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/")],
    "BSD-2-Clause": [("redistributions", f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_AS_IS}"), ("bsd 2 clause", "BSD 2-Clause License"), ("simplified bsd", "Simplified BSD License")],
    "BSD-3-Clause": [("redistribution binary", _BSD), ("neither endorse", f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAME} {_BSD_AS_IS}"), ("neither endorse", _BSD_NAME), ("bsd 3 clause", "BSD 3-Clause License"), ("bsd style", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.")],
    "BSL-1.0": [("boost", "Boost Software License - Version 1.0"), ("boost", "Distributed under the Boost Software License, Version 1.0.")],
    "CC-BY-4.0": [("attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License"), ("cc by 4", "Licensed under CC BY 4.0")],
    "CC-BY-NC-4.0": [("attribution noncommercial 4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"), ("cc by nc 4", "Licensed under CC BY-NC 4.0")],
    "CC-BY-SA-4.0": [("attribution sharealike 4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"), ("cc by sa 4", "Licensed under CC BY-SA 4.0")],
    "CC0-1.0": [("cc0", "CC0 1.0 Universal public domain dedication"), ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0")],
    "ISC": [("isc", "ISC License"), ("fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")],
    "MIT": [("mit license", "MIT License"), ("mit license", "Released under the MIT License"), ("mit license", "Licensed under the MIT license"), ("mit license", "The MIT License (MIT)"), ("mit license", "MIT License Copyright (c)"), ("mit licence", "MIT Licence"), ("mit licence", "Released under the MIT Licence"), ("mit licence", "Licensed under the MIT licence"), ("mit licensed", "MIT licensed"), ("mit licensed", "Licensed under MIT"), ("mit licensed", "Licensed under the MIT"), ("mit released", "Released under MIT"), ("mit distributed", "Distributed under MIT"), ("mit available", "Available under MIT"), ("hereby sublicense", _GRANT), ("hereby sublicense", f"MIT License {_GRANT} {_NOTICE} {_AS_IS}")],
    "MPL-2.0": [("mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"), ("mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."), ("mozilla 2", "Mozilla Public License Version 2.0")],
    "Unlicense": [("unencumbered", "This is free and unencumbered software released into the public domain."), ("unlicense", "The Unlicense")],
    "Zlib": [("zlib", "zlib License"), ("altered freely", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: altered source versions must be plainly marked as such")],
}
for _name, _kind, _version, _date in (("GPL-2.0", "", "2", "June 1991"), ("GPL-3.0", "", "3", "29 June 2007"), ("LGPL-2.1", "Lesser ", "2.1", "February 1999"), ("LGPL-3.0", "Lesser ", "3", "29 June 2007"), ("AGPL-3.0", "Affero ", "3", "19 November 2007")):
    _needs = f"gnu general {_kind.lower()}{_version.replace('.', ' ')}"
    TEMPLATES[_name] = [
        (_needs, f"This work is licensed under the GNU {_kind}General Public License, version {_version}"),
        (_needs, f"Licensed under the GNU {_kind}General Public License, version {_version}"),
        (_needs, _GNU.format(_kind, _version)),
        (_needs, f"GNU {_kind.upper()}GENERAL PUBLIC LICENSE Version {_version}, {_date}"),
    ]
for _name in list(TEMPLATES):
    TEMPLATES[_name].append(("spdx " + " ".join(re.findall("[a-z0-9]+", _name.lower())), f"SPDX-License-Identifier: {_name}"))

LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[^/]*)?$"


def words(text: Column) -> Column:
    """In order; the empty word may stand at either end."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def directory(path: Column) -> Column:
    """Everything before the last slash; the empty text is the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def weighted(templates: dict[str, list[tuple[str, str]]], idf: dict[str, float]) -> list[tuple[str, str, dict[str, float], set[str]]]:
    """(licence, template's number, weight of each word at length one, needed words)."""
    out = []
    for name, forms in templates.items():
        for k, (needs, text) in enumerate(forms):
            tokens = re.findall("[a-z0-9]+", text.lower())
            v = {w: tokens.count(w) * idf[w] for w in set(tokens)}
            norm = math.sqrt(sum(x * x for x in v.values()))
            out.append((name, f"{name}/{k}", {w: x / norm for w, x in v.items()}, set(needs.split())))
    return out


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[A-Za-z0-9]"))


def candidates(path: Column, text: Column, lines: Column) -> Column:
    """Windows of lines, paragraphs, and of a licence file the whole text; distinct.
    `lines` must be a column, not an expression: each window reads it anew."""
    last = F.size(lines)

    def windows(k: int) -> Column:
        starts = F.when(last >= k, F.sequence(F.lit(1), last - (k - 1))).otherwise(F.array().cast("array<int>"))
        return lines if k == 1 else F.transform(starts, lambda i: F.array_join(F.slice(lines, i, k), "\n"))

    paragraphs = F.split(text, "\n(?:[^A-Za-z0-9\n]*\n)+")
    whole = F.when(path.rlike(LICENCE_FILE), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[windows(k) for k in range(1, WINDOW + 1)], paragraphs, whole))


def own_licences(files: DataFrame, key: list[str], templates: dict[str, list[tuple[str, str]]], least: float) -> DataFrame:
    """key, licence, cosine of each file (as its path and text) that has one."""
    spark = files.sparkSession
    n = files.count()
    text = F.coalesce("text", F.lit(""))
    vocabulary = sorted({w for forms in templates.values() for _, t in forms for w in re.findall("[a-z0-9]+", t.lower())})
    listed = lambda ws: F.array(*map(F.lit, sorted(ws)))
    counted = files.select(F.explode(F.array_intersect(words(text), listed(vocabulary))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    df = {r.w: r.n for r in counted}  # at most the templates' words
    idf = {w: 1 + math.log((1 + n) / (1 + df.get(w, 0))) for w in vocabulary}
    outside = 1 + math.log((1 + n) / 2)
    all_ = weighted(templates, idf)
    sets = F.array(*map(listed, sorted({tuple(sorted(needs)) for _, _, _, needs in all_})))
    telling = listed({w for _, _, _, needs in all_ for w in needs})

    def may_fit(t: Column) -> Column:
        # an array of one, so that a text's words are cut once for all templates
        own = F.array(F.array_intersect(words(t), telling))
        return F.exists(own, lambda found: F.exists(sets, lambda needs: F.size(F.array_except(needs, found)) == 0))

    cut = files.where(may_fit(text)).select(*key, F.coalesce("text", F.lit("")).alias("text"), worded_lines(text).alias("lines"))
    header = F.explode(F.filter(candidates(F.col("path"), F.col("text"), F.col("lines")), may_fit)).alias("header")
    # the only table cut from texts; later rows carry a header's digest, not the header
    held = durable(cut.select(*key, header).withColumn("hid", F.unhex(F.md5("header"))), "headers")
    rows = [(w, name, form, x, w in needs) for name, form, v, needs in all_ for w, x in sorted(v.items())]
    table = F.broadcast(small_table(spark, rows, "w string, licence string, form string, weight double, needed boolean"))
    wanted = F.broadcast(small_table(spark, [(form, len(needs)) for _, form, _, needs in all_], "form string, wanted int"))
    known = F.broadcast(small_table(spark, [(w, idf[w]) for w in vocabulary], "w string, idf double"))
    # equal headers are scored once
    headers = held.select("hid", "header").groupBy("hid").agg(F.first("header").alias("header"))
    terms = headers.select("hid", F.explode(words(F.col("header"))).alias("w")).where("w <> ''").groupBy("hid", "w").agg(F.count("*").alias("count"))
    weighed = terms.join(known, "w", "left").select("hid", "w", (F.col("count") * F.coalesce("idf", F.lit(outside))).alias("x"))
    norms = weighed.groupBy("hid").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(table, "w").groupBy("hid", "licence", "form").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.count_if("needed").alias("got"))
    near = dots.join(wanted, "form").where("got = wanted").join(norms, "hid").select("hid", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= least)
    best = durable(near.groupBy("hid").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b")), "nearest")
    found = held.select(*key, "hid").join(best, "hid").groupBy(*key).agg(F.min("b").alias("b"))
    out = durable(found.select(*key, F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine")), "licences")
    discard(held)
    discard(best)
    return out


def scan(files: DataFrame, templates: dict[str, list[tuple[str, str]]] = TEMPLATES, least: float = 0.7, id_column: str = "doc_id") -> DataFrame:
    """id, path, licence, cosine, inherited_from (the directory; null: own or none)."""
    own = own_licences(files.select(id_column, "path", "text"), [id_column, "path"], templates, least)
    named = files.select(id_column, "path").withColumn("dir", directory(F.col("path")))
    on = [named[id_column].eqNullSafe(own[id_column]), named["path"].eqNullSafe(own["path"])]
    rows = named.join(own, on[0] & on[1], "left").select(named[id_column], named["path"], "dir", "licence", "cosine")
    # what each directory grants: its best licence file
    grants = own.where(F.col("path").rlike(LICENCE_FILE)).groupBy(directory(F.col("path")).alias("at")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("g"))
    dirs = named.where("dir is not null").select("dir").distinct()
    depth = F.size(F.split("dir", "/"))
    above = F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/"))
    reach = dirs.select("dir", F.explode(F.array_union(above, F.array(F.lit("")))).alias("at")).join(grants, "at")
    nearest = reach.groupBy("dir").agg(F.max(F.struct(F.length("at").alias("l"), "at", "g.licence", (-F.col("g.c")).alias("c"))).alias("n"))
    out = rows.join(nearest, "dir", "left")
    none = F.col("licence").isNull()
    return out.select(id_column, "path", F.coalesce("licence", "n.licence").alias("licence"), F.coalesce("cosine", "n.c").alias("cosine"), F.when(none, F.col("n.at")).alias("inherited_from"))
