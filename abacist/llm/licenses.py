"""Licence scan by sentence rules, in DataFrame operations.

A text is cut into sentences, each sentence is normalised (lower case, letters and digits only) and
mapped to the identifier of a known licence sentence.  Runs of unknown sentences become one mark.
A text is read twice, line by line and unwrapped: without comment leaders, lines joined to paragraphs,
and with up to two unknown sentences in a row (a list mark, an address) passed over.
The sequence of identifiers is then matched against ordered rules: an earlier rule takes the
identifiers it covers, so that a full licence text is not reported again as its own fragments.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.llm.common import table

#: Sentences of public licences and notices, by identifier.
SENTENCES = {
    "mit_title": "MIT License",
    "mit_the_title": "The MIT License",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit_ref": "Released under the MIT License.",
    "mit_ref2": "Licensed under the MIT License.",
    "mit_spdx": "SPDX-License-Identifier: MIT",
    "apache2_ref": "Licensed under the Apache License, Version 2.0.",
    "apache2_grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2_copy": "You may obtain a copy of the License at",
    "apache2_as_is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2_see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache2_spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl3_ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3_only_spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl3_later_spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_more": "See the GNU General Public License for more details.",
    "cc_by_ref": "Licensed under CC BY 4.0.",
    "cc_by_sa_ref": "Licensed under CC BY-SA 4.0.",
    "cc_by_nc_ref": "Licensed under CC BY-NC 4.0.",
    "cc0_ref": "Released into the public domain under CC0 1.0.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense_notice": "This is free and unencumbered software released into the public domain.",
    "lgpl21_free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl3_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc_spdx": "SPDX-License-Identifier: ISC",
    "bsd2_spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd3_spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "mpl2_spdx": "SPDX-License-Identifier: MPL-2.0",
    "rights_reserved": "All rights reserved.",
    "mpl2_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Fixed values: (licence, identifiers in order), tried in this order.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty", "mit_liability")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache2_grant", "apache2_copy", "apache2_as_is", "apache2_see")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope", "gpl_more")),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope", "gpl_more")),
    ("Apache-2.0", ("apache2_grant",)),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("GPL-2.0-or-later", ("gpl2_free",)),
    ("MIT", ("mit_grant",)),
    ("BSD", ("bsd_grant",)),
    ("MIT", ("mit_title",)),
    ("MIT", ("mit_the_title",)),
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_ref2",)),
    ("MIT", ("mit_spdx",)),
    ("Apache-2.0", ("apache2_ref",)),
    ("Apache-2.0", ("apache2_spdx",)),
    ("GPL-3.0-only", ("gpl3_ref",)),
    ("GPL-3.0-only", ("gpl3_only_spdx",)),
    ("GPL-3.0-or-later", ("gpl3_later_spdx",)),
    ("CC-BY-4.0", ("cc_by_ref",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_ref",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_ref",)),
    ("CC0-1.0", ("cc0_ref",)),
    ("MPL-2.0", ("mpl2_notice",)),
    ("MPL-2.0", ("mpl2_spdx",)),
    ("ISC", ("isc_grant",)),
    ("ISC", ("isc_spdx",)),
    ("Unlicense", ("unlicense_notice",)),
    ("LGPL-2.1-or-later", ("lgpl21_free",)),
    ("AGPL-3.0-or-later", ("agpl3_free",)),
    ("BSD-2-Clause", ("bsd2_spdx",)),
    ("BSD-3-Clause", ("bsd3_spdx",)),
    ("All-Rights-Reserved", ("rights_reserved",)),
)


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def sentences(text) -> F.Column:
    """Normalised sentences: cut at line feeds and after a full stop, question or exclamation mark and a blank."""
    cut = F.split(F.regexp_replace(text, r"([.!?:;])[ \t\r]+", "$1\n"), "\n", -1)
    return F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " "))), lambda s: s != "")


#: Comment leaders at the start of a line; blank lines, which end a paragraph.
_LEADER, _BLANK = r"\n[ \t]*(//+|#+|\*+|;+|--+)[ \t]*", r"\n[ \t\r]*\n"


def unwrapped(text) -> F.Column:
    """One line per paragraph."""
    bare = F.regexp_replace(F.concat(F.lit("\n"), text), _LEADER, "\n")
    return F.replace(F.replace(F.regexp_replace(bare, _BLANK, "\u0001"), F.lit("\n"), F.lit(" ")), F.lit("\u0001"), F.lit("\n"))


def _parts(name: str) -> list[str]:
    """A sentence as the cutting rule splits it."""
    return [p for p in (normalised(x) for x in re.split(r"(?<=[.!?:;])[ \t\r]+", SENTENCES[name])) if p]


def _pieces() -> dict[str, str]:
    """Normalised sentence -> identifier; of a sentence that is split, each part has one, and parts that are equal share it."""
    out: dict[str, str] = {}
    for name in SENTENCES:
        parts = _parts(name)
        for i, p in enumerate(parts):
            out.setdefault(p, name if len(parts) == 1 else f"{name}_{i}")
    return out


def _sequence(rule: tuple[str, ...]) -> list[str]:
    """The rule's identifiers, with those of split sentences spelled out."""
    known = _pieces()
    return [known[p] for r in rule for p in _parts(r)]


def scan(docs: DataFrame, *, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_sentences, n_known, identifiers (unknown runs as ``?``), licenses.

    ``licenses`` lists the rules' licences once each, in rule order, joined by commas; empty if none.
    The other columns are of the text read line by line; a rule may fit that or the unwrapped text.
    Null and empty texts have no sentences.  Repeated rows repeat; extra columns are ignored.
    """
    known = _pieces()
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col), sentences(text).alias("__s"), sentences(unwrapped(text)).alias("__p"))
    named = lambda c: F.transform(c, lambda s: F.when(s.isin(*known), lookup[s]).otherwise(F.lit("?")))
    d = d.select(id_col, F.size("__s").cast("long").alias("n_sentences"), named("__s").alias("__names"), F.array_join(named("__p"), " ").alias("__p"))
    passed = F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), "__p", F.lit(" ")), r"( \?){3,}", " !"), r" \?", "")
    d = d.withColumn("__p", F.when(F.regexp_like("__p", F.lit("[a-z]")), passed))
    joined = F.regexp_replace(F.array_join("__names", " "), r"\?( \?)+", "?")
    d = d.select(id_col, "n_sentences", F.size(F.filter("__names", lambda x: x != "?")).cast("long").alias("n_known"), joined.alias("identifiers"), "__p")
    d = d.withColumn("__left", F.when(F.col("n_known") > 0, F.concat(F.lit(" "), "identifiers", F.lit(" "))))
    found = []
    for i, (name, rule) in enumerate(rules):
        want = " " + " ".join(_sequence(rule)) + " "
        fits = F.coalesce(F.col("__left").contains(want), F.lit(False)) | F.coalesce(F.col("__p").contains(want), F.lit(False))
        d = d.withColumn(f"__f{i}", F.when(fits, F.lit(name)))
        d = d.withColumns({c: F.replace(c, F.lit(want), F.lit(" ! ")) for c in ("__left", "__p")})
        found.append(F.col(f"__f{i}"))
    names = F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return d.select(id_col, "n_sentences", "n_known", "identifiers", F.array_join(names, ",").alias("licenses"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = _pieces()
    pairs = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known.items())
    steps, at = [], "r0"
    for i, (name, rule) in enumerate(RULES):
        want = quote(" " + " ".join(_sequence(rule)) + " ")
        steps.append(f"r{i + 1} AS (SELECT * EXCLUDE (rest, para), CASE WHEN coalesce(contains(rest, {want}), false) OR coalesce(contains(para, {want}), false) THEN {quote(name)} END AS f{i}, replace(rest, {want}, ' ! ') AS rest, replace(para, {want}, ' ! ') AS para FROM {at})")
        at = f"r{i + 1}"
    found = ", ".join(f"f{i}" for i in range(len(RULES)))
    order = list(dict.fromkeys(n for n, _ in RULES))
    picks = ", ".join(f"CASE WHEN list_contains([{found}], {quote(n)}) THEN {quote(n)} END" for n in order)
    return rf"""
WITH known(s, name) AS (VALUES {pairs}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?:;])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)),
        lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS s FROM d),
w AS (SELECT rid, replace(replace(regexp_replace(regexp_replace(chr(10) || t, '{_LEADER}', chr(10), 'g'), '{_BLANK}', chr(1), 'g'), chr(10), ' '), chr(1), chr(10)) AS t FROM d),
ws AS (SELECT rid, list_filter(list_transform(string_split(regexp_replace(t, '([.!?:;])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)),
        lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS s FROM w),
wu AS (SELECT rid, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM ws),
p AS (SELECT rid, string_agg(coalesce(name, '?'), ' ' ORDER BY i) AS names, count(name) AS k FROM wu LEFT JOIN known ON wu.x = known.s GROUP BY rid),
u AS (SELECT rid, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM s),
n AS (SELECT rid, string_agg(coalesce(name, '?'), ' ' ORDER BY i) AS names, count(name) AS k FROM u LEFT JOIN known ON u.x = known.s GROUP BY rid),
r0 AS (SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_sentences, CAST(coalesce(n.k, 0) AS BIGINT) AS n_known,
        regexp_replace(coalesce(n.names, ''), '\?( \?)+', '?', 'g') AS identifiers, CASE WHEN n.k > 0 THEN ' ' || regexp_replace(n.names, '\?( \?)+', '?', 'g') || ' ' END AS rest,
        CASE WHEN p.k > 0 THEN regexp_replace(regexp_replace(' ' || p.names || ' ', '( \?){{3,}}', ' !', 'g'), ' \?', '', 'g') END AS para
       FROM s LEFT JOIN n USING (rid) LEFT JOIN p USING (rid)),
{", ".join(steps)}
SELECT doc_id, n_sentences, n_known, identifiers, array_to_string(list_filter([{picks}], lambda x: x IS NOT NULL), ',') AS licenses FROM {at}
"""


QUERIES = {"op9_licenses": op9_licenses}
ORACLE_SQL = {"op9_licenses": _sql()}
