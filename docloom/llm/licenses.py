"""License scans with a positional rare-token index.

Templates are licence texts, each with a mandatory key phrase. The index posts a template under the POSTED words of
its key phrase that are in the fewest documents (highest IDF over the corpus), each with its offset. A file's own licence words choose
the templates that it may hold: those whose mandatory words it has, all of them. For each of these, the places of the
template's rare words, rarest first, give starts of the template; the postings are intersected by relative position, and a start
counts if the key phrase stands there whole and enough of the template's words stand in place. As the key phrase is
mandatory, the intersection of its words' postings loses no place.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import alnum_words, read_table

MIN_SHARE = 0.6
#: Words of a key phrase that the index posts.
POSTED = 3


class Template(NamedTuple):
    label: str
    text: str
    key: str
    base: bool = False


#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wording of well-known licences and their notices, with the phrase that must stand whole.
WORDING = [
    ("gpl-2.0", "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2", "GNU General Public License, version 2"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", "GNU General Public License, version 2"),
    ("gpl-3.0", "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3", "GNU General Public License, version 3"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see", "You should have received a copy of the GNU General Public License"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "terms of the GNU Lesser General Public License"),
    ("lgpl", "GNU Lesser General Public License", "GNU Lesser General Public License"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "terms of the GNU Affero General Public License"),
    ("agpl", "GNU Affero General Public License", "GNU Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "you may not use this file except in compliance with the License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "Unless required by applicable law or agreed to in writing"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Permission is hereby granted, free of charge"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "permission notice shall be included in all copies or substantial portions"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Redistribution and use in source and binary forms"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "Redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and distribute this software"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "In no event will the authors be held liable for any damages"),
    ("bsl-1.0", "Boost Software License - Version 1.0", "Boost Software License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at", "copy of the MPL was not distributed with this file"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0-1.0", "CC0 1.0 Universal", "CC0 1.0 Universal"),
    ("cc-by-sa", "CC BY-SA", "CC BY-SA"),
    ("cc-by-nc", "CC BY-NC", "CC BY-NC"),
    ("cc-by-nd", "CC BY-ND", "CC BY-ND"),
    ("all-rights-reserved", "All rights reserved", "All rights reserved"),
]

TEMPLATES = [Template(label, phrase, phrase, True) for phrase, label in BASE.items()] + [Template(*w) for w in WORDING]


def words_of(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))


def key_start(t: Template) -> int:
    words, key = words_of(t.text), words_of(t.key)
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def document_frequencies(words: DataFrame, templates: list[Template]) -> dict[str, int]:
    """In how many rows of words(words) each word of a key phrase is: one row for each such word reaches the driver."""
    known = sorted({w for t in templates for w in words_of(t.key)})
    # an outer generator, which no filter on its array is derived from (it would make the words twice)
    found = words.select(F.explode_outer(F.array_intersect("words", F.array(*map(F.lit, known)))).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n"))
    return dict.fromkeys(known, 0) | {r.word: r.n for r in found.collect()}


def build_index(frequency: dict[str, int], templates: list[Template]) -> list[list[tuple[str, int]]]:
    """The postings of each template, rarest word first: (word, offset in the template)."""
    index = []
    for t in templates:
        key, at = words_of(t.key), key_start(t)
        rare = sorted(set(key), key=lambda w: (frequency.get(w, 0), w))[:POSTED]
        index.append([(w, at + key.index(w)) for w in rare])
    return index


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _places(words: Column, own: Column, index: list[list[tuple[str, int]]], templates: list[Template], min_share: float) -> Column:
    """array<struct<label, base, start, share>> of the verified places of templates; `own` are the licence words that the file has."""
    entry = lambda t, posts: F.struct(_strings(words_of(t.text)).alias("words"), F.lit(key_start(t)).alias("key"), F.lit(len(words_of(t.key))).alias("size"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*(F.struct(F.lit(w).alias("word"), F.lit(o).alias("at")) for w, o in posts)).alias("posts"), _strings(sorted(set(words_of(t.key)))).alias("must"))
    table = F.array(*(entry(t, posts) for t, posts in zip(templates, index, strict=True)))
    possible = F.filter(table, lambda t: F.size(F.array_except(t["must"], own)) == 0)
    places = F.sequence(F.lit(0), F.size(words) - 1)

    def posted(p: Column) -> Column:
        return F.transform(F.filter(places, lambda i: F.get(words, i) == p["word"]), lambda i: i - p["at"])

    def met(t: Column) -> Column:
        rest = F.slice(t["posts"], 2, POSTED)
        return F.aggregate(rest, posted(F.get(t["posts"], F.lit(0))), lambda starts, p: F.array_intersect(starts, posted(p)))

    starts = F.flatten(F.transform(possible, lambda t: F.transform(met(t), lambda s: F.struct(t.alias("t"), s.alias("start")))))

    def stands(p: Column) -> Column:
        return F.transform(p["t"]["words"], lambda w, k: F.coalesce(F.get(words, p["start"] + k) == w, F.lit(False)))

    checked = F.transform(starts, lambda p: F.struct(p["t"].alias("t"), p["start"].alias("start"), stands(p).alias("ok")))
    share = lambda p: F.size(F.filter(p["ok"], lambda x: x)) / F.size(p["ok"])
    whole = F.filter(checked, lambda p: F.forall(F.slice(p["ok"], p["t"]["key"] + 1, p["t"]["size"]), lambda x: x) & (share(p) >= min_share))
    found = F.transform(whole, lambda p: F.struct(p["t"]["label"].alias("label"), p["t"]["base"].alias("base"), p["start"].alias("start"), share(p).alias("share")))
    return F.when(F.size(own) > 1, found).otherwise(F.array().cast("array<struct<label:string,base:boolean,start:int,share:double>>"))


def license_places(docs: DataFrame, templates: list[Template] = TEMPLATES, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places array<struct<label, base, start, share>> for each row of docs.

    start is the word, from 0, at which the template's text begins (before 0 where the file begins
    within it). Null and empty texts have no words and no places; rows repeat as they do in docs;
    other columns are not read.
    """
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), alnum_words(F.col(text_col)).alias("words"))
    index = build_index(document_frequencies(words, templates), templates)
    known = sorted({w for t in templates for w in words_of(t.key)})
    rows = words.select("doc_id", "words", F.array_intersect("words", _strings(known)).alias("own"))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), _places(F.col("words"), F.col("own"), index, templates, min_share).alias("places"))


def license_labels(places: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a template, 0 without any)."""
    base = F.filter("places", lambda p: p["base"])
    names = lambda ps: F.array_join(F.array_sort(F.array_distinct(F.transform(ps, lambda p: p["label"]))), ",")
    at = F.transform(base, lambda p: p["start"].cast("long"))
    return places.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), names(base).alias("base_labels"), names(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return license_labels(license_places(read_table(spark, sf_dir, "documents")))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TABLE = ", ".join(f"('{t.label}', {t.base}, {words_of(t.text)}, {words_of(t.key)}, {key_start(t)})" for t in TEMPLATES)
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t(label, base, words, key, k0) AS (VALUES {_TABLE}),
starts AS (SELECT r, w, t.*, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = key[1])) - 1 - k0 AS s FROM d, t),
shares AS (SELECT r, label, base, s, len(list_filter(range(0, len(words)), lambda k: s + k >= 0 AND s + k < len(w) AND coalesce(w[s + k + 1] = words[k + 1], false))) / len(words) AS share
  FROM starts WHERE w[s + k0 + 1 : s + k0 + len(key)] = key),
places AS (SELECT * FROM shares WHERE share >= {MIN_SHARE}),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM places GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)"""

QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE_SQL = {"op1_license_scan": ORACLE}
