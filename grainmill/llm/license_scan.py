"""License scan with DataFrame functions only.

Texts become ASCII words and these five-word shingles. For every template a text is seen through the template's own shingles, so that
neither prose nor other notices beside it dilute a window's set. Windows overlap: they hold twice as many positions as the template has
shingles and begin at every multiple of that number, and the whole text is the last and widest window, for notices that are spread out.
Each window's MinHash (one value a band) meets the template's in a join; bands_for() gives the number of bands at which a window that
contains the wanted share of a template, and so has that Jaccard similarity with it, collides with the wanted probability. The widest
window has it wherever a document contains that share. Every retrieved template is then verified: the share of its shingles that the document contains.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import stash

SHINGLE, CONTAINED = 5, 0.8
#: The wanted probability that a window with the wanted share of a template meets it in a band.
PROBABLE = 1 - 1e-9

# The notices looked for, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bands_for(similar: float = CONTAINED, probable: float = PROBABLE) -> int:
    """Bands of one value with which sets of that similarity share a value with that probability: 1 - (1 - s)^b >= p."""
    return math.ceil(math.log(1 - probable) / math.log(1 - similar)) if similar < 1 else 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _words(text: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", text.lower())


def shingles_of(words: Column, known: Column | None = None) -> Column:
    """array<struct<pos, hash>> of the SHINGLE-word runs; with `known` (flags of the words) only of runs of known words."""
    last = F.size(words) - SHINGLE
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    if known is not None:
        all_known = lambda i: F.get(known, i) & F.get(known, i + 1) & F.get(known, i + 2) & F.get(known, i + 3) & F.get(known, i + 4)
        starts = F.filter(starts, all_known)
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))).alias("hash")))


def min_hashes(rows: DataFrame, bands: int, *keys: str) -> DataFrame:
    """rows(keys, hash) -> keys, band, low: the least of each band's hashes in every group."""
    lows = [F.min(F.xxhash64("hash", F.lit(k))).alias(f"m{k}") for k in range(bands)]
    return rows.groupBy(*keys).agg(*lows).select(*keys, F.posexplode(F.array(*(f"m{k}" for k in range(bands)))).alias("band", "low"))


def template_shingles(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, pos, hash); a table of fixed size."""
    given = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in templates.items()))
    rows = spark.range(1).select(F.explode(given).alias("t")).select("t.license", F.explode(shingles_of(words_of(F.col("t.text")))).alias("s"))
    return rows.select("license", "s.pos", "s.hash")


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """docs(doc_id, text) -> doc_id, license, n_template, n_found, containment, first_word: a row for every template of which a document
    contains at least the share `contained` of its distinct five-word shingles.

    Null and empty texts and texts of fewer than five words give no row. Rows that repeat both doc_id and text are reported once; rows that
    share an id with other texts, or have none, are reported each. Very long texts are read whole. A template of which exactly the share is
    found is reported. Other columns are not read; an empty table gives no rows. templates: as TEMPLATES, of five words or more each."""
    templates = templates or TEMPLATES
    spark, bands = docs.sparkSession, bands_for(contained)
    vocabulary = sorted({w for t in templates.values() for w in _words(t)})
    wanted = template_shingles(spark, templates)  # a table of fixed size, as are all that are made of it
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("tag"), words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "tag", "words", F.transform("words", lambda w: w.isin(vocabulary)).alias("known"))
    found = rows.select("doc_id", "tag", F.explode(shingles_of(F.col("words"), F.col("known"))).alias("s"))
    found = found.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tag", "s.pos", "s.hash")
    found = stash(found.join(F.broadcast(wanted.select("hash", "license").distinct()), "hash"), "shingles")
    text, sizes = ["no_id", "id", "tag"], {k: len(_words(t)) - SHINGLE + 1 for k, t in templates.items()}
    step = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))[F.col("license")]
    at = F.floor(F.col("pos") / step).cast("int")
    seen = found.withColumn("window", F.explode(F.array(at, at - 1, F.lit(-2))))  # -2: the whole text
    ours = min_hashes(wanted, bands, "license")
    theirs = min_hashes(seen, bands, *text, "license", "window")
    retrieved = theirs.join(F.broadcast(ours), ["license", "band", "low"]).select(*text, "license").distinct()
    distinct = wanted.select("license", "hash").distinct().groupBy("license").agg(F.count("*").alias("n_template"))
    counts = found.groupBy(*text, "license", "hash").agg(F.min("pos").alias("pos")).groupBy(*text, "license").agg(F.count("*").alias("n_found"), F.min("pos").alias("first_word"))
    hits = retrieved.join(counts, [*text, "license"]).join(F.broadcast(distinct), "license")
    out = hits.withColumn("containment", F.col("n_found") / F.col("n_template")).where(F.col("containment") >= contained)
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "license", F.col("n_template"), "n_found", "containment", F.col("first_word").cast("long").alias("first_word"))


def oracle_sql() -> str:
    """The same rows in DuckDB SQL, by exact containment of all templates in all documents."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(SHINGLE))
    return f"""
        WITH t(license, text) AS (VALUES {values}),
        tw AS (SELECT license, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t),
        tg AS (SELECT DISTINCT license, {gram} AS g FROM (SELECT license, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM tw)),
        tn AS (SELECT license, count(*) AS n_template FROM tg GROUP BY license),
        dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
        dg AS (SELECT doc_id, {gram} AS g, min(i) - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM dw) GROUP BY ALL)
        SELECT doc_id, license, n_template, count(*) AS n_found, count(*) / n_template AS containment, min(pos) AS first_word
        FROM dg JOIN tg USING (g) JOIN tn USING (license)
        GROUP BY doc_id, license, n_template HAVING count(*) / n_template >= {CONTAINED}
    """
