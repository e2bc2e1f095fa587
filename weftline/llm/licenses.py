"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

Only DataFrame functions run. Text is lower-cased and cut into words of letters
and digits; shingles are WIDTH words, compared by 64-bit hash. A template of m
shingles is looked for in windows of m + s - 1 shingles at every s-th place,
s = max(1, m // 8), so each of its occurrences lies within a window. At containment
0.8 such a window has a Jaccard similarity to the template of 0.8 / 1.325 = 0.6 at
least, and BANDS bands of ROWS rows meet with probability 1 - (1 - 0.6^2)^16 > 0.999;
an exact occurrence of a template with s = 1 always meets.

Two exact conditions come first, so that most text is never cut into words: a
match holds one of a template's anchor words (they cover over a fifth of its
shingles), and a band can only meet where a window holds a shingle of a template
of its class (the templates of one m).

A null text is empty; texts without a whole shingle match nothing. Rows alike in id
and text count as one document; those of one id (or without one) and several texts
are as many. An empty table gives an empty table. Texts are scanned whole; what goes
on from a place is the shingles around it, so the work is linear in a text's length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.text import let

WIDTH, CONTAINMENT = 5, 0.8
BANDS, ROWS = 16, 2

# Notices as licenses word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
}
# End of fixed values.


def plain_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which every document that holds 0.8 of a template's shingles has one: each template's
    rarest word that stands in over a fifth of its shingles, or else as many words as it takes."""
    out: set[str] = set()
    everywhere = [w for t in templates.values() for w in set(plain_words(t))]
    for t in templates.values():
        words = plain_words(t)
        shingles = [words[i : i + WIDTH] for i in range(len(words) - WIDTH + 1)]
        open_ = [s for s in shingles if not out & set(s)]
        while len(open_) >= CONTAINMENT * len(shingles):
            best = max({w for s in open_ for w in s}, key=lambda w: (sum(w in s for s in open_) > 0.2 * len(shingles), len(w), -everywhere.count(w), w))
            out.add(best)
            open_ = [s for s in open_ if best not in s]
    return sorted(out)


def shingle_hashes(text: Column) -> Column:
    """Hashes of all shingles in order."""
    cut = F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), " "), "")

    def hashed(w: Column) -> Column:
        heads = F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - (WIDTH - 1)))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WIDTH))))

    return let(cut, hashed)


def bands(hashes: Column) -> Column:
    """Array of BANDS hashes of ROWS least values each."""

    def least_of(j: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(j))))

    least = [[least_of(b * ROWS + r) for r in range(ROWS)] for b in range(BANDS)]
    return F.array(*(F.xxhash64(F.lit(b), *values) for b, values in enumerate(least)))


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """(license, m, step, shingles): as many rows as there are templates."""
    rows = spark.createDataFrame(list(templates.items()), "license string, notice string")
    out = rows.select("license", F.array_distinct(shingle_hashes(F.col("notice"))).alias("shingles")).withColumn("m", F.size("shingles")).where("m > 0")
    return out.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("m") / 8)).cast("int"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, place): the best window of each template found in each document; place counts its shingles from 0."""
    spark = docs.sparkSession
    known = template_table(spark, templates)
    low = F.lower("text")
    span = 2 * max(len(plain_words(t)) for t in templates.values())  # over the length of any window
    some = F.lit(False)
    for word in anchors(templates):
        some = some | low.contains(word)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(some)
    # Every table made from the templates is broadcast: at most as many rows as they have shingles and bands.
    classes = F.broadcast(known.select("m", "step", F.explode("shingles").alias("h")).distinct().groupBy("h").agg(F.collect_set(F.struct("m", "step")).alias("classes")))
    hits = src.select("id", F.xxhash64("text").alias("key"), shingle_hashes(F.col("text")).alias("all"))
    wanted = F.broadcast(known.agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("wanted")))
    hits = hits.join(wanted, F.arrays_overlap("all", "wanted"))
    places = F.filter(F.transform("all", lambda x, i: F.struct(x.alias("h"), i.alias("i"))), lambda e: F.array_contains("wanted", e["h"]))
    near = F.transform(places, lambda e: F.struct(e["h"].alias("h"), e["i"].alias("i"), F.slice("all", F.greatest(F.lit(0), e["i"] - span) + 1, 2 * span).alias("around")))
    placed = hits.select("id", "key", F.explode(near).alias("e")).join(classes, F.col("e.h") == F.col("h")).select("id", "key", F.col("e.i").alias("i"), F.col("e.around").alias("around"), F.explode("classes").alias("c"))
    size = F.col("c.m") + F.col("c.step") - 1
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / F.col("c.step"))).cast("int")
    starts = F.sequence(first, F.greatest(first, F.floor(F.col("i") / F.col("c.step")).cast("int")))
    windows = placed.select("id", "key", F.col("c.m").alias("m"), F.explode(starts).alias("k"), F.col("c.step").alias("step"), "i", "around")
    first = F.col("k") * F.col("step")
    shingles = F.slice("around", first - F.greatest(F.lit(0), F.col("i") - span) + 1, F.col("m") + F.col("step") - 1)
    windows = windows.select("id", "key", "m", first.alias("place"), F.array_distinct(shingles).alias("shingles")).dropDuplicates(["id", "key", "m", "place"])
    banded = known.select("license", F.col("m").alias("tm"), F.col("shingles").alias("of"), F.explode(bands(F.col("shingles"))).alias("tb"))
    met = windows.withColumn("b", F.explode(bands(F.col("shingles")))).join(F.broadcast(banded), (F.col("b") == F.col("tb")) & (F.col("m") == F.col("tm")))
    share = F.size(F.array_intersect("of", "shingles")) / F.col("m")
    found = met.select("id", "key", "license", share.alias("containment"), "place").where(F.col("containment") >= CONTAINMENT)
    best = found.groupBy("id", "key", "license").agg(F.max_by(F.struct("containment", "place"), F.struct("containment", -F.col("place"))).alias("b"))
    return best.select("id", "license", "b.containment", F.col("b.place").cast("long").alias("place"))


#: The same windows, by exact hits of template shingles instead of bands.
SQL = rf"""
WITH t AS (SELECT UNNEST({list(TEMPLATES)!r}) AS license, UNNEST({[t.replace(chr(34), " ").replace(chr(39), " ") for t in TEMPLATES.values()]!r}) AS notice),
tw AS (SELECT license, regexp_extract_all(lower(notice), '[\p{{L}}\p{{N}}]+') AS ws FROM t),
ts AS (SELECT DISTINCT license, UNNEST([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) AS s FROM tw),
tm AS (SELECT license, s, COUNT(*) OVER (PARTITION BY license) AS m FROM ts),
k AS (SELECT license, s, m, GREATEST(1, m // 8) AS step FROM tm),
d AS (SELECT row_number() OVER () AS rid, doc_id, ws FROM (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents)),
g AS (SELECT rid, UNNEST(range(0, len(ws) - 4)) AS i, UNNEST([array_to_string(ws[j+1:j+5], ' ') FOR j IN range(0, len(ws) - 4)]) AS s FROM d WHERE len(ws) >= 5),
h AS (SELECT rid, i, license, s, m, step, UNNEST(range(GREATEST(0, CAST(CEIL((i - m - step + 2) / step) AS BIGINT)), i // step + 1)) AS w FROM g JOIN k USING (s)),
c AS (SELECT rid, license, w * step AS place, COUNT(DISTINCT s) / m AS containment FROM h GROUP BY rid, license, w, step, m),
b AS (SELECT *, row_number() OVER (PARTITION BY rid, license ORDER BY containment DESC, place) AS n FROM c WHERE containment >= {CONTAINMENT})
SELECT doc_id, license, CAST(containment AS DOUBLE) AS containment, CAST(place AS BIGINT) AS place FROM b JOIN d USING (rid) WHERE n = 1
"""


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
