"""License scan: MinHash bands over overlapping text windows retrieve notice templates, exact containment verifies them.

Shingles are ``SHINGLE`` lower-cased words without punctuation; three, not five, since common notices have three to seven
words. A template is cut into pieces of at most 16 shingles, and a piece of n shingles is looked for in windows of 2w
shingles at every w-th shingle, w being the power of two next to n, so one window holds any place of the piece. Its
similarity to that window is over 1/4 when copied exactly and over 0.19 when a fifth is altered; with ``BANDS`` bands of
one minimum each a band collides with probability 1 - 1e-6 and 0.99996. Windows without any template shingle cannot match
and are left out first.

Everything is column expressions; templates and their bands are a few thousand rows at most and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 3
BANDS = 48
WIDTHS = (1, 2, 4, 8, 16)
CONTAINMENT = 0.8
MAX_TEMPLATES = 500

# Well-known notices in their public wording.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-program", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License"),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "All rights reserved"),
)

_SPLIT = r"[\x20\x09-\x0D.,;:!?()\"'/]+"


def shingles(text: Column) -> Column:
    """Hashes of all successive shingles; empty where the text has too few words."""
    words = F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")
    h = F.transform(words, lambda w: F.xxhash64(w))

    def joined(x: Column) -> Column:
        n = F.size(x)
        out = x
        for i in range(1, SHINGLE):
            out = F.zip_with(F.slice(out, F.lit(1), n - i), F.slice(x, F.lit(i + 1), n - i), lambda a, b: F.xxhash64(a, b))
        return F.when(n >= SHINGLE, out).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(h), joined), 1)


def minima(values: Column) -> Column:
    """One minimum per band; hashing with the band's number orders the shingles anew for each."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda s: F.array_min(F.transform(values, lambda x: F.xxhash64(s, x))))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """license, all (distinct shingles), pieces: array of arrays of at most 16 shingles."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; the broadcast is bounded at {MAX_TEMPLATES}")
    rows = spark.createDataFrame(list(templates), "license string, notice string").select("license", shingles(F.col("notice")).alias("all"))
    top = WIDTHS[-1]
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("all") / top).cast("int") - 1), lambda i: F.slice("all", i * top + 1, F.lit(top)))
    return rows.filter(F.size("all") > 0).select("license", F.array_distinct("all").alias("all"), cut.alias("pieces"))


def find_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document and notice found in it: doc_id, license, places, containment.

    ``containment`` is the largest share of the notice's shingles within reach of one window, at least 0.8; ``places``
    counts the windows it was verified at. Null, empty and very short texts have none. Rows with equal doc_id are reported
    together; a null doc_id is an id like any other. Templates with fewer words than a shingle are ignored.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    every = sorted({h for r in known.select("all").collect() for h in r["all"]})
    schema = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", license string, places long, containment double"
    if not every:
        return spark.createDataFrame([], schema)
    any_of = F.array(*[F.lit(h) for h in every])
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", shingles(F.col("text")).alias("h")).filter(F.arrays_overlap("h", any_of))

    def windows(w: int) -> Column:
        count = F.ceil(F.size("h") / w).cast("int") - 1
        found = F.transform(F.sequence(F.lit(0), count), lambda i: F.struct(F.lit(w).alias("w"), (i * w).alias("at"), F.slice("h", i * w + 1, F.lit(2 * w)).alias("s")))
        return F.filter(found, lambda x: F.arrays_overlap(x["s"], any_of))

    placed = texts.select("doc_id", "h", F.explode(F.concat(*[windows(w) for w in WIDTHS])).alias("x"))
    placed = placed.select("doc_id", "h", "x.w", "x.at", F.posexplode(minima(F.col("x.s"))).alias("band", "low"))
    pieces = known.select("license", "all", F.explode("pieces").alias("piece"))
    width = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS):
        width = F.when(F.size("piece") <= w, F.lit(w)).otherwise(width)
    bands = pieces.select("license", "all", width.alias("w"), F.posexplode(minima(F.col("piece"))).alias("band", "low"))
    hits = placed.join(F.broadcast(bands), ["w", "band", "low"])
    n = F.size("all")
    reach = F.slice("h", F.greatest(F.col("at") - n + 1, F.lit(1)), 2 * n + 2 * F.col("w"))
    share = F.size(F.array_intersect("all", reach)) / n
    hits = hits.select("doc_id", "license", "at", "w", share.alias("containment")).filter(F.col("containment") >= CONTAINMENT)
    per = hits.groupBy("doc_id", "license", "w", "at").agg(F.max("containment").alias("containment"))
    return per.groupBy("doc_id", "license").agg(F.count("*").alias("places"), F.max("containment").alias("containment"))
