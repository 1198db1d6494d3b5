"""License scans in DataFrame operations only.

Texts are cut into overlapping windows; MinHash bands over a window's five-word shingles retrieve templates,
and exact shingle containment in the window verifies them.

Templates are grouped by their number of shingles into (m/2, m] for m = 1, 2, 4, 8 ...; a group's windows hold
2m shingles and start every m, so each passage of m shingles lies whole in one. A copy that holds 80 % of a
template's shingles then has a Jaccard similarity with its window of at least 0.4m / 2.1m = 0.19, and with
48 bands of one row it collides with a probability of at least 1 - 0.81 ** 48 = 0.99996.

Before the bands, rows and windows without any shingle of the group's templates are dropped; such a
window can't hold a template. So hashing costs follow the license text in the corpus, and the only work on all
text is one pass that hashes shingles. There is no shuffle of texts; matches are aggregated per row and template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 48
CONTAINMENT = 0.8

#: Notices by which a text names its license (fixed values), and what their license requires to be kept.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
)


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of all runs of n words; texts of fewer words have none."""
    of = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    # A lambda over a one-element array names the words: the expression itself would be evaluated for each i.
    return F.get(F.transform(F.array(_words(text)), lambda w: F.when(F.size(w) >= n, of(w)).otherwise(F.array().cast("array<bigint>"))), 0)


def _bands(shingles: Column, bands: int) -> Column:
    """One MinHash a band: the least shingle under hash function j, for each j."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, j))))


def scan(docs: DataFrame, row_id: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """Return one row per row and template found: row_id, license, containment, n_windows, first_word.

    containment: the largest share of the template's distinct shingles in one window, at least the threshold;
    n_windows: windows that reach it; first_word: where the first of them begins (0 is the first word). Null,
    empty and short texts match nothing; repeated rows (same id) are scanned apart and reported together, null
    ids as one. Templates of under five words can't be found and raise ValueError.
    """
    spark: SparkSession = docs.sparkSession
    cases = F.inline(F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("body")) for n, t in templates]))
    known = spark.range(1).select(cases).select("license", F.array_distinct(shingle_hashes(F.col("body"))).alias("want"))
    known = [(r["license"], r["want"]) for r in known.collect()]
    groups: dict[int, set[int]] = {}
    for name, want in known:
        if not want:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        groups.setdefault(1 << (len(want) - 1).bit_length(), set()).update(want)

    literal = lambda values: F.array(*[F.lit(v) for v in sorted(values)])
    # As many rows as templates, times bands: small by what it is.
    wanted = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("license"), F.lit(1 << (len(w) - 1).bit_length()).alias("m"), literal(w).alias("want")) for n, w in known])))
    wanted = wanted.select("license", "m", "want", F.posexplode(_bands(F.col("want"), bands)).alias("band", "least"))
    sizes = F.inline(F.array(*[F.struct(F.lit(m).alias("m"), literal(w).alias("any_of")) for m, w in sorted(groups.items())]))

    # explode() of one array makes the hashes a column, computed once a row, not an expression that is copied.
    hashed = docs.select(F.col(row_id).alias("row_id"), F.explode(F.array(shingle_hashes(F.col(text)))).alias("h")).where(F.arrays_overlap("h", literal({x for _, w in known for x in w})))
    sized = hashed.select("row_id", "h", sizes).where(F.arrays_overlap("h", "any_of"))
    starts = F.filter(F.expr("sequence(0, size(h) - 1, m)"), lambda s: F.arrays_overlap(F.slice(F.col("h"), s + 1, 2 * F.col("m")), F.col("any_of")))
    windows = sized.select("row_id", "h", "m", F.explode(starts).alias("first_word"))
    windows = windows.select("row_id", "m", "first_word", F.explode(F.array(F.array_distinct(F.slice("h", F.col("first_word") + 1, 2 * F.col("m"))))).alias("w"))
    banded = windows.select("row_id", "m", "first_word", "w", F.posexplode(_bands(F.col("w"), bands)).alias("band", "least"))
    retrieved = banded.join(F.broadcast(wanted), ["m", "band", "least"])
    share = F.size(F.array_intersect("w", "want")) / F.size("want")
    # A window may retrieve a template by many bands: one row of it is enough, found before the exact check.
    once = retrieved.groupBy("row_id", "license", "first_word").agg(F.max(share).alias("share"))
    return once.where(F.col("share") >= containment).groupBy("row_id", "license").agg(F.max("share").alias("containment"), F.count("*").alias("n_windows"), F.min("first_word").cast("bigint").alias("first_word")).withColumnRenamed("row_id", row_id)
