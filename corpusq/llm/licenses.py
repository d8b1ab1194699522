"""License scans: MinHash bands over text windows find templates, exact containment verifies them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Names and short standard notices of public licenses.
TEMPLATES = {
    "MIT line": "Released under the MIT License.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
SHINGLE, CONTAINMENT = 5, 0.8
#: Windows in shingles; each template is looked for with the largest of which it holds one at any alignment.
WINDOWS = (1, 8, 32)


def bands_for(likeness: float, chance: float, rows: int = 1) -> int:
    """Bands of `rows` rows so that sets of that Jaccard likeness meet in one with the chance given."""
    return math.ceil(math.log(1 - chance) / math.log(1 - likeness**rows))


def with_shingles(df: DataFrame, text: str) -> DataFrame:
    """Adds _h: hashes of the five-word shingles in order, of letters and digits alone, in lower case; of fewer
    words one of them all."""
    d = df.withColumn("_w", F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    starts = F.when(F.size("_w") > SHINGLE, F.sequence(F.lit(0), F.size("_w") - SHINGLE)).when(F.size("_w") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(F.col("_w"), i)
    return d.withColumn("_h", F.transform(starts, lambda i: F.xxhash64(*[at(i + j) for j in range(SHINGLE)]))).drop("_w")


def permuted(j: int):
    return lambda x: F.xxhash64(x, F.lit(j))


def smallest(w: int, j: int):
    return lambda i: F.xxhash64(F.lit(w), F.lit(j), F.array_min(F.slice(F.col(f"_p{j}"), i + 1, w)))


def banded(df: DataFrame, bands: int, step: dict[int, int], windows: Column | None = None) -> DataFrame:
    """From _h, one row per window and band: _key hashes (window length, band, smallest permuted hash)."""
    cols = [c for c in df.columns if c != "_h"]
    for j in range(bands):
        df = df.withColumn(f"_p{j}", F.transform("_h", permuted(j)))
    n = F.size("_h")
    keys = []
    for w, by in step.items():
        first = F.when(n > w, F.concat(F.sequence(F.lit(0), n - w, F.lit(by)), F.array(n - w))).when(n == w, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        first = first if windows is None else F.when(windows == w, first).otherwise(F.array().cast("array<int>"))
        for j in range(bands if w > 1 else 1):
            keys.append(F.transform(first, smallest(w, j)))
    return df.select(*cols, F.explode(F.concat(*keys)).alias("_key"))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    t = with_shingles(spark.createDataFrame(list(templates.items()), "license string, _t string"), "_t").drop("_t")
    n = F.size("_h")
    fits = F.lit(WINDOWS[0])
    for w in WINDOWS[1:]:
        fits = F.when(n * 2 >= 3 * w, F.lit(w)).otherwise(fits)
    return t.withColumn("_window", fits)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT, chance: float = 0.995) -> DataFrame:
    """(doc_id, license, n_shingles, n_found, containment) of each template that a whole text holds.

    A template of n shingles is looked for with the largest window w <= 2n/3, so that at half-window steps one
    window lies within any copy. At `containment` of its shingles kept, such a window's Jaccard likeness is about
    c / (2 - c); the bands meet there with the given chance, and always in exact copies. What they retrieve is
    verified: found shingles over all shingles of the template >= containment.

    The templates are a parameter; their table (hashes only) is what is broadcast. Null or wordless texts hold
    none. Rows that share an id, or have none, count as one document, of which the text that holds most of a
    template counts. Very long texts are taken whole. Other columns, whatever their names, are not read. Empty table:
    empty result.
    """
    spark = docs.sparkSession
    t = template_table(spark, templates)
    bands = bands_for(containment / (2 - containment), chance)
    of_template = banded(t, bands, {w: 1 for w in WINDOWS}, F.col("_window")).select("license", "_key").distinct()
    d = with_shingles(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text").drop("_text")
    met = banded(d, bands, {w: max(1, w // 2) for w in WINDOWS}).join(F.broadcast(of_template), "_key").select("_id", "license").distinct()
    met = written(met.withColumnRenamed("_id", "_met"), "license-candidates")
    same = F.col("_id").eqNullSafe(F.col("_met"))
    own = with_shingles(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(met.select("_met").distinct(), same, "left_semi"), "_text").drop("_text")
    pairs = own.join(met, same).drop("_met").join(F.broadcast(t.select("license", F.array_distinct("_h").alias("_t"))), "license")
    shared = pairs.select("_id", "license", F.size("_t").cast("long").alias("n_shingles"), F.size(F.array_intersect("_t", "_h")).cast("long").alias("n_found"))
    best = shared.groupBy("_id", "license", "n_shingles").agg(F.max("n_found").alias("n_found"))
    return best.where(F.col("n_found") >= containment * F.col("n_shingles")).select(F.col("_id").alias(doc_id), "license", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))
