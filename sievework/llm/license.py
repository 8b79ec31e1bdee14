"""License scans: templates retrieved by MinHash bands of overlapping windows, verified by exact containment.

DataFrame and SQL functions only. Texts become lower-case words of letters and digits and five-word shingles.
Templates are grouped by size; for a group of up to c shingles, windows hold 2c shingles and start every c, so
a copy of a template lies whole in some window. A window holding ``least`` of a template's shingles then has a
Jaccard similarity of at least J with it, and with one row a band the number of bands is set so that
1 - (1 - J)^bands reaches ``chance``. Windows without any template shingle are passed over, as no band of
theirs can equal a template's, and so are texts without any of a few words that every match must hold. Candidates are verified by exact containment of the shingles' words.

Null, empty and shorter texts than five words have no match and no row. Several matches of one template in a
document give one row with the best containment and the first place. Repeated rows each give their rows.
An empty table gives an empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, LEAST, CHANCE, MOST_TEMPLATES = 5, 0.8, 0.9999, 200
#: Notices as their licenses word them.
TEMPLATES = {
    "apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit notice": "Released under the MIT License.",
    "mit grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "gpl-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


@dataclass(frozen=True)
class Group:
    """Templates of up to ``most`` shingles, and the bands that retrieve them."""

    most: int
    bands: int
    names: tuple[str, ...]


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(w: Column) -> Column:
    """A 64-bit hash of each five-word shingle, in order."""
    n = F.size(w)
    h = F.zip_with(w, F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))
    for k in range(3, SHINGLE + 1):
        h = F.zip_with(h, F.slice(w, k, n), lambda a, b: F.xxhash64(a, b))
    return F.when(n >= SHINGLE, F.slice(h, F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def band_values(hashes: Column, bands: int) -> Column:
    """The MinHash of each band, one row a band, marked with the band's number."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.xxhash64(j, F.array_min(F.transform(hashes, lambda x: F.xxhash64(j, x)))))


def band_count(most: int, shingles: int, least: float, chance: float) -> int:
    """Bands that retrieve a match with at least this chance, at the least Jaccard similarity a match can have."""
    shared = math.ceil(least * shingles)
    j = shared / (2 * most + shingles - shared)
    return math.ceil(math.log(1 - chance) / math.log(1 - j))


def prepare(spark, templates: dict[str, str], least: float, chance: float) -> list[tuple[Group, dict[str, tuple]]]:
    """Groups by size, each with every template's words, shingles, their hashes and its bands; at most ``MOST_TEMPLATES`` come to the driver."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    frame = spark.createDataFrame(list(templates.items()), "name string, text string").select("name", words(F.col("text")).alias("w")).select("name", "w", shingle_hashes(F.col("w")).alias("h"))
    known = {r["name"]: (r.w, r.h) for r in frame.collect()}
    sizes: dict[int, list[str]] = {}
    for name, (w, h) in known.items():
        if not h:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        sizes.setdefault(1 << max(3, (len(h) - 1).bit_length()), []).append(name)
    out = []
    for most, names in sorted(sizes.items()):
        bands = max(band_count(most, len(set(known[n][1])), least, chance) for n in names)
        own = frame.where(F.col("name").isin(names)).select("name", band_values(F.col("h"), bands).alias("b")).collect()
        by = {r["name"]: r.b for r in own}
        out.append((Group(most, bands, tuple(names)), {n: (known[n][0], sorted({" ".join(known[n][0][i : i + SHINGLE]) for i in range(len(known[n][1]))}), sorted(set(known[n][1])), by[n]) for n in names}))
    return out


def _spots(h: Column, own: list[int], c: int) -> Column:
    """The windows of 2c shingles, one every c, that hold one of the given shingles."""
    places = F.array_compact(F.transform(h, lambda x, i: F.when(x.isin(own), i)))
    first = lambda i: F.floor(i / c).cast("int")
    both = F.flatten(F.transform(places, lambda i: F.when(i >= c, F.array(first(i) - 1, first(i))).otherwise(F.array(F.lit(0)))))
    return F.transform(F.array_distinct(both), lambda k: F.struct(F.lit(c).alias("c"), k.alias("k")))


def anchors(templates: list[list[str]], least: float) -> list[str]:
    """A few long words without any of which no text can hold ``least`` of a template's shingles.

    For each template, words are taken, those taken before and then the longest first, until the shingles
    without any of them are too few for a match.
    """
    chosen: list[str] = []
    for w in sorted(templates, key=len):
        shingles = {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
        own: list[str] = []
        for word in sorted(set(w), key=lambda x: (x not in chosen, -len(x), x)):
            if sum(not set(own) & set(s) for s in shingles) < least * len(shingles):
                break
            own.append(word)
        chosen += [x for x in own if x not in chosen]
    return chosen


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, chance: float = CHANCE) -> DataFrame:
    """doc_id, license (the template's name), containment (best), first_word (place of the first match's window), n_windows."""
    groups = prepare(docs.sparkSession, templates, least, chance)
    if not groups:
        return docs.sparkSession.createDataFrame([], "doc_id long, license string, containment double, first_word long, n_windows long")
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    every = sorted({h for _, t in groups for _, _, hs, _ in t.values() for h in hs})
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = anchors([t for _, known in groups for t, *_ in known.values()], least)
    base = base.where(F.exists(F.array(F.lower("text")), lambda x: reduce(lambda a, b: a | b, [x.contains(w) for w in held], F.lit(False))))
    base = base.select("doc_id", words(F.col("text")).alias("w"))
    base = base.select("doc_id", "w", shingle_hashes(F.col("w")).alias("h")).where(F.arrays_overlap("h", longs(every)))
    base = base.withColumn("row", F.monotonically_increasing_id())
    per_group = []
    for group, known in groups:
        c = group.most
        own = sorted({h for _, _, hs, _ in known.values() for h in hs})
        per_group.append(_spots(F.col("h"), own, c))
    spots = base.select("row", "doc_id", "w", "h", F.explode(F.concat(*per_group)).alias("s"))
    c, k = F.col("s.c"), F.col("s.k")
    spots = spots.select("row", "doc_id", c.alias("c"), (k * c).alias("at"), F.slice("h", k * c + 1, 2 * c).alias("h"), F.slice("w", k * c + 1, 2 * c + SHINGLE - 1).alias("w"))
    bands = index = None
    for group, known in groups:
        own = F.array(*[F.struct(F.lit(n).alias("license"), longs(b).alias("bands"), F.array(*[F.lit(x) for x in s]).alias("shingles")) for n, (_, s, _, b) in sorted(known.items())])
        values, here = band_values(F.col("h"), group.bands), F.col("c") == group.most
        bands = F.when(here, values) if bands is None else bands.when(here, values)
        index = F.when(here, own) if index is None else index.when(here, own)
    hit = spots.withColumn("bands", bands).select("row", "doc_id", "at", "w", F.explode(F.filter(index, lambda t: F.arrays_overlap(t["bands"], F.col("bands")))).alias("t"))
    text = F.transform(F.sequence(F.lit(1), F.size("w") - (SHINGLE - 1)), lambda i: F.array_join(F.slice("w", i, SHINGLE), " "))
    share = F.size(F.array_intersect("t.shingles", text)) / F.size("t.shingles")
    found = hit.select("row", "doc_id", "at", F.col("t.license").alias("license"), share.alias("containment")).where(F.col("containment") >= least)
    return found.groupBy("row", "doc_id", "license").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"), F.count("*").alias("n_windows")).drop("row")
