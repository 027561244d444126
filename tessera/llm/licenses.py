"""License scans. Native: DataFrame functions only.

Texts become lower-case words (runs of letters and digits). A template, or a part of 48 words of a
longer one, is a set of shingles of five words; one of fewer words is a single shingle. A
document's text is cut into overlapping windows of 16 to 128 words, half a window apart; the window
that suits a template is at least twice as long, so some window holds each copy whole. A window's
set is reduced to shingles that any template has, which changes nothing in what it shares with a template.

Windows and templates are joined by the hashes of their shingles, so nothing that stands beside a copy can
hide it: each template's shingles in each window of its size are counted exactly, and at least 0.8 of the
template's must stand in the window. Its span runs from the first to the last of them. The shingles that are joined are
the library's alone, so the rows made are bounded by the hits and the templates that share a shingle.

Before all that a text is passed over if it has none of the anchors, words of which every verified match
contains one, so no match is lost. The template library bounds all that is held in plans.

Null and empty texts have no matches. Copies of one template that stand within one window of each other are
one span. Rows that repeat an id have a row each. Texts may have any length; an empty table gives an empty result;
columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import json
import math
import re

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table, text_of

#: Notices of public licenses as they are published.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
WORDS, PART = 5, 48
TOKEN = r"[\p{L}\p{N}]+"


def parts(templates: dict[str, str]) -> list[tuple[str, int, int, list[str], list[str]]]:
    """(name, part, window, words, shingles) of each template part."""
    out = []
    for name, text in sorted(templates.items()):
        words = re.findall(r"[^\W_]+", text.lower())
        for k, start in enumerate(range(0, max(1, len(words) - WORDS + 1), PART)):
            piece = words[start : start + PART] if len(words) - start - PART >= WORDS else words[start:]
            size = min(WORDS, len(piece))
            window = 16
            while window < 2 * len(piece):
                window *= 2
            out.append((name, k, window, piece, sorted({" ".join(piece[i : i + size]) for i in range(len(piece) - size + 1)})))
            if piece == words[start:]:
                break
    return out


def anchors_of(shingle_sets: list[list[str]], containment: float) -> list[str]:
    """A few long words: whoever has ``containment`` of any set's shingles has one of them."""
    out: list[str] = []
    for shingles in sorted(shingle_sets, key=len):
        need = max(1, math.ceil(containment * len(shingles)))
        left = [s for s in shingles if not set(s.split()) & set(out)]
        while len(left) >= need:
            count = Counter(w for s in left for w in set(s.split()))
            best = max(count, key=lambda w: (min(len(w), 8), count[w], w))
            out.append(best)
            left = [s for s in left if best not in s.split()]
    return sorted(out)


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, h, name, start, stop (words), share: one row per match. docs: doc_id, h, text."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    library = parts(TEMPLATES if templates is None else templates)
    anchors = anchors_of([shingles for *_, shingles in library], containment)
    sizes = sorted({len(s.split()) for *_, shingles in library for s in shingles})
    rows = [(f"{n}\t{k}", n, w, len(sh), s) for n, k, w, _, sh in library for s in sh]
    # a literal: rows made by the driver would need Python on the executors
    table_ = json.dumps([dict(zip(("template", "name", "window", "size", "shingle"), r, strict=True)) for r in rows])
    library_ = F.from_json(F.lit(table_), "array<struct<template:string,name:string,window:int,size:int,shingle:string>>")
    shingles = spark.range(1).select(F.explode(library_).alias("r")).select("r.*").withColumn("hash", F.xxhash64("shingle"))
    known = sorted({r["hash"] for r in shingles.select("hash").collect()})

    # the lower-cased text is bound once for all anchors
    near = F.exists(F.array(F.lower("text")), lambda t: functools.reduce(lambda a, b: a | b, [t.contains(x) for x in anchors], F.lit(False)))
    some = docs.where(near).select("doc_id", "h", F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)).alias("w"))
    n = F.size("w")

    def of_size(size: int) -> Column:
        all_ = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(i.alias("at"), F.lit(size).alias("n"), F.xxhash64(F.array_join(F.slice(F.col("w"), i + 1, size), " ")).alias("hash")))
        return F.when(n >= size, F.filter(all_, lambda s: s["hash"].isin(known))).otherwise(F.filter(F.array(F.struct(F.lit(0).alias("at"), F.lit(size).alias("n"), F.lit(0).cast("long").alias("hash"))), lambda s: F.lit(False)))

    hits = scratch.keep(some.select("doc_id", "h", F.explode(F.concat(*[of_size(s) for s in sizes])).alias("s")).select("doc_id", "h", "s.*").distinct())
    scales = sorted({w for _, _, w, _, _ in library})
    where = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), (F.floor(F.col("at") / (w // 2)) - back).alias("k")) for w in scales for back in (0, 1)]))
    placed = hits.withColumn("p", where).select("doc_id", "h", "at", "n", "hash", "p.*")
    placed = placed.where((F.col("k") >= 0) & (F.col("at") + F.col("n") <= F.col("k") * F.col("window") / 2 + F.col("window")))
    key = ["doc_id", "h", "window", "k"]
    inside = placed.join(F.broadcast(shingles.select("template", "name", "window", "size", "hash")), ["window", "hash"])
    sure = inside.groupBy(*key, "template", "name", "size").agg(F.countDistinct("hash").alias("got"), F.min("at").alias("start"), F.max(F.col("at") + F.col("n")).alias("stop"))
    sure = sure.where(F.col("got") >= containment * F.col("size"))
    # windows overlap: spans of a template that touch are one
    order = Window.partitionBy("doc_id", "h", "name").orderBy("start", "stop")
    sure = sure.withColumn("new", F.when(F.col("start") <= F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    sure = sure.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return sure.groupBy("doc_id", "h", "name", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(F.col("got") / F.col("size")).alias("share")).drop("run")


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col="doc_id", text_col="text", containment: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, n_matches, licenses (name:start:stop in words, by start), best (largest containment; 0 without a match)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    spans = license_spans(rows.withColumn("h", F.xxhash64("text")), templates, containment)
    said = F.sort_array(F.collect_list(F.struct("start", "stop", "name")))
    spans = spans.groupBy("doc_id", "h").agg(said.alias("s"), F.max("share").alias("best"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.size("s").cast("long").alias("n_matches"), F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["name"], x["start"], x["stop"])), ",").alias("licenses"), "best")
    out = rows.select("doc_id", F.xxhash64("text").alias("h")).join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return out.select("doc_id", F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"))


def op10(spark, sf_dir):
    return licenses(table(spark, sf_dir, "documents"))
