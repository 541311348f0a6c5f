"""License scans: MinHash bands over overlapping windows, then exact containment.

A text's words are letters and digits in lower case. For every template, windows as long as the template
step through the text by a quarter of their length; a window retrieves a template if they share a band of their
MinHashes, and the match is verified by the part of the template's five-word shingles that the window and one step on
either side hold. With 16 bands of 2, a window at a Jaccard similarity of 0.75, the least that stepping leaves of a whole
template, is retrieved with a chance above 0.999999, and at 0.5 of 0.99. Only windows that hold a
shingle of some template are hashed; others cannot match.

Only DataFrame operations. Templates are a list of the caller's, held to `MAX_TEMPLATES`, which bounds what every task gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradelift.llm.common import cut

WORDS, BANDS, ROWS, CONTAINED = 5, 16, 2, 0.8
MAX_TEMPLATES = 2000

# The wording of common license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                 "(the \"Software\"), to deal in the Software without restriction",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingle(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])


def _starts(words: Column) -> Column:
    n = F.size(words) - WORDS
    return F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _shingles(words: Column) -> Column:
    return F.array_distinct(F.transform(_starts(words), lambda i: _shingle(words, i)))


def _bands(shingles: Column) -> Column:
    """BANDS hashes, each of ROWS minima, made in one pass over the hash functions."""
    least = lambda k: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, k)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(*[least(b * ROWS + r) for r in range(ROWS)]).alias("value")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment, windows, first_word and end_word for each document and each template found in it.

    containment is the best of the windows that match, and the words run from the first such window's start to the last
    one's end, the step on either side included. Every template needs at least five words. Documents without
    a match, null, empty or short texts among them, have no row. Rows alike in doc_id are taken as one document's;
    a null doc_id is a value like any other. Other columns are not read."""
    spark, templates = docs.sparkSession, TEMPLATES if templates is None else templates
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    given = spark.createDataFrame(list(templates.items()) or [("", "")], "license string, text string")
    given = given.withColumn("words", words_of(F.col("text"))).withColumn("shingles", _shingles(F.col("words")))
    kept = [r for r in given.select("license", F.size("words").alias("size"), "shingles", _bands(F.col("shingles")).alias("bands")).collect() if templates]
    if any(r.size < WORDS for r in kept):
        raise ValueError("a template has fewer than five words")
    marks, sizes = sorted({s for r in kept for s in r.shingles}), sorted({r.size for r in kept})
    shape = "license string, size int, band int, value bigint, shingles array<bigint>"
    known = spark.createDataFrame([(r.license, r.size, b.band, b.value, r.shingles) for r in kept for b in r.bands], shape)

    split = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    found = split.withColumn("hits", F.filter(_starts(F.col("words")), lambda i: _shingle(F.col("words"), i).isin(marks)))
    # as a generator, so that no filter makes the words and hits a second time
    some = found.select(F.explode(F.filter(F.array(F.struct("doc_id", "words", "hits")), lambda x: F.size(x["hits"]) > 0)).alias("x")).select("x.*")
    some = cut(some)

    def windows(size: int) -> Column:
        step = max(1, size // 4)
        near = lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p + WORDS - size) / step).cast("int")), F.floor(p / step).cast("int"))
        return F.transform(F.array_distinct(F.flatten(F.transform("hits", near))), lambda k: F.struct(F.lit(size).alias("size"), F.lit(step).alias("step"), (k * step).alias("start")))

    if not sizes:
        return some.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("windows"), F.lit(0).alias("first_word"), F.lit(0).alias("end_word")).limit(0)
    each = some.select("doc_id", "words", F.explode(F.concat(*[windows(s) for s in sizes])).alias("w")).select("doc_id", "words", "w.*")
    low = F.greatest(F.col("start") - F.col("step"), F.lit(0))
    high = F.least(F.col("start") + F.col("size") + F.col("step"), F.size("words"))
    each = each.select("doc_id", "size", low.alias("low"), high.alias("high"), _shingles(F.slice("words", F.col("start") + 1, F.col("size"))).alias("own"),
                       F.slice("words", low + 1, high - low).alias("around"))
    asked = each.withColumn("around", _shingles(F.col("around"))).select("doc_id", "size", "low", "high", "around", F.explode(_bands(F.col("own"))).alias("b"))
    asked = asked.select("doc_id", "size", "low", "high", "around", "b.band", "b.value")
    met = asked.join(F.broadcast(known), ["size", "band", "value"])
    share = F.size(F.array_intersect("shingles", "around")) / F.size("shingles")
    checked = met.select("doc_id", "license", "low", "high", share.alias("share")).where(F.col("share") >= contained)
    return checked.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.countDistinct("low").alias("windows"), F.min("low").alias("first_word"), F.max("high").alias("end_word"))
