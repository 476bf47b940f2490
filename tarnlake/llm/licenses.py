"""License scans by diagonal voting over word k-gram hashes.

Every run of ``K`` words of a text is hashed and joined to the positions that it has in the
license templates. A match votes for its diagonal, the word number in the text less that in the
template. Votes are counted for each text, template and diagonal; neighbouring diagonals (at most
``SLACK`` words apart, for words added or left out) whose spans lie within ``REACH`` words are
merged. A merged span is verified: the template words that its votes cover must be ``COVER`` of the
template (``SHORT_COVER`` of one under ``SHORT`` words, as short notices share most of their words)
and ``DENSE`` of the span's own words. (Two of a thousand billion k-grams share a 64-bit hash by
chance less than once in ten million, and a span needs many.)

Beside these, ``PHRASES`` are found wherever their words stand consecutively.

All of it is DataFrame expressions. A text is cut into words once: one pass gives its base places
and the hashes that the templates hold too (up to ``MOST_LISTED`` of those are part of the plan;
of more, all hashes of the texts are kept for the join). That narrow table is written to the
shared folder; votes and labels come from it, and rows grow with the matches and not with a text.

Defined results: null, empty and wordless texts have no words and no labels (first_word and
last_word null, labels empty); repeated rows are scanned and returned as often; rows with a null
doc_id are scanned like others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import ascii_lower, settle
from tarnlake.llm.spans import bind

K = 4
SLACK = 3
REACH = 40
COVER = 0.5
SHORT = 20
SHORT_COVER = 0.8
DENSE = 0.5
MOST_LISTED = 10_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The versions of the Creative Commons licenses.
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Openings and notices of well-known public licenses; of one label there may be several forms.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Released under the MIT License",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0",
    ),
    "apache": tuple(f"Licensed under the Apache License, Version {v}" for v in ("1.0", "1.1")),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License",
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "Licensed under the GNU General Public License, version 3",
        "Released under the GNU General Public License, version 3",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, version 2.0",
    ),
    "mpl": tuple(f"Licensed under the Mozilla Public License, version {v}" for v in ("1.0", "1.1")),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",),
    # short forms: a whole notice of one of these covers most of the others' words as well
    "cc-by-notice": ("Creative Commons Attribution License", *(f"Creative Commons Attribution {v}" for v in CC_VERSIONS), *(f"Licensed under CC BY {v}" for v in CC_VERSIONS)),
    "cc-by-sa-notice": ("Creative Commons Attribution ShareAlike", *(f"Licensed under CC BY-SA {v}" for v in CC_VERSIONS)),
    "cc-by-nc-notice": ("Creative Commons Attribution NonCommercial", *(f"Licensed under CC BY-NC {v}" for v in CC_VERSIONS)),
    "reserved-notice": ("No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher",),
}


def template_words(text: str) -> list[str]:
    return re.sub(SEPARATORS, " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def template_grams(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, int, int, int, list[str]]]:
    """(label, number of its form, place, words of the form, k-gram) of every k-gram."""
    rows = []
    for label, forms in templates.items():
        for form, text in enumerate(forms):
            w = template_words(text)
            rows += [(label, form, i, len(w), w[i : i + K]) for i in range(len(w) - K + 1)]
    return rows


def template_rows(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """gram (hash), label, form, place and n (words of the form) of every template k-gram: a
    constant of the plan, which no Python process has to read."""
    rows = [dict(zip(("label", "form", "place", "n", "words"), row, strict=True)) for row in template_grams(templates)]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,form:int,place:int,n:int,words:array<string>>>")))
    return table.select(_gram(F.col("words"), F.lit(0)).alias("gram"), "label", "form", "place", "n")


def _gram(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(K)])


def words_of(text: Column) -> Column:
    """Words of a text, from 0; none of null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), lambda w: w != "")


def phrase_places(words: Column) -> Column:
    """array of (label, start) of all places of the base phrases."""
    none = F.array().cast("array<struct<label:string,start:long>>")

    def each(x: Column) -> Column:
        # with one space before, between and behind the words, one search tells that a phrase isn't there
        found = []
        for phrase, label in PHRASES.items():
            places = _places(x["words"], phrase.split(), label)
            found.append(F.when(F.contains(x["spaced"], F.lit(f" {phrase} ")), places).otherwise(none))
        return F.concat(*found)

    return bind(F.struct(words.alias("words"), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("spaced")), each)


def _places(words: Column, parts: list[str], label: str) -> Column:
    def here(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + j) == part)
        return test

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))


def read_once(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, n_words, base (label, start) and hits (at, gram) of every
    document, as a settled table."""
    grams = [r.gram for r in templates.select("gram").distinct().limit(MOST_LISTED + 1).collect()]

    def told(w: Column) -> Column:
        places = F.when(F.size(w) >= K, F.sequence(F.lit(0), F.size(w) - K)).otherwise(F.array().cast("array<int>"))
        every = F.transform(places, lambda i: F.struct(i.alias("at"), _gram(w, i).alias("gram")))
        hits = F.filter(every, lambda x: x["gram"].isin(grams)) if len(grams) <= MOST_LISTED else every
        return F.struct(F.size(w).cast("long").alias("n_words"), phrase_places(w).alias("base"), hits.alias("hits"))

    rows = documents.select("doc_id", bind(words_of(F.col("text")), told).alias("x"))
    return settle(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "x.*"), "licenses")


def spans(held: DataFrame, templates: DataFrame) -> DataFrame:
    """row, label, form, first, last (words, end exclusive), votes, cover, verified. held: row and hits."""
    matched = held.select("row", F.inline("hits")).join(templates, "gram")
    text = ["row", "label", "form"]
    diagonals = matched.groupBy(*text, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places"), F.count("*").alias("votes"), F.first("n").alias("n"))
    order = Window.partitionBy(*text).orderBy("diagonal", "first")
    far = (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK) | (F.greatest("first", F.lag("first").over(order)) - F.least("last", F.lag("last").over(order)) > REACH)
    parts = diagonals.withColumn("part", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy(*text, "part").agg(F.min("first").alias("first"), (F.max("last") + K).alias("last"), F.sum("votes").alias("votes"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.first("n").alias("n"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + K - 1)))))
    cover = covered / F.col("n")
    dense = covered / (F.col("last") - F.col("first"))
    enough = cover >= F.when(F.col("n") < SHORT, SHORT_COVER).otherwise(COVER)
    return merged.select(*text, "first", "last", "votes", cover.alias("cover"), (enough & (dense >= DENSE)).alias("verified"))


def scan(documents: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    table = template_rows(documents.sparkSession, TEMPLATES if templates is None else templates)
    held = read_once(documents, table)
    found = spans(held, table).where("verified").groupBy("row").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    starts = F.transform("base", lambda x: x["start"])
    labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    base = held.select("row", "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels.alias("own"))
    every = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0)))
    return base.join(found, "row", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
