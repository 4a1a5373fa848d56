"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

A block matches a template when it holds at least ``threshold`` of the template's distinct
words.  Blocks are the lines of a document and, since notices are wrapped, every run of
words across line ends that is twice the template's length.  Runs go to the join in
stretches of twice that size which overlap by half, so each run lies in one of them, and
are slid over one by one in the stretches that pass.  The join is exact: template words are ordered by how
many documents hold them, rarest first; a block that meets the threshold must hold one
of the template's first ``|T| - need + 1`` words (prefix), must have ``need`` words of
its own (length), and from the position of the first common word on both sides there
must be ``need`` words left (position).  What passes is verified on the full sets.

A document whose words as a whole do not meet any template's need has no such block, so
only the texts of the others are carried to the join.  DataFrame operations alone.

Defined results: null text counts as empty; a text without words has no place, no label
and score 0; rows are told apart by a number of their own, so rows that repeat an id or have
a null ``doc_id`` have the labels of their own text; an empty table gives no rows; extra columns are ignored; whole texts are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import ascii_lower, numbered_rows

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases and the labels they give.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Notices of public licenses, as their texts have them; words are compared, so letters' case and signs do not matter.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
)
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def need(n: int, threshold: float) -> int:
    """The words that a block must share with a template of ``n`` distinct words."""
    return max(1, math.ceil(threshold * n - 1e-9))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def phrase_places(line: Column, n_words: Column, phrases=PHRASES) -> tuple[Column, Column, Column, Column]:
    """Number, smallest and largest start, and labels of the phrases in ``line``, the words each after a blank with one at the end."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        pieces = F.split(line, f" {phrase}(?= )", -1)
        met = F.contains(line, F.lit(f" {phrase} "))
        k = len(phrase.split())
        counts.append(F.when(met, F.size(pieces) - 1).otherwise(0))
        firsts.append(F.when(met, _spaces(F.element_at(pieces, 1))))
        lasts.append(F.when(met, n_words - _spaces(F.element_at(pieces, -1)) + 1 - k))
        labels.append(F.when(met, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return total.cast("long"), F.least(*firsts).cast("long"), F.greatest(*lasts).cast("long"), F.array_compact(F.array(*labels))


def license_scan(docs: DataFrame, *, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row a document.

    ``score`` is 1 with a phrase, else the largest containment of a matching block, else 0.
    """
    spark = docs.sparkSession
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    as_array = lambda ws: F.array(*map(F.lit, ws))

    marked, row = numbered_rows(docs)
    marked = marked.select(F.col(id_col).alias("doc_id"), F.col(row).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = marked.withColumn("words", words_of(F.col("text")))
    rows = rows.select("doc_id", "row", "text", F.size("words").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"), F.array_intersect("words", as_array(vocabulary)).alias("known"))
    n_base, first, last, base = phrase_places(F.col("line"), F.col("n_words"))
    met_whole = [F.when(F.size(F.array_intersect("known", as_array(ws))) >= need(len(ws), threshold), F.lit(t)) for t, (_, ws) in enumerate(sets)]
    rows = rows.withColumn("possible", F.array_compact(F.array(*met_whole)))
    enough = F.size("possible") > 0
    scanned = rows.select("doc_id", "row", "n_words", n_base.alias("n_base"), first.alias("first_word"), last.alias("last_word"), base.alias("base"), "known", "possible", F.when(enough, F.col("text")).alias("text"))
    scanned = materialize(scanned, "licenses")

    # Document frequency of the templates' words; at most one row a template word reaches the driver.
    seen = {r.word: r.n for r in scanned.select(F.explode("known").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    index = [(t, label, w, at, len(ws), need(len(ws), threshold), ws) for t, (label, unsorted) in enumerate(sets) for ws in [sorted(unsorted, key=order.get)] for at, w in enumerate(ws[: len(ws) - need(len(ws), threshold) + 1])]
    prefixes = spark.createDataFrame(index, "template int, label string, word string, at int, size int, need int, template_words array<string>")
    rank = F.array_sort(F.transform(F.array_intersect("block", as_array(vocabulary)), lambda w: F.struct(F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), w).alias("rank"), w.alias("word"))))

    carried = scanned.where("text IS NOT NULL")
    none = F.lit(None)
    lines = carried.select("row", F.explode(F.split("text", "\n", -1)).alias("block_text")).select("row", none.cast("int").alias("only"), none.cast("int").alias("width"), none.cast("array<string>").alias("run"), F.array_distinct(words_of(F.col("block_text"))).alias("block"))
    widths = as_array([2 * len(text.split()) for _, text in templates])
    open_ = carried.select("row", words_of(F.col("text")).alias("words"), F.explode("possible").alias("only")).withColumn("width", F.element_at(widths, F.col("only") + 1))
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / F.col("width")).cast("int"))
    runs = open_.select("row", "only", "width", F.explode(F.transform(starts, lambda i: F.slice("words", i * F.col("width") + 1, 2 * F.col("width")))).alias("run")).withColumn("block", F.array_distinct("run"))
    blocks = lines.union(runs.select("row", "only", "width", "run", "block"))
    blocks = blocks.select("row", "only", "width", "run", F.size("block").alias("n_block"), F.transform(rank, lambda x: x.word).alias("ordered"))
    probes = blocks.select("row", "only", "width", "run", "n_block", "ordered", F.posexplode("ordered").alias("pos", "word"))
    met = probes.join(F.broadcast(prefixes), "word")  # the templates' own size
    met = met.where("only IS NULL OR only = template").where("n_block >= need AND least(size - at, size(ordered) - pos) >= need - least(at, pos)")
    met = met.select("row", "width", "run", "label", "size", "need", "template_words", F.size(F.array_intersect("ordered", "template_words")).alias("common")).where("common >= need")
    slid = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("width"), F.size("run") - F.col("width")) + 1)), lambda i: F.size(F.array_intersect(F.slice("run", i, F.col("width")), F.col("template_words"))))
    met = met.select("row", "label", "size", "need", F.when(F.col("run").isNull(), F.col("common")).otherwise(F.array_max(slid)).alias("common")).where("common >= need")
    found = met.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("common") / F.col("size")).alias("best"))

    out = scanned.drop("text", "known", "possible").join(found, "row", "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", more)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
