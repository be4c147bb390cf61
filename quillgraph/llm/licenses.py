"""License scans by diagonal voting.

Every rolling two-word hash of every text is joined to the places of the same hash in the license
templates. A match votes for the diagonal place in the text - place in the template. Base phrases
must stand whole on one diagonal. Other templates may have words missing or added: neighbouring
diagonals merge, and within what they cover each span is verified word by word: its matches must
follow each other in the text as in the template, hold enough of the template, and stand in about
its length. Templates can be of any length. The template table is a constant of the caller, one
row a word, so the join broadcasts it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare
from .words import LETTER_OR_DIGIT, hash_words, rolling, slices

COVERAGE = 0.75
GAP = 2
STRETCH = 1.3


@dataclass(frozen=True)
class Template:
    """base: the words must stand exactly so. At least two words."""

    label: str
    text: str
    base: bool = False


#: Phrases and usual notices (fixed values).
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
)


def _template_rows(templates: Sequence[Template]) -> list[tuple]:
    """(gram, template, place, grams, words, base); gram 0 stands for the document itself."""
    rows = [(0, -1, 0, 1, 0, True)]
    for i, t in enumerate(templates):
        words = t.text.split(" ")
        if len(words) < 2:
            raise ValueError(f"a template has two words at least: {t.text}")
        grams = rolling(hash_words(words, LETTER_OR_DIGIT), 2).view(np.int64)
        rows += [(int(g), i, p, len(grams), len(words), t.base) for p, g in enumerate(grams)]
    return rows


def _grams(batches):
    """(doc_id, digest, n_words, grams): 0, then the hash of each two words in a row."""
    for batch in batches:
        counts, lists = [], []
        for part in slices(batch.column("text")):
            words = part.words(LETTER_OR_DIGIT)
            pairs = rolling(words.hashes(), 2).view(np.int64)
            counts += words.counts().tolist()
            for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                lists.append(np.concatenate([[0], pairs[lo : max(lo, hi - 1)]]))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        flat = np.concatenate([*lists, np.zeros(0, np.int64)])
        grams = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(counts, pa.int64()), grams], ["doc_id", "digest", "n_words", "grams"])


def in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of matches (place in text, place in template) that rises in both."""
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, place) in enumerate(pairs):
        # matches of one text place come with falling template places, so at most one of them counts
        at = bisect_left(tails, place)
        back[i] = last[at - 1] if at else -1
        if at == len(tails):
            tails.append(place)
            last.append(i)
        else:
            tails[at], last[at] = place, i
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def verified(pairs: list[tuple[int, int]], grams: int, words: int) -> list[tuple[int, int, float, bool]]:
    """Spans (first word, end word, coverage, whole) of one template among the matches of merged diagonals.

    From each match on, what stands within the allowed length is put in order; a span is whole when
    that holds enough of the template. Whole spans don't overlap. Without one, the best try is given.
    """
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    reach = int(STRETCH * words) + 1
    out, best, i, end = [], None, 0, 0
    while i < len(pairs):
        end = max(end, i)
        while end < len(pairs) and pairs[end][0] + 2 - pairs[i][0] <= reach:
            end += 1
        if best is None or min(grams, end - i) / grams > best[2]:
            run = in_order(pairs[i:end])
            found = (run[0][0], run[-1][0] + 2, len(run) / grams, len(run) >= COVERAGE * grams)
            if found[3]:
                out.append(found)
                best = None
                while i < len(pairs) and pairs[i][0] < found[1]:
                    i += 1
                continue
            best = found if best is None or found[2] > best[2] else best
        i += 1
    return out or [best]


def _verify(batches):
    kind = pa.struct([("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64()), ("whole", pa.bool_())])
    for batch in batches:
        spans = []
        columns = (batch.column(c).to_pylist() for c in ("template", "grams", "words", "base", "low", "high", "pairs"))
        for template, grams, words, base, low, high, pairs in zip(*columns, strict=True):
            found = [(low, high + 2, len(pairs) / grams, len(pairs) == grams)] if base else verified([(p["at"], p["place"]) for p in pairs], grams, words)
            spans.append([dict(zip(("template", "first_word", "end_word", "coverage", "whole"), (template, *f), strict=True)) for f in found])
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(spans, pa.list_(kind))], ["doc_id", "digest", "n_words", "template", "n", "spans"])


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """License spans: (doc_id, n_words, copies, spans), a row for each distinct (doc_id, text).

    spans: array of (template, first_word, end_word, coverage, whole); whole marks those that are
    verified. copies tells how often the row stands in docs.

    docs: doc_id and text; other columns are ignored. A null text counts as empty: no words, no
    spans. Whole texts are scanned, however long. An empty table gives an empty table.
    """
    spark = prepare(docs.sparkSession)
    table = spark.createDataFrame(_template_rows(templates), "gram bigint, template int, place int, grams int, words int, base boolean")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(_grams, "doc_id bigint, digest bigint, n_words bigint, grams array<bigint>")
    key = ["doc_id", "digest", "n_words"]
    matches = rows.select(*key, F.posexplode("grams").alias("at", "gram")).join(F.broadcast(table), "gram")
    fixed = ["template", "grams", "words", "base"]
    votes = (
        matches.groupBy(*key, *fixed, (F.col("at") - 1 - F.col("place")).alias("diagonal"))
        .agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("n"), F.collect_set("place").alias("places"))
    )
    lined = Window.partitionBy(*key, "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(lined) > F.when(F.col("base"), 0).otherwise(GAP), F.lit(True))
    islands = votes.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(lined))
    pairs = F.transform("places", lambda p: F.struct((F.col("diagonal") + p).cast("bigint").alias("at"), p.alias("place")))
    spans = islands.groupBy(*key, *fixed, "island").agg(
        F.min(F.col("diagonal") + F.col("low")).cast("bigint").alias("low"), F.max(F.col("diagonal") + F.col("high")).cast("bigint").alias("high"),
        F.sum("n").alias("n"), F.flatten(F.collect_list(pairs)).alias("pairs"),
    )
    ready = spans.select(*key, "template", "n", "grams", "words", "base", "low", "high", "pairs")
    span = "struct<template:int,first_word:bigint,end_word:bigint,coverage:double,whole:boolean>"
    checked = ready.mapInArrow(_verify, f"doc_id bigint, digest bigint, n_words bigint, template int, n bigint, spans array<{span}>")
    return checked.groupBy(*key).agg(
        F.max(F.when(F.col("template") < 0, F.col("n"))).alias("copies"), F.array_sort(F.flatten(F.collect_list(F.when(F.col("template") >= 0, F.col("spans"))))).alias("spans")
    ).drop("digest")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """scan of documents, a row a document, repeated ones too; score is the best coverage of a template. Edge cases as in scan."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = F.array(*(F.lit(t.label) for t in TEMPLATES))
    is_base = F.array(*(F.lit(t.base) for t in TEMPLATES))

    def of(spans, what):
        return F.transform(spans, lambda s: what[s["template"]])

    def joined(spans):
        return F.array_join(F.array_sort(F.array_distinct(of(spans, labels))), ",")

    whole = F.filter("spans", lambda s: s["whole"])
    base = F.filter("spans", lambda s: s["whole"] & is_base[s["template"]])
    starts = F.transform(base, lambda s: s["first_word"].cast("bigint"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(whole).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
