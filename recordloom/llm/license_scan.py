"""License scans by diagonal voting.

Words of a text that stand in a template get that template vocabulary's numbers, and every run of K such words is one
exact k-gram. All k-grams of all documents are joined with the templates' k-grams; each match votes for the diagonal
(place in the document minus place in the template). Neighbouring diagonals merge into spans, which are verified by
how much of the template, or of one of its sentences, they cover. Base phrases are found in the same pass over words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import lower, map_steps, materialize

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a k-gram; how far apart diagonals of one span lie; share of a template or sentence that a span covers.
K, BAND, COVER = 4, 3, 0.75
#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short public license notices, by label; each sentence counts as a template of its own.
TEMPLATES = {
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower(text)) if text else []


class Templates:
    """Templates as words, their vocabulary, and the table of their k-grams."""

    def __init__(self, texts: dict[str, list[str]], k: int = K):
        self.labels, self.words = [], []
        for label, sentences in texts.items():
            for s in sentences:
                w = words_of(s)
                if len(w) >= k:
                    self.labels.append(label)
                    self.words.append(w)
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in self.words for w in t}))}
        if len(self.number) >= 1 << 16:
            raise ValueError("templates of more than 65535 different words")
        self.k = k

    def grams(self, spark: SparkSession) -> DataFrame:
        rows = [(pack(np.array([self.number[x] for x in w[i : i + self.k]]), self.k)[0].item(), t, i) for t, w in enumerate(self.words) for i in range(len(w) - self.k + 1)]
        return spark.createDataFrame(rows, "gram long, template int, place int")


def pack(numbers: np.ndarray, k: int) -> np.ndarray:
    """All k-grams of word numbers below 2**16, each exactly as one integer (k <= 4)."""
    out = np.zeros(len(numbers) - k + 1, np.int64)
    for j in range(k):
        out = (out << 16) | numbers[j : len(numbers) - k + 1 + j].astype(np.int64)
    return out


def scan(docs: DataFrame, texts: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels (array), labels (array), spans, score.

    n_base counts all places of the fixed phrases, first_word and last_word are the smallest and largest start (null
    without any). labels adds those of verified spans (label, start and end in words, cover). score is 1 with a base
    place, else the largest cover of any verified span, else 0. Null and empty texts have no words. Null or repeated
    ids are kept as rows of their own. An empty table gives no rows; further columns are not looked at.
    """
    spark = docs.sparkSession
    templates = Templates(texts or TEMPLATES)
    phrases = [(p.split(), label) for p, label in PHRASES.items()]
    by_first = {}
    for w, label in phrases:
        by_first.setdefault(w[0], []).append((w, label))
    k, number = templates.k, templates.number
    quick = re.compile("|".join(re.escape(w) for w in by_first))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [[] for _ in range(7)]
        for text in batch.column("text").to_pylist():
            low = lower(text) if text else ""
            words = WORD.findall(low)
            starts, labels = [], set()
            for first, own in by_first.items() if quick.search(low) else ():
                at = -1
                for _ in range(words.count(first)):
                    at = words.index(first, at + 1)
                    for w, label in own:
                        if words[at : at + len(w)] == w:
                            starts.append(at)
                            labels.add(label)
            ids = np.fromiter(map(number.get, words, (0,) * len(words)), np.int32, len(words)) if len(words) >= k else np.zeros(0, np.int32)
            grams, places = [], []
            if len(ids):
                known = np.concatenate([[0], np.cumsum(ids > 0)])
                places = np.flatnonzero(known[k:] - known[:-k] == k)
                grams = pack(ids, k)[places]
            for c, v in zip(cols, (len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), grams, places), strict=True):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "grams", "places"])

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = map_steps(d, kernel, "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, grams array<long>, places array<int>")
    seen = materialize(seen, "license-words")
    # The templates' k-grams are a fixed, small table.
    hits = seen.where(F.size("grams") > 0).select("row", F.explode(F.arrays_zip("grams", "places")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.places").alias("at")).join(F.broadcast(templates.grams(spark)), "gram")
    votes = hits.groupBy("row", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set("place").alias("covered"))
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    # Diagonals further apart than BAND belong to different spans.
    merged = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > BAND).cast("int"), F.lit(1))).withColumn("band", F.sum("new").over(w))
    spans = merged.groupBy("row", "template", "band").agg(F.min("lo").alias("start"), (F.max("hi") + k).alias("end"), F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"))
    # Verified: the share of the template's words that lie in a matched k-gram.
    info = spark.createDataFrame([(t, x, len(w)) for t, (x, w) in enumerate(zip(templates.labels, templates.words, strict=True))], "template int, label string, words int")
    covered = F.size(F.array_distinct(F.flatten(F.transform("covered", lambda p: F.sequence(p, p + (k - 1))))))
    spans = spans.join(F.broadcast(info), "template").withColumn("cover", covered / F.col("words")).where(F.col("cover") >= COVER)
    found = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "cover"))).alias("spans"), F.max("cover").alias("cover"))
    out = seen.drop("grams", "places").join(found, "row", "left")
    labels = F.sort_array(F.array_distinct(F.concat("base_labels", F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("cover", F.lit(0.0))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string,cover:double>>")).alias("spans"), score.alias("score"))


def digest(scanned: DataFrame) -> DataFrame:
    """scan()'s rows with labels as text."""
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
