"""License texts in documents: word k-grams joined to template positions, votes by diagonal, spans verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_BASE, mixed, runs, slices, span_hashes, tidy, word_hashes

#: Words of a gram, how far apart diagonals may lie to be merged, and the share of a template and of its span that must match.
GRAM, DRIFT, LEAST_TEMPLATE, LEAST_SPAN = 4, 3, 0.5, 0.5

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license notices, by label; the method finds them and changed copies of them (fixed values).
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "rights-reserved": "all rights reserved no part of this publication may be reproduced",
}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(text: str) -> list[str]:
    """The words of one text, as the scans see them."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = runs(WORD_BYTE[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    at = np.arange(max(0, len(h) - k + 1))
    return mixed(span_hashes(h, at, at + k, WORD_BASE)).view(np.int64)


def hashed(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return word_hashes(data, starts, ends)


def template_grams(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """(gram, template, at, size): every k-gram position of every template."""
    rows = [(int(g), name, i, len(text.split()) - k + 1) for name, text in templates.items() for i, g in enumerate(grams(hashed(text.split()), k))]
    return spark.createDataFrame(rows, "gram long, template string, at int, size int")


def rolling(rows: DataFrame, k: int) -> DataFrame:
    """(id, h, pos, gram): the hash of every k consecutive words of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text", 1 << 20):
                data = LOWER[data]
                starts, ends, doc = runs(WORD_BYTE[data], offsets)
                if len(starts) < k:
                    continue
                g = grams(word_hashes(data, starts, ends), k)
                inside = np.flatnonzero(doc[: len(g)] == doc[k - 1 :])
                first = np.searchsorted(doc, np.arange(part.num_rows))
                own = doc[inside]
                where = pa.array(own)
                yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), pa.array((inside - first[own]).astype(np.int32)), pa.array(g[inside])], ["id", "h", "pos", "gram"])

    return rows.select("id", "h", "text").mapInArrow(tidy(run), "id long, h long, pos int, gram long")


def spans(rows: DataFrame, templates: dict[str, str] | None = None, k: int = GRAM) -> DataFrame:
    """(id, h, template, first, last, coverage): verified places of templates in texts (id, h, text), words from 0, last one excluded.

    Grams vote for the diagonal pos - at. Diagonals at most DRIFT apart, which an inserted or missing word makes, are merged. A
    merged span holds if its grams cover LEAST_TEMPLATE of the template's and LEAST_SPAN of the span's.
    """
    known = template_grams(rows.sparkSession, templates or TEMPLATES, k)
    hits = rolling(rows, k).join(F.broadcast(known), "gram").select("id", "h", "template", "size", "pos", "at").distinct()
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy("id", "h", "template", "size", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("votes"))
    order = Window.partitionBy("id", "h", "template").orderBy("diagonal")
    marked = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"), F.lit(1)))
    merged = marked.withColumn("span", F.sum("new").over(order)).groupBy("id", "h", "template", "size", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"), F.min("first").alias("first"), (F.max("last") + k).alias("last"), F.sum("votes").alias("votes"))
    share, dense = F.col("covered") / F.col("size"), F.col("votes") / (F.col("last") - F.col("first") - k + 1)
    return merged.where((share >= LEAST_TEMPLATE) & (dense >= LEAST_SPAN)).select("id", "h", "template", "first", "last", share.alias("coverage"))


def phrases(rows: DataFrame, wanted: dict[str, str] | None = None) -> DataFrame:
    """(id, h, n_words, n_base, first_word, last_word, base): one row per text; base: labels of the phrases that stand in it."""
    wanted = wanted or PHRASES
    split = {p: p.encode().split() for p in wanted}
    tails = {words[-1] for words in split.values()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_tail = {t: int(word_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in tails}
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                data = LOWER[data]
                raw = data.tobytes()
                starts, ends, doc = runs(WORD_BYTE[data], offsets)
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                found: list[list[tuple[int, str]]] = [[] for _ in range(part.num_rows)]
                h = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
                for phrase, words in split.items():
                    n = len(words)
                    for i in np.flatnonzero(h == np.uint64(by_tail[words[-1]])).tolist():
                        d = int(doc[i])
                        if i - n + 1 >= first[d] and [raw[starts[j] : ends[j]] for j in range(i - n + 1, i + 1)] == words:
                            found[d].append((i - n + 1 - int(first[d]), wanted[phrase]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(first[1:] - first[:-1], pa.int64()),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([min(f)[0] if f else None for f in found], pa.int64()),
                        pa.array([max(f)[0] if f else None for f in found], pa.int64()),
                        pa.array([sorted({x for _, x in f}) for f in found], pa.list_(pa.string())),
                    ],
                    ["id", "h", "n_words", "n_base", "first_word", "last_word", "base"],
                )

    return rows.select("id", "h", "text").mapInArrow(tidy(run), "id long, h long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    labels are those of phrases and of verified templates; score is 1 where a phrase stands, else the greatest share of a
    template that a verified span covers, else 0. Null texts count as empty: no words, no labels. Rows with one doc_id
    and text share their spans and each come out; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(body).alias("h"), body.alias("text"))
    found = spans(rows).groupBy(F.col("id").alias("sid"), F.col("h").alias("sh")).agg(F.collect_set("template").alias("method"), F.max("coverage").alias("coverage"))
    base = phrases(rows)
    both = base.join(found, base.id.eqNullSafe(found.sid) & (base.h == found.sh), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("method", F.array().cast("array<string>"))))
    return both.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"))
