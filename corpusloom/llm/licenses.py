"""License scans by diagonal voting, with DataFrame functions only.

All rolling k-gram hashes of a document's words are joined to the positions of the same k-grams in
reference notices. A match votes for its diagonal (document position minus template position); votes are
one bit per template position, so repeated input rows change nothing. Neighbouring diagonals of a long
template merge, so a few inserted or lost words do not split a notice. A span holds if the covered
share of its template is large enough; a short base phrase must be complete on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, spread, text_key, words

# Phrases that count as a mention, and the opening words of widely used public notices.
BASE_PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
NOTICES = (
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsl", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
SHORT_GRAM, LONG_GRAM = 2, 4
#: Words that a span may shift by, and the covered share of a notice that holds.
MAX_SHIFT, MIN_COVER = 3, 0.6


def _grams(text: str, k: int) -> list[list[str]]:
    w = text.split(" ")
    if not k <= len(w) < k + 62:
        raise ValueError(f"a template has {k} to {k + 61} words")
    return [w[i : i + k] for i in range(len(w) - k + 1)]


def template_positions(spark: SparkSession, base=BASE_PHRASES, notices=NOTICES) -> DataFrame:
    """(hash, gram, tid, label, is_base, tpos, n_grams): a row for each k-gram of each template; as many as the templates' words."""
    rows = []
    for tid, (label, text, k) in enumerate([(a, b, SHORT_GRAM) for a, b in base] + [(a, b, LONG_GRAM) for a, b in notices]):
        grams = _grams(text, k)
        rows += [(g, tid, label, k == SHORT_GRAM, i, len(grams)) for i, g in enumerate(grams)]
    made = spark.createDataFrame(rows, "g array<string>, tid int, label string, is_base boolean, tpos int, n_grams int")
    g = F.col("g")
    return made.select(F.when(F.size(g) == SHORT_GRAM, F.xxhash64(g[0], g[1])).otherwise(F.xxhash64(g[0], g[1], F.get(g, F.lit(2)), F.get(g, F.lit(3)))).alias("hash"), g.alias("gram"), "tid", "label", "is_base", "tpos", "n_grams")


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE_PHRASES, notices=NOTICES) -> DataFrame:
    """(doc_id, tkey, part, n_words, copies, spans): spans is an array of (label, is_base, first_word, last_word, cover).

    One row per distinct (id, text) of each split of the input; copies counts its rows. Null text has no words. Equal rows are
    counted within a split before anything is shuffled, and those of different splits are never brought together.
    """
    templates = template_positions(docs.sparkSession, base, notices)
    known = [r[0] for r in templates.select("hash").distinct().collect()]  # as many as the templates' k-grams
    w = F.col("w")

    def at(i, step):
        return F.get(w, i + step)

    # Two hashes per position; those of no template are dropped before the words of a place are taken along.
    hashed = F.transform(w, lambda x, i: F.struct(i.alias("p"), F.array(F.xxhash64(x, at(i, 1)), F.xxhash64(x, at(i, 1), at(i, 2), at(i, 3))).alias("h")))
    kept = F.filter(hashed, lambda x: x["h"][0].isin(known) | x["h"][1].isin(known))
    kept = F.transform(kept, lambda x: F.struct(x["p"].alias("p"), x["h"].alias("h"), F.slice(w, x["p"] + 1, LONG_GRAM).alias("words")))
    start = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), words(F.col(text_col)).alias("w"), F.spark_partition_id().alias("part"))
    once = start.select("doc_id", "tkey", "part", F.size(w).cast("long").alias("n_words"), kept.alias("kept")).groupBy("doc_id", "tkey", "part").agg(F.first("n_words").alias("n_words"), F.first("kept").alias("kept"), F.count("*").alias("copies"))
    mark = F.array(F.struct(F.lit(-1).alias("p"), F.array(F.lit(0).cast("long")).alias("h"), F.array().cast("array<string>").alias("words")))  # the document itself
    doc = ["doc_id", "tkey", "part", "n_words", "copies"]
    rows = once.select(*doc, F.explode(F.concat(mark, "kept")).alias("x")).select(*doc, "x.p", "x.words", F.explode("x.h").alias("hash"))
    doc_rows = F.col("p") == -1
    met = rows.join(F.broadcast(templates), "hash", "left").where(doc_rows | (F.slice("words", F.lit(1), F.size("gram")) == F.col("gram")))
    met = met.select(*doc, F.when(~doc_rows, F.col("tid")).alias("tid"), "label", "is_base", "n_grams", "tpos", F.when(~doc_rows, F.col("p") - F.col("tpos")).alias("diag"))
    votes = met.groupBy(*doc, "tid", "diag").agg(F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("mask"), F.max("label").alias("label"), F.max("is_base").alias("is_base"), F.max("n_grams").alias("n_grams"))
    by = Window.partitionBy(*doc, "tid").orderBy("diag")
    new = F.col("is_base") | F.coalesce(F.col("diag") - F.lag("diag").over(by) > MAX_SHIFT, F.lit(True))
    lines = votes.withColumn("new", F.when(F.col("tid").isNotNull(), new.cast("int")))
    lines = lines.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = lines.groupBy(*doc, "tid", "island").agg(F.max("label").alias("label"), F.max("is_base").alias("is_base"), F.min("diag").alias("diag"), F.max("diag").alias("last_diag"), F.bit_or("mask").alias("mask"), F.max("n_grams").alias("n_grams"))
    cover = F.bit_count("mask") / F.col("n_grams")
    holds = F.when(F.col("is_base"), cover == 1).otherwise(cover >= MIN_COVER)
    lowest = F.bit_count(F.bitwise_not(F.col("mask")).bitwiseAND(F.col("mask") - 1))  # trailing zeros
    highest = F.lit(63) - (F.lit(64) - F.length(F.bin("mask")))
    gram = F.when(F.col("is_base"), SHORT_GRAM).otherwise(LONG_GRAM)
    span = F.struct("label", "is_base", (F.col("diag") + lowest).cast("long").alias("first_word"), (F.col("last_diag") + highest + gram - 1).cast("long").alias("last_word"), cover.alias("cover"))
    return spans.groupBy(*doc).agg(F.sort_array(F.collect_list(F.when(F.col("tid").isNotNull() & holds, span))).alias("spans"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place of a base phrase; first_word and last_word are the smallest and largest start
    (null without one). score: the largest covered share of a template among the spans that hold, 0 without
    one. Null and empty texts have no words and no labels. Repeated rows each come back. Texts are read
    whole, of any length. An empty table gives no rows; other columns play no part.
    """
    found = license_spans(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["is_base"])
    starts = F.transform(base, lambda s: s["first_word"])
    names = lambda spans: F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(spread(read_table(spark, sf_dir, "documents")))


_TEMPLATES = ", ".join(f"({i}, '{label}', {base}, {k}, '{words_}')" for i, (label, words_, base, k) in enumerate([(a, b, "true", SHORT_GRAM) for a, b in BASE_PHRASES] + [(a, b, "false", LONG_GRAM) for a, b in NOTICES]))
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t(tid, label, base, k, words) AS (VALUES {_TEMPLATES}),
tg AS (SELECT tid, label, base, k, len(tw) - k + 1 AS n, p AS tpos, array_to_string(tw[p + 1:p + k], ' ') AS g FROM (SELECT *, unnest(range(0, len(tw) - k + 1)) AS p FROM (SELECT *, string_split(words, ' ') AS tw FROM t))),
dg AS (SELECT rid, k, p, array_to_string(w[p + 1:p + k], ' ') AS g FROM (SELECT rid, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (VALUES ({SHORT_GRAM}), ({LONG_GRAM})) s(k) WHERE len(w) >= k)),
votes AS (SELECT DISTINCT rid, tid, label, base, n, tpos, p - tpos AS diag FROM dg JOIN tg USING (k, g)),
lines AS (SELECT rid, tid, diag, sum(new) OVER (PARTITION BY rid, tid ORDER BY diag) AS island FROM (SELECT rid, tid, diag, CASE WHEN base OR coalesce(diag - lag(diag) OVER (PARTITION BY rid, tid ORDER BY diag) > {MAX_SHIFT}, true) THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT rid, tid, base, diag FROM votes))),
spans AS (SELECT rid, tid, island, label, base, min(diag) AS start, count(DISTINCT tpos) / n AS cover FROM votes JOIN lines USING (rid, tid, diag) GROUP BY rid, tid, island, label, base, n),
good AS (SELECT * FROM spans WHERE CASE WHEN base THEN cover = 1 ELSE cover >= {MIN_COVER} END),
per AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM good GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN per USING (rid)"""
