"""Operator 9: licence scan by diagonal voting, in DataFrame functions only.

Every run of ``K`` words of a text is hashed and joined to the positions of the same
run in the licence templates (a broadcast of a fixed list; equal words are checked
in the join, so a hash never decides alone).  A hit at text position p and template
position t votes for the diagonal p - t.  Votes are counted by (document, template,
diagonal); a run that stands more than once in its template counts at each text position for the
diagonal with the most votes.  Where words were put in or left out, a notice goes on in a neighbouring
diagonal: spans whose text and template positions both go on in order, at most as many words
apart as the template has (or ``max_gap``, if more), merge into one span, so a second copy of
the notice begins a span of its own.  A span is verified: the share of the template's runs it contains must
reach ``min_share``, over at most ``max_stretch`` times the template's words (or ``max_gap`` more
than those); a text that holds most of two templates has both labels.  Words put in at one place
cost ``K`` - 1 runs, however many they are.

Base phrases are templates of their own: a diagonal with all their runs is a place
where the phrase stands, word by word.

Defined results: a null text is empty; a text without hits has empty labels and
score 0; rows of equal id and text are one document, each gets its result;
a null ``doc_id`` is an id of its own; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices as they stand in public licence texts, lower case, by label.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text in lower-case ASCII; never null."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lower, _BETWEEN), lambda w: w != "")


def templates(spark: SparkSession) -> DataFrame:
    """(tid, base, label, runs, n_template_words, tpos, w0.., hash): one row per run of a template."""
    rows = []
    for tid, (label, text, base) in enumerate([(v, k, True) for k, v in BASE.items()]
                                              + [(v, k, False) for v, k in NOTICES]):
        w = text.split(" ")
        rows += [(tid, base, label, len(w) - K + 1, len(w), i, *w[i:i + K]) for i in range(len(w) - K + 1)]
    names = ", ".join(f"w{j} string" for j in range(K))
    df = spark.createDataFrame(rows, f"tid int, base boolean, label string, runs int, n_template int, tpos int, {names}")
    return df.withColumn("run", F.xxhash64(*[f"w{j}" for j in range(K)]))


def hits(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, tid, .., pos, tpos): equal runs of texts and templates."""
    words = F.col("words")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    runs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (K - 1), F.lit(0))), lambda w, i: F.xxhash64(
        w, *[F.get(words, i + j) for j in range(1, K)]))
    # outer: else Spark infers a filter on the array's size, moves it below and computes the words anew for each run
    listed = rows.withColumn("runs_of", runs).select("doc_id", "text_hash", "words",
                                                     F.posexplode_outer("runs_of").alias("pos", "run"))
    same = [F.get("words", F.col("pos") + j) == F.col(f"w{j}") for j in range(K)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return (listed.join(F.broadcast(templates(docs.sparkSession)), "run").where(condition)
            .select("doc_id", "text_hash", "tid", "base", "label", "runs", "n_template", "pos", "tpos"))


def spans(docs: DataFrame, max_gap: int = 10, min_share: float = 0.7, max_stretch: float = 2.0) -> DataFrame:
    """Verified spans (doc_id, text_hash, base, label, first, last, share) in word positions, ``last`` included."""
    key = ["doc_id", "text_hash", "tid", "base", "label", "runs", "n_template"]
    of_text = Window.partitionBy("doc_id", "text_hash", "tid")
    voted = (hits(docs).withColumn("diagonal", F.col("pos") - F.col("tpos"))
             .withColumn("votes", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "text_hash", "tid", "diagonal")))
             .groupBy(*key, "pos").agg(F.max_by(F.struct("diagonal", "tpos"), F.struct("votes", "diagonal")).alias("best")))
    diagonals = (voted.select(*key, "pos", "best.diagonal", "best.tpos").groupBy(*key, "diagonal")
                 .agg(F.collect_set("tpos").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last_run")))
    w = of_text.orderBy("first", "diagonal")
    before = F.lag(F.struct("diagonal", "last_run")).over(w)
    gap = F.col("first") - before["last_run"]
    goes_on = (~F.col("base") & (gap > 0) & (F.col("first") - F.col("diagonal") > before["last_run"] - before["diagonal"])
               & (gap <= F.greatest("n_template", F.lit(max_gap)) + K))
    merged = (diagonals.withColumn("apart", ~F.coalesce(goes_on, F.lit(False)))
              .withColumn("span", F.sum(F.col("apart").cast("long")).over(w))
              .groupBy(*key, "span").agg(
                  F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n_seen"),
                  F.min("first").alias("first"), (F.max("last_run") + (K - 1)).alias("last")))
    share = F.col("n_seen") / F.col("runs")
    length = F.col("last") - F.col("first") + 1
    whole = F.when(F.col("base"), F.col("n_seen") == F.col("runs")).otherwise(
        (share >= min_share) & (length <= F.greatest(F.col("n_template") * max_stretch, F.col("n_template") + max_gap)))
    return merged.where(whole).select("doc_id", "text_hash", "base", "label", "first", "last", share.alias("share"))


def scan(docs: DataFrame, **params) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): word count, base places and labels, all labels and the best share."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = F.col("base")
    found = (spans(docs, **params).groupBy("doc_id", "text_hash").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"))
        .withColumnsRenamed({"doc_id": "of_doc", "text_hash": "of_text"}))
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                          F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")),
                          "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
