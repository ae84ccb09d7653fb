"""Operator 10: mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Sources share all words by their weights; a target stops at ``max_epochs`` times its
source's size, and what it cannot take is shared again by weight among the others.
A source's target is taken in whole epochs first (every document as often), and
the rest by sampling without replacement: each document draws the exponential key
-ln(u)/quality, u from the MD5 of its id, and documents are taken in key order
until the prefix sum of their words reaches the rest (the last one if that comes
nearer).

Prefix sums are split: keys are cut into chunks by a function of the key alone,
about ``chunk_rows`` documents each; chunk sums are added up within a source, and
only the one chunk per source that holds the border is summed row by row.  So a
hot source is many chunks, and no task sorts it whole.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are taken with 0 words; rows of equal id
draw equal keys and are ordered by size, equal rows are interchangeable; a missing quality label
weighs 1; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import written

_SPACE = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, _SPACE))).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: int = 3) -> DataFrame:
    """source, weight and target of each row of ``sizes`` (source, source_size, n_docs; a row per source).

    Sources weigh 1 to ``weights``, repeating, in code point order with null last.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = sizes.withColumn("weight", F.pmod(F.row_number().over(Window.orderBy(*order)) - 1, F.lit(weights)) + 1)
    everything = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "weights", F.sum("weight").over(everything))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), *order)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    cap = max_epochs * F.col("source_size")
    left = F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0))
    left_weights = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("capped", cap * left_weights < F.col("weight") * left)
    capped = F.col("capped")
    rest = F.col("total") - F.sum(F.when(capped, cap).otherwise(0)).over(everything)
    rest_weights = F.sum(F.when(capped, 0).otherwise(F.col("weight"))).over(everything)
    share = F.when(rest_weights > 0, F.col("weight") * (rest / rest_weights)).otherwise(0.0)
    return ranked.select("source", "source_size", "n_docs", "weight",
                         F.when(capped, cap.cast("double")).otherwise(share.cast("double")).alias("target"))


def exponential_key(doc_id: Column, quality: Column) -> Column:
    """-ln(u)/quality with u in (0, 1) from the first 52 bits of the id's MD5."""
    digits = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")).substr(1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / quality


def mix(docs: DataFrame, quality: Column | None = None, max_epochs: int = 3, chunk_rows: int = 4096) -> DataFrame:
    """Adds source_size, target and taken to ``docs`` (doc_id, source, size and any more columns).

    ``quality`` is a positive weight per row (1 if not given).
    """
    names = [c for c in docs.columns if c not in ("doc_id", "source", "size")]
    more = [f"carry_{i}" for i in range(len(names))]
    keyed = written(docs.select(
        "doc_id", "source", "size", *[F.col(f"`{c}`").alias(m) for c, m in zip(names, more, strict=True)],
        exponential_key(F.col("doc_id"), F.lit(1.0) if quality is None else quality).alias("__key")), "mix")
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(sizes, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = written(targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn(
        "chunks", F.ceil(F.col("n_docs") / chunk_rows)).select(
        F.col("source").alias("__source"), "source_size", "target", "epochs", "rest", "chunks"), "targets")
    known = keyed.join(F.broadcast(targets) if targets.count() <= 10_000 else targets,
                       F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    chunk = F.least(F.floor((1 - F.exp(-F.col("__key"))) * F.col("chunks")), F.col("chunks") - 1)
    known = known.withColumn("__chunk", chunk)
    sums = known.groupBy("source", "__chunk", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("__chunk"))
    border = written(sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words")).where(
        "before <= rest").select(F.col("source").alias("__source"), F.col("__chunk").alias("__of"), "before",
                                 (F.col("upto") <= F.col("rest")).alias("whole")), "border")
    placed = known.join(border, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__chunk") == F.col("__of")),
                        "left").drop("__source", "__of")
    w = Window.partitionBy("source", "__chunk").orderBy("__key", "doc_id", "size")
    at = F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    split = F.coalesce(~F.col("whole"), F.lit(False))
    plain = placed.where(~split).withColumn("chosen", F.coalesce("whole", F.lit(False)))
    edge = placed.where(split).withColumn("chosen", at - F.col("size") / 2 <= F.col("rest"))
    taken = F.col("epochs") * F.col("size") + F.when(F.col("chosen"), F.col("size")).otherwise(0)
    times = F.col("epochs") + F.col("chosen").cast("long")
    return plain.unionByName(edge).select(
        "doc_id", "source", "size", *[F.col(m).alias(c) for c, m in zip(names, more, strict=True)], "source_size", "target",
        taken.alias("taken"), times.alias("times"))


def mix_documents(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Mix ``docs`` (doc_id, text, source) with the quality labels (1 weighs 2, 0 weighs 1/2, none 1)."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *(carry or []))
    by_doc = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__doc")).agg(
        F.max("quality").alias("quality_label"))
    marked = rows.join(by_doc, F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    weight = F.when(F.col("quality_label") == 1, 2.0).when(F.col("quality_label") == 0, 0.5).otherwise(1.0)
    return mix(marked, weight)
