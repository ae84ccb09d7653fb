"""Line-dependent edits and scans folded inside the text's row (W3, S2, S7) and drift by file digests.

Each query gives the rows of its twin in ``q_lines`` or ``q_scan`` and shares its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions.text import addressed, lines_array, replace_first
from fleetspark.operators import folds
from fleetspark.operators.drift import text_drift
from fleetspark.plans import q_lines, q_scan
from fleetspark.plans.tables import table


def next_line_edit_folded(spark, d):
    """``sed '/the/!b;n;s/\\./!/'`` of whole texts, no window."""
    return folds.edit_after_match(table(spark, d, "documents"), "text", ["doc_id"], "the", lambda s: replace_first(s, ".", "!"))


def kv_scan_folded(spark, d):
    """key=value lines with sections, no window."""
    return folds.kv_rows(q_scan.query_config_texts(spark, d), "text")


def block_scan_folded(spark, d):
    """``interface:`` blocks, one row per block, no window and no pivot."""
    return folds.block_rows(q_scan.block_texts(spark, d), "text", "interface", ["role", "turn"])


def line_drift_digests(spark, d):
    """Lines only in the original or only in the rewritten copy; texts whose digests agree are never split."""
    texts = table(spark, d, "documents").select("doc_id", "text")
    edited = F.transform(lines_array(F.col("text")), lambda x: addressed(x, "@", lambda s: replace_first(s, "@", " at ")))
    junk = "(" + "|".join(q_lines.JUNK_PATTERNS) + ")"
    kept = F.filter(edited, lambda x: ~x.rlike(junk))
    copy = texts.select("doc_id", F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n"))).alias("text"))
    return text_drift(texts, copy, "text", ["doc_id"], "only_standalone", "only_embedded")


QUERIES = {
    "next_line_edit_folded": next_line_edit_folded,
    "kv_scan_folded": kv_scan_folded,
    "block_scan_folded": block_scan_folded,
    "line_drift_digests": line_drift_digests,
}

ORACLE = {
    "next_line_edit_folded": q_lines.ORACLE["next_line_edit"],
    "kv_scan_folded": q_scan.ORACLE["kv_scan"],
    "block_scan_folded": q_scan.ORACLE["block_scan"],
    "line_drift_digests": q_lines.ORACLE["line_drift"],
}
