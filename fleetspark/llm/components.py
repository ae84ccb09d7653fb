"""Connected components of a link table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: long); root is the component's smallest node.

    Each round takes every node's grandparent, finds the smallest among its
    neighbours' grandparents, and hooks both the node and its parent there
    (pointer jumping, so the number of rounds grows with the logarithm of a
    component's diameter).  Links are never rewritten, so no node gains
    neighbours; minima are combined before the shuffle, and each round's table is
    written to the shared folder.  It ends when no parent changes.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    parents = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p")), "parents")
    while True:
        grand = written(parents.join(parents.select(F.col("v").alias("p"), F.col("p").alias("gp")), "p"), "grand")
        near = both.join(grand.select(F.col("v").alias("b"), "gp"), "b").groupBy(F.col("a").alias("v")).agg(
            F.min("gp").alias("near"))
        hooked = grand.join(near, "v")
        offers = hooked.select("v", F.least("near", "gp").alias("to"), F.col("p").alias("old")).unionByName(
            hooked.select(F.col("p").alias("v"), F.col("near").alias("to"), F.lit(None).cast("long").alias("old")))
        moved = written(offers.groupBy("v").agg(F.min("to").alias("to"), F.max("old").alias("old"))
                        .select("v", F.least("to", "old").alias("p"), "old"), "moved")
        parents = moved.select("v", "p")
        if moved.where("p <> old").isEmpty():
            return parents.select(F.col("v").alias("node"), F.col("p").alias("root"))
