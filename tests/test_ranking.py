"""Skew-safe ranking equals the plain window, with one group holding a third of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetspark.operators.graph import ordered_list, ordered_list_pages
from fleetspark.operators.ranking import distributed_row_number, distributed_running_sum, ordered_list_chunks

w_first = Window.unboundedPreceding


def skewed(spark, n=3000):
    # group "hot" has a third of all rows; the rest spread over 200 groups
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 200).cast("string")))
        .alias("g"), ((F.col("id") * 7919) % 1000).alias("o"), F.col("id").alias("k"))


def test_distributed_row_number_equals_window(spark):
    df = skewed(spark)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o", "k")))
    got = distributed_row_number(df, ["g"], ["o", "k"], n_partitions=8)
    assert sorted(map(tuple, got.select("g", "k", "rn").collect())) == sorted(map(tuple, want.select("g", "k", "rn").collect()))
    # the hot group really is spread over several partitions
    parts = (df.repartitionByRange(8, "g", "o", "k").where("g = 'hot'")
             .select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts > 1


def test_ordered_list_chunks_join_to_the_whole_list(spark):
    df = skewed(spark).withColumn("v", F.concat(F.lit("m"), F.col("k").cast("string")))
    whole = {r["g"]: r["members"] for r in ordered_list(df, ["g"], F.col("v"), F.col("k")).collect()}
    chunks = ordered_list_chunks(df, ["g"], F.col("v"), ["k"], n_partitions=8).collect()
    joined = {}
    for r in sorted(chunks, key=lambda r: (r["g"], r["chunk"])):
        joined[r["g"]] = r["members"] if r["g"] not in joined else joined[r["g"]] + "," + r["members"]
    assert joined == whole
    assert max(r["chunk"] for r in chunks if r["g"] == "hot") >= 1


def test_extra_columns_and_null_groups_keep_every_row(spark):
    df = skewed(spark, 30000).select(F.when(F.col("g") != "g7", F.col("g")).alias("g"), "o", "k",
                                     F.sha2(F.col("k").cast("string"), 256).alias("payload"))
    w = Window.partitionBy("g").orderBy("o", "k")
    want = df.select("k", F.row_number().over(w).alias("rn"), F.sum("k").over(w.rowsBetween(w_first, 0)).alias("s"))
    want = {r["k"]: (r["rn"], r["s"]) for r in want.collect()}
    got = distributed_row_number(df, ["g"], ["o", "k"], n_partitions=8)
    assert got.select("k", "rn").count() == 30000
    for _ in range(2):  # one evaluation with all columns, one pruned
        assert {r["k"]: r["rn"] for r in got.collect()} == {k: v[0] for k, v in want.items()}
    sums = distributed_running_sum(df, ["g"], ["o", "k"], "k", n_partitions=8)
    assert {r["k"]: r["running"] for r in sums.collect()} == {k: v[1] for k, v in want.items()}


def test_pages_of_a_list_join_to_the_whole_list(spark):
    df = spark.createDataFrame([("a", i, f"v{i:03d}") for i in range(25)] + [(None, 1, "x"), ("b", 1, "y"), ("b", 2, None)],
                               "g string, k int, v string")
    pages = sorted(((r["g"], r["page"], r["members"]) for r in ordered_list_pages(
        df, ["g"], F.col("v"), [F.col("k")], 10).collect()), key=repr)
    assert [p for g, p, _ in pages if g == "a"] == [0, 1, 2]
    assert ",".join(m for g, _, m in pages if g == "a") == ",".join(f"v{i:03d}" for i in range(25))
    assert (None, 0, "x") in pages and ("b", 0, "y") in pages
