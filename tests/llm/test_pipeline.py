"""The pipeline's stages, each against its own input, and on awkward rows."""

import corpus_pipeline as pipeline
import pytest

from fleetspark.llm import mixing, outliers, simhash, suffix
from fleetspark.llm.common import written
from tests.llm.test_operators import AWKWARD, removal_by_hand

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size long"


def rows_of(df):
    return sorted((tuple(r[c] for c in pipeline.COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("which", ["documents", "awkward", "empty"])
def test_each_stage_on_its_input(spark, which):
    odd = spark.createDataFrame([(*r, len(r[1] or ""), 7, 7) for r in AWKWARD], SCHEMA)
    docs = {"documents": spark.read.parquet(f"{SF}/documents.parquet"), "awkward": odd, "empty": odd.limit(0)}[which]
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "mixing sources to target weights",
                           "best-fit packing"]
    a = written(steps["quality rules"](spark, docs, SF), "a")
    kept = [r["doc_id"] for r in outliers.quality(docs).where("kept").collect()]
    assert sorted([r[0] for r in rows_of(a)], key=str) == sorted(kept, key=str)
    assert set(rows_of(a)) <= set(rows_of(docs))
    b = written(steps["SimHash near-dedup"](spark, a, SF), "b")
    classes = {r["component_id"] for r in simhash.near_duplicates(a).where("component_id IS NOT NULL").collect()}
    assert {r["doc_id"] for r in b.where("doc_id IS NOT NULL").collect()} == classes
    assert len(rows_of(b)) == len(set(rows_of(b)))
    c = written(steps["suffix-array dedup"](spark, b, SF), "c")
    want = removal_by_hand([(r["doc_id"], r["text"]) for r in b.collect()])
    assert {r["doc_id"]: r["n_removed"] for r in suffix.deduplicated(b).collect()} == {d: v[1] for d, v in want.items()}
    assert {r["doc_id"] for r in c.collect()} == set(want) and all(r["n_chars"] == len(r["text"]) for r in c.collect())
    d = written(steps["mixing sources to target weights"](spark, c, SF), "d")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    times = {r["doc_id"]: r["times"] for r in mixing.mix_documents(c, labels).collect()}
    assert sorted((r["doc_id"] for r in d.collect()), key=str) == sorted((i for i, n in times.items() for _ in range(n)), key=str)
    assert d.columns == pipeline.COLUMNS
    e = steps["best-fit packing"](spark, d, SF)
    assert e.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0 and pipeline.ORACLE_SQL is None
