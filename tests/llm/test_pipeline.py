"""The pipeline's stages against brute-force versions."""

import brute
import corpus_pipeline as p
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in p.STAGES]
    assert len(names) == 5
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in p.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        after = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        elif name == "near_duplicates":
            assert set(after) == {d for d, x in brute.near(list(before.items()), 5).items() if x[2]}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in brute.contamination(list(before.items()), items) if not r[5]}
        elif name == "secret_scan":
            assert set(after) == set(before)
            assert all(sum(brute.secrets(r.text)[:3]) == 0 for r in after.values())
            assert all(after[d].text == t for d, t in before.items() if sum(brute.secrets(t)[:3]) == 0 and "[secret]" not in after[d].text)
        else:
            assert set(after) == set(before) and all(r.exact for r in after.values())
        if name != "bpe":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out


def test_run(spark):
    out = p.run(spark, SF)
    assert out.filter(~F.col("exact")).count() == 0 and out.count() > 100
