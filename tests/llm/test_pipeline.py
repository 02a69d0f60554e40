"""The pipeline's stages one by one and as a whole, and the registered queries' contract."""

import duckdb
from compare import connect, differences
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumns(
        {c: F.lit("x") for c in ("row", "_rejected", "_again", "_base", "_runs", "_more", "_spans", "_source", "_copies", "_copy", "_id", "_hash", "a.b", "c0")})
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.where("doc_id in (7, 8)"))
    docs = docs.unionByName(odd)
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert {r[c] for r in kept[name] for c in docs.columns[-14:]} == {"x"}
    assert all(r.text for r in kept["language"]) and len(kept["language"]) >= 195
    ids = [r.doc_id for r in kept["near_dedup"]]
    assert len(ids) == len(set(ids)) and {7, 8} & set(ids) and 150 < len(ids) < 200
    assert [r.doc_id for r in kept["secrets"]] and len(kept["secrets"]) == len(ids)
    assert not any("AKIA" in r.text and len(r.text.split("AKIA")[1].split()[0]) > 16 for r in kept["secrets"])
    assert kept["packing"]


def test_empty_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_mixing_oracle(spark):
    from cadencekit.llm.queries import ORACLE_SQL, QUERIES

    assert differences(QUERIES["op5_mixing"](spark, SF_DIR), connect(SF_DIR), ORACLE_SQL["op5_mixing"]) == []
    assert duckdb and set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) == 13
