"""What lies beside a known form in the same run of symbols."""

from pyspark.sql import functions as F

from cadencekit.llm import secret_scan

SF_DIR = "/root/testdata/sf0.001"


def test_parts_beside_known_forms(spark):
    secret = "9sKd83jFk2LqPz7XvB1mNt5Rw8QyZ4hTg6UcJ0aE"
    texts = ["x AKIA" + "ABCDEFGHIJKLMNOP/" + secret + " y", "z " + "0f" * 13 + "-" + secret + " y", secret + "-" + "0f" * 13 + "=" + secret + ".",
             "0f" * 13 + "-short", "0f" * 13 + "-donaudampfschifffahrtsgesellschaft", secret]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = secret_scan.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    got = {r.doc_id: r for r in secret_scan.scan(df, model).withColumn("clean", secret_scan.redacted(F.col("text"), F.col("_spans"))).collect()}
    assert not any(secret[8:] in r.clean for r in got.values())
    assert [len([s for s in got[i]["_spans"] if s["kind"] == 3]) for i in range(6)] == [1, 1, 2, 0, 0, 1]
    assert got[3].clean == "[secret]-short" and got[4].clean.endswith("-donaudampfschifffahrtsgesellschaft")
