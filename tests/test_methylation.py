"""The methylation analysis from sites to the test of one region."""

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"


def test_region_anova_sees_every_sample(spark):
    rows = {r["term"]: r for r in entry_point.queries()["methylation_region_anova"](spark, FOLDER).collect()}
    samples = spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    assert list(rows) == ["Diagnosis", "Sex", "AGE", "Residuals"]
    assert [rows[t]["df"] for t in rows] == [1, 1, 1, samples - 4]
    for term in ("Diagnosis", "Sex", "AGE"):
        want = rows[term]["meansq"] / rows["Residuals"]["meansq"]
        assert abs(rows[term]["statistic"] - want) < 1e-9 and 0 < rows[term]["p_value"] <= 1
