"""The three analyses on stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.strings import strip_suffix
from cohortloom.plans import expression, methylation, reconcile
from cohortloom.queries.registry import Tables, embedding_matrix, query, r

_RECORDS_SQL = """
samples AS (SELECT o_orderkey AS Slide, CAST(o_custkey AS VARCHAR) AS PIDN, CAST(left(o_orderpriority, 1) AS INTEGER) AS Batch
            FROM orders WHERE o_orderstatus <> 'F'),
draws AS (SELECT CAST(o_custkey AS VARCHAR) AS PIDN, floor(o_totalprice / 20000) AS age FROM orders WHERE o_orderstatus = 'F'),
bad AS (SELECT DISTINCT PIDN FROM draws WHERE age < 1 OR age > 150),
ages AS (SELECT DISTINCT PIDN, age FROM draws WHERE PIDN NOT IN (SELECT PIDN FROM bad)),
placed AS (SELECT *, row_number() OVER (PARTITION BY PIDN ORDER BY Batch, Slide) AS k, count(*) OVER (PARTITION BY PIDN) AS n_samples FROM samples),
ranked AS (SELECT *, row_number() OVER (PARTITION BY PIDN ORDER BY age) AS k FROM ages),
n_ages AS (SELECT PIDN, count(*) AS n_ages, max(age) AS only_age FROM ages GROUP BY 1),
diag AS (SELECT CAST(doc_id AS VARCHAR) AS PIDN, 'Q' || quality AS dx FROM labels
         UNION ALL SELECT CAST(doc_id AS VARCHAR), lang FROM documents),
dx AS (SELECT PIDN, count(*) AS n, max(dx) AS dx FROM diag GROUP BY 1),
records AS (
  SELECT p.Slide, p.PIDN, p.Batch,
    CASE WHEN p.PIDN NOT IN (SELECT PIDN FROM draws) THEN 'no_draw' WHEN p.PIDN IN (SELECT PIDN FROM bad) THEN 'invalid'
         WHEN n_ages = 1 THEN 'one' WHEN n_ages = n_samples THEN 'matched' ELSE 'unmatched' END AS age_status,
    CASE WHEN n_ages = 1 THEN only_age WHEN n_ages = n_samples THEN r.age END AS AgeAtDraw,
    CASE WHEN dx.n IS NULL THEN 'Unknown' WHEN dx.n = 1 THEN dx.dx WHEN p.PIDN IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en') THEN 'Control' END AS Diagnosis,
    coalesce(c.c_mktsegment, 'UNKNOWN') AS Gender
  FROM placed p LEFT JOIN n_ages a USING (PIDN) LEFT JOIN ranked r ON r.PIDN = p.PIDN AND r.k = p.k LEFT JOIN dx ON dx.PIDN = p.PIDN
  LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = p.PIDN AND c.c_acctbal >= 0)
"""


def _records(t: Tables):
    """All orders as samples (open ones) or draws (filled ones); every document has a diagnosis by language and the labelled
    ones another, which English ones resolve; customers in debt have no record of sex."""
    o = t.orders
    person = F.col("o_custkey").cast("string").alias("PIDN")
    samples = o.where("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("Slide"), person, F.left("o_orderpriority", F.lit(1)).cast("int").alias("Batch"))
    draws = o.where("o_orderstatus = 'F'").select(
        person, F.floor(F.col("o_totalprice") / 20000).cast("double").alias("AgeAtDraw"))
    diagnosis = t.labels.select(F.col("doc_id").cast("string").alias("PIDN"), F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("Diagnosis")
                                ).unionByName(t.documents.select(
                                    F.col("doc_id").cast("string").alias("PIDN"), F.col("lang").alias("Diagnosis")))
    overrides = t.documents.where("lang = 'en'").select(F.col("doc_id").cast("string").alias("PIDN"), F.lit("Control").alias("Diagnosis"))
    patients = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("PIDN"), F.col("c_mktsegment").alias("Gender"))
    return reconcile.sample_records(samples, draws, diagnosis, overrides, patients)


@query(f"WITH {_RECORDS_SQL} SELECT * FROM records")
def sample_records(t: Tables):
    return _records(t)


@query(f"""
WITH {_RECORDS_SQL}, person AS (
  SELECT PIDN, arg_min(Diagnosis, (Batch, Slide)) AS Diagnosis, arg_min(Gender, (Batch, Slide)) AS Gender,
         CASE WHEN count(*) = count(AgeAtDraw) THEN max(AgeAtDraw) END AS age FROM (SELECT * REPLACE (coalesce(Diagnosis, '~') AS Diagnosis) FROM records) GROUP BY 1)
SELECT Diagnosis, count(*) FILTER (WHERE Gender = 'BUILDING') AS "BUILDING", count(*) FILTER (WHERE Gender = 'UNKNOWN') AS "UNKNOWN",
  count(*) FILTER (WHERE Gender IN ('BUILDING', 'UNKNOWN')) AS "Total", round(avg(age), 6) AS mean_value, count(*) FILTER (WHERE age IS NULL) AS n_unknown
FROM person WHERE Diagnosis <> '~' GROUP BY 1 HAVING count(age) > 0
""")
def diagnosis_report(t: Tables):
    out = reconcile.diagnosis_report(_records(t), ["BUILDING", "UNKNOWN"])
    return out.withColumn("mean_value", r("mean_value"))


@query(f"""
WITH {_RECORDS_SQL}
SELECT r.* REPLACE (CASE WHEN age_status = 'unmatched' THEN floor(o_totalprice / 10000) ELSE AgeAtDraw END AS AgeAtDraw,
                    CASE WHEN age_status = 'unmatched' THEN 'override' ELSE age_status END AS age_status)
FROM records r JOIN orders ON o_orderkey = Slide
""")
def age_overrides(t: Tables):
    given = t.orders.select(F.col("o_orderkey").alias("Slide"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("AgeAtDraw"))
    return reconcile.override_ages(_records(t), given)


_PEOPLE_SQL = _RECORDS_SQL + """, person AS (
  SELECT PIDN, arg_min(Diagnosis, (Batch, Slide)) AS Diagnosis, arg_min(Gender, (Batch, Slide)) AS Gender,
         CASE WHEN count(*) = count(AgeAtDraw) THEN max(AgeAtDraw) END AS age FROM (SELECT * REPLACE (coalesce(Diagnosis, '~') AS Diagnosis) FROM records) GROUP BY 1)"""


@query(f"""
WITH {_PEOPLE_SQL}
SELECT Diagnosis, count(*) FILTER (WHERE Gender = 'BUILDING') AS "BUILDING", count(*) FILTER (WHERE Gender = 'UNKNOWN') AS "UNKNOWN",
  count(*) FILTER (WHERE Gender IN ('BUILDING', 'UNKNOWN')) AS "Total", round(avg(age), 6) AS mean_value, count(*) FILTER (WHERE age IS NULL) AS n_unknown
FROM person WHERE Diagnosis <> '~' AND PIDN IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1) GROUP BY 1 HAVING count(age) > 0
""")
def positive_report(t: Tables):
    mutations = t.labels.select(F.col("doc_id").cast("string").alias("PIDN"), F.when(F.col("toxic") == 1, "Positive").otherwise("Negative").alias("Mutation"))
    out = reconcile.positive_report(_records(t), mutations, ["BUILDING", "UNKNOWN"])
    return out.withColumn("mean_value", r("mean_value"))


def _model_sql(y: str) -> str:
    return f"""
WITH {_PEOPLE_SQL}, place AS (SELECT Gender, row_number() OVER (ORDER BY Gender) AS code FROM (
    SELECT DISTINCT Gender FROM person WHERE age IS NOT NULL AND regexp_matches(Diagnosis, 'en|fr|de|Control'))),
p AS (SELECT upper(Diagnosis) AS g, CAST({y} AS DOUBLE) AS y FROM person JOIN place USING (Gender)
      WHERE age IS NOT NULL AND regexp_matches(Diagnosis, 'en|fr|de|Control')),
g AS (SELECT g, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM p GROUP BY 1), a AS (SELECT sum(n * m) / sum(n) AS grand FROM g),
s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * (m - grand) ** 2) AS ssb, sum(n * v) AS ssw FROM g, a)
SELECT 'Diagnosis' AS term, CAST(k - 1 AS BIGINT) AS df, round(ssb, 4) AS sumsq, round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS statistic FROM s
UNION ALL SELECT 'Residuals', CAST(n - k AS BIGINT), round(ssw, 4), NULL FROM s"""


def _model(t: Tables, response: str):
    table, _ = reconcile.diagnosis_models(_records(t), "en|fr|de|Control", response)
    return table.select("term", "df", r("sumsq", 4).alias("sumsq"), r("statistic", 4).alias("statistic"))


@query(_model_sql("age"))
def diagnosis_age_model(t: Tables):
    return _model(t, "age")


@query(_model_sql("code"))
def diagnosis_sex_model(t: Tables):
    return _model(t, "Gender")


@query("""
SELECT o_custkey AS PIDN, o_orderkey AS Sample, source AS Center, lang AS Gene, n_chars AS Result, CAST(quality AS VARCHAR) AS Categorized_Diagnosis
FROM orders LEFT JOIN (SELECT * FROM documents WHERE source = 'src1' AND lang = 'en') d ON d.doc_id = o_custkey LEFT JOIN labels l ON l.doc_id = o_custkey
""")
def with_sequencing(t: Tables):
    genes = t.orders.select(F.col("o_custkey").alias("PIDN"), F.col("o_orderkey").alias("Sample"))
    found = t.documents.select(F.col("doc_id").alias("PIDN"), F.col("source").alias("Center"), F.col("lang").alias("Gene"), F.col("n_chars").alias("Result"))
    patients = t.labels.select(F.col("doc_id").alias("PIDN"), F.col("quality").cast("string").alias("Categorized_Diagnosis"))
    return expression.with_sequencing(genes, found, patients, "src1", "en")


@query("""
SELECT code, name, Platform FROM (
  SELECT c_custkey AS code, regexp_replace(regexp_replace(c_name, '-.*$', ''), '_.*$', '') AS name, 'v1' AS Platform FROM customer WHERE NOT regexp_matches(c_name, '7$')
  UNION ALL SELECT s_suppkey, s_name, 'v2' FROM supplier WHERE NOT regexp_matches(s_name, '7$'))
""")
def stacked_sheets(t: Tables):
    sheets = {"v1": t.customer.select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("Status")),
              "v2": t.supplier.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("Status"))}
    return reconcile.stack_sheets(sheets, id_col="name", drop_pattern="7$")


@query("""
SELECT p_partkey AS PIDN, CASE WHEN p_partkey IN (SELECT l_suppkey FROM lineitem) THEN 'found'
  WHEN p_size = 7 THEN 'missing' WHEN p_size < 7 THEN 'bad_rin' ELSE 'good_rin' END AS status FROM part
""")
def request_report(t: Tables):
    requests = t.part.select(F.col("p_partkey").alias("PIDN"), F.nullif("p_size", F.lit(7)).alias("RIN"))
    held = t.lineitem.select(F.col("l_suppkey").alias("PIDN"))
    return expression.request_report(requests, held).select("PIDN", "status")


@query()
def expression_gene(t: Tables):
    """Two probes of one gene through normalisation, batch correction and covariate removal."""
    m = embedding_matrix(t)
    pheno = t.embeddings.select(F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("Batch"),
                                (F.col("vec_id") % 37).cast("double").alias("AgeAtDraw"),
                                F.when(F.col("vec_id") % 3 == 0, "F").otherwise("M").alias("Gender"))
    symbols = m.select("feature_id").distinct().select(
        "feature_id", strip_suffix(F.concat(F.lit("G"), F.floor(F.col("feature_id") / 2).cast("string"), F.lit("-x")), "-").alias("symbol"))
    adjusted = expression.adjusted_matrix(m.select("feature_id", "sample_id", "value"), pheno, adjust_for=["AgeAtDraw", "Gender"],
                                          levels={"Gender": ["F", "M"]}, stabilise=False)
    return expression.gene_table(adjusted, symbols, "G3", pheno, per="pooled")


@query()
def methylation_region_anova(t: Tables):
    """Site filters, design mapping, region means, batch correction and the test of one region."""
    cells = embedding_matrix(t).select(
        "feature_id", "sample_id", (1 / (1 + F.exp(-12 * F.col("value")))).alias("value"),
        F.when((F.col("feature_id") + F.col("sample_id")) % 97 == 0, 0.2).otherwise(0.001).alias("detection"))
    notes = cells.select("feature_id").distinct().select(
        "feature_id", F.when(F.col("feature_id") % 11 == 0, "CH").otherwise("CG").alias("context"), F.lit(0).alias("snp_count"),
        F.lit("1").alias("chrom"), F.col("feature_id").cast("long").alias("pos"),
        F.when(F.col("feature_id") % 2 == 0, "I").otherwise("II").alias("design"))
    spans = notes.select("chrom", F.floor(F.col("pos") / 8).alias("k")).distinct().select(
        "chrom", F.concat(F.lit("r"), F.col("k").cast("string")).alias("region_id"), (F.col("k") * 8).alias("start"), (F.col("k") * 8 + 9).alias("end"))
    pheno = t.embeddings.select(F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("Batch"),
                                F.when(F.col("vec_id") % 2 == 0, "CONTROL").otherwise("AD").alias("Diagnosis"),
                                F.when(F.col("vec_id") % 3 == 0, "F").otherwise("M").alias("Sex"),
                                (F.col("vec_id") % 37).cast("double").alias("AGE"))
    cohort = methylation.kept_samples(pheno, F.col("Diagnosis").rlike("AD|CONTROL"))
    sites = methylation.filtered_sites(cells.join(cohort.select("sample_id"), "sample_id", "left_semi"), notes)
    values = methylation.region_values(sites, notes, spans, cohort)
    return methylation.region_tests(values, "r2", cohort)[0]
