"""The pipeline's stages, each against a brute-force version on its own input."""

import re

import pytest
from test_decontaminate import brute as benchmark_hits
from test_near_dup import brute as near_groups
from test_packing import check

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def rules_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return not (len(words) < 50 or 100 * len(covered) > 50 * len(words) or 10 * len(re.findall(r"[#*$%&|<>]", text)) > len(words)
                or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or not 2 * len(words) <= sum(map(len, words)) <= 14 * len(words))


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], FOLDER).persist())
    return out


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for later in stages[1:-1]:
        assert later.columns == stages[0].columns and later.dtypes == stages[0].dtypes


def test_each_stage(spark, stages):
    start, spoken, good, single, clean, pieces = ([tuple(r) for r in s.collect()] for s in stages)
    assert len(spoken) >= 0.99 * len(start) and set(spoken) <= set(start)
    assert {r[0] for r in good} == {r[0] for r in spoken if rules_by_hand(r[1])}
    groups = near_groups([(r[0], r[1]) for r in good], 5, 80)
    assert {r[0] for r in single} == {d for d, _, _, kept in groups if kept}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d for d, *_, flag in benchmark_hits([(r[0], r[1]) for r in single], items) if flag}
    before = {r[0]: r for r in single}
    assert all(r == before[r[0]] for r in clean if r[0] not in hit)
    assert {r[0] for r in single} - {r[0] for r in clean} <= hit
    assert not any(flag for *_, flag in benchmark_hits([(r[0], r[1]) for r in clean], items))
    assert all(r[4] == len(r[1]) for r in clean)
    check([(r[0], r[1]) for r in clean], [r.asDict() for r in stages[-1].collect()], 2048)
    assert len(pieces) == corpus_pipeline.run(spark, FOLDER).count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
