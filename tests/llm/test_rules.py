"""The ledger against plain Python, and policies and ablations against evaluating rules anew."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cohortloom.llm import rules


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines)}


def bits(m):
    return [m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], 10 * m["n_symbols"] > m["n_words"],
            100 * m["n_dup_lines"] > 50 * m["n_lines"],
            m["n_words"] > 0 and not 2 * m["n_words"] <= m["word_chars"] <= 14 * m["n_words"]]


def corpus():
    rng = random.Random(8)
    texts = [None, "", " \n\t\x0b\f\r ", "a", "a b", "a b c", "a b c a b c", "x\n\nx\n x\nx", "é 😀 " * 30, "w " * 40_000, "v" * 90_000,
             "one two three four", "# * $ % & | < >"]
    texts += [" ".join(rng.choices(["ab", "cd", "ef", "g#", "h"], k=rng.randrange(1, 120))) + "\n" * rng.randrange(3) for _ in range(60)]
    return [(i if i % 9 else None, t, f"kept{i}", 1) for i, t in enumerate(texts)]


def frame(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, kept string, n_words int")


def test_ledger(spark):
    got = rules.verdict(rules.ledger(frame(spark), keep=["kept"]).withColumnRenamed("kept", "name")).collect()
    want = {name: measures(t) for _, t, name, _ in corpus()}
    assert len(got) == len(want)
    for r in got:
        m = want[r["name"]]
        assert {c: r[c] for c in m} == m
        failed = bits(m)
        assert r["failed_bits"] == sum(1 << i for i, f in enumerate(failed) if f)
        assert r["base_failed"] == any(failed[:2]) and r["kept"] == (not any(failed))


def test_policies_and_ablations(spark):
    entries = rules.ledger(frame(spark), keep=[])
    failed = [bits(measures(t)) for _, t, _, _ in corpus()]
    for version, mask in rules.POLICIES.items():
        used = [i for i in range(len(rules.RULES)) if mask >> i & 1]
        assert rules.verdict(entries, version).where("kept").count() == sum(not any(f[i] for i in {*used, 0, 1}) for f in failed)
    names = list(rules.RULES)
    for r in rules.ablations(entries).collect():
        i, mask = names.index(r["rule"]), rules.POLICIES[r["policy"]]
        assert r["n_failing"] == sum(f[i] for f in failed)
        assert r["n_regained"] == sum(f[i] and not any(x for j, x in enumerate(f) if j != i and mask >> j & 1) for f in failed)


def test_accepted_keeps_the_documents_columns(spark):
    df = frame(spark)
    out = rules.accepted(df)
    assert out.columns == df.columns
    assert sorted(r["kept"] for r in out.collect()) == sorted(n for _, t, n, _ in corpus() if not any(bits(measures(t))))
    assert rules.accepted(df.limit(0)).count() == 0


def test_filtering_does_not_measure_anew(spark):
    """A filter on the verdict stays above the measurements, and long texts stay linear."""
    long = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("array_join(transform(sequence(1, 60000), x -> concat('word', x)), ' ')").alias("text"))
    assert rules.accepted(long.repartition(1)).count() == 1
    assert rules.verdict(rules.ledger(long, keep=["doc_id"])).where("kept").count() == 1


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    judged = rules.verdict(rules.ledger(docs, keep=["doc_id", "quality"]))
    assert judged.where("quality = 1 and not kept and not base_failed").count() == 0
    assert judged.where("quality = 0 and kept").count() <= 0.02 * judged.where("quality = 0").count()
