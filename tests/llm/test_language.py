"""Character models against a direct Kneser-Ney computation, and accuracy on held-out documents."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import language as lid

TEXTS = {"aa": ["the cat sat on the mat", "The hat, the Cat; 12 that!", "a cat that sat"],
         "bb": ["le chat était là", "la été échoué le chat", "lé chat là était où"]}


def kneser_ney(texts, order):
    """Straight from the definition; returns p(symbol | context) for a word's prefix."""
    import re

    counts = [Counter() for _ in range(order + 1)]
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            s = lid.BEGIN + word + lid.END
            for at in range(2, len(s) + 1):
                for n in range(1, min(order, at) + 1):
                    counts[n][s[at - n:at]] += 1
    used = [Counter() for _ in range(order + 1)]
    for n in range(1, order + 1):
        for gram, c in counts[n].items():
            if n == order or gram.startswith(lid.BEGIN):
                used[n][gram] = c
            else:
                used[n][gram] = sum(1 for g in counts[n + 1] if g[1:] == gram)
    discount, total, kinds = {}, defaultdict(float), Counter()
    for n in range(1, order + 1):
        once, twice = (sum(1 for c in used[n].values() if c == k) for k in (1, 2))
        discount[n] = min(max(once / (once + 2 * twice) if once + 2 * twice else 0.5, 0.05), 0.95)
        for gram, c in used[n].items():
            total[gram[:-1]] += c
            kinds[gram[:-1]] += 1

    def p(gram, symbols):
        value = 1 / symbols
        for n in range(1, min(order, len(gram)) + 1):
            ctx = gram[len(gram) - n:-1]
            if total[ctx]:
                seen = used[n].get(gram[-n:], 0)
                value = max(seen - discount[n], 0) / total[ctx] * (seen > 0) + discount[n] * kinds[ctx] / total[ctx] * value
        return value

    return p


def frame(spark):
    rows = [(i * 10 + j, t, lang) for i, (lang, texts) in enumerate(TEXTS.items()) for j, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("order", [2, 3, 5])
def test_probabilities(spark, order):
    model = lid.fit(frame(spark), F.lit(True), order)
    assert model.languages == ["aa", "bb"]
    tests = ["the", "chat", "zebra", "était", "ou"]
    for j, lang in enumerate(model.languages):
        p = kneser_ney(TEXTS[lang], order)
        for word in tests:
            s = lid.BEGIN + word + lid.END
            want = -sum(math.log2(p(s[:at], model.symbols)) for at in range(2, len(s) + 1))
            symbols, bits = lid.text_bits(pa.array([f"{word.upper()} 12"]), model)
            assert symbols[0] == len(word) + 1
            assert bits[0, j] == pytest.approx(want, rel=1e-5)


def test_rows_of_all_kinds(spark):
    model = lid.fit(frame(spark), F.lit(True))
    rows = [(1, None, "x"), (2, "", "y"), (3, "12 -- 34!", None), (4, "the cat", "z"), (None, "là était", "z"),
            (4, "the cat", "z"), (6, "chat " * 50_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = lid.identify(df, model, ["doc_id", "h"]).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1, 2, 3))
    assert by[4]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb" and by[6]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got)
    out = lid.accepted(df, model)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} <= {4, None, 6}
    assert lid.identify(df.limit(0), model, ["doc_id"]).count() == 0
    untaught = lid.fit(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in lid.identify(df, untaught, ["doc_id"]).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lid.held_out(F.col("doc_id"))
    model = lid.fit(docs, ~held)
    got = lid.identify(docs.where(held), model, ["doc_id", "lang"])
    right, n, rejected = got.agg(F.count_if(F.expr("lang = lang_pred")), F.count("*"), F.count_if(F.col("rejected"))).first()
    assert right >= 0.98 * n and rejected == 0


def test_words_are_scored_in_any_slice(spark):
    model = lid.fit(frame(spark), F.lit(True))
    texts = ["the cat", None, "sat là", "the cat sat là"]
    symbols, bits = lid.text_bits(pa.array(texts), model)
    assert symbols[3] == symbols[0] + symbols[2]
    assert np.allclose(bits[3], bits[0] + bits[2])
