"""Shards against a recursive split in plain Python."""

import hashlib

import pytest

from cohortloom.llm import sharding


def brute(rows, limit):
    """rows: (key, bytes). Returns (key, bytes) -> (shard, bytes, rows), as sorted rows."""
    out = []

    def split(bucket, depth, name):
        size = sum(b for _, _, b in bucket)
        if size <= limit or depth == sharding.BITS:
            out.extend((k, name, depth, b, size, len(bucket)) for k, _, b in bucket)
            return
        for bit in "01":
            half = [x for x in bucket if x[1][depth] == bit]
            if half:
                split(half, depth + 1, name + bit)

    def bits(key):
        text = "" if key is None else str(key)
        return bin(int(hashlib.md5(text.encode()).hexdigest()[:15], 16))[2:].zfill(60)

    if rows:
        split([(k, bits(k), b) for k, b in rows], 0, "")
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [200, 3_000, 40_000, 10**9])
def test_directory(spark, limit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sharding.assign(docs, limit).collect()
    rows = [(r["doc_id"], len(r["text"].encode())) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["shard"], r["depth"], r["n_bytes"], r["shard_bytes"], r["n_docs"]) for r in got), key=repr) == brute(rows, limit)


def test_one_key_with_most_rows(spark):
    rows = [(7, "x" * (10 + i % 5), i) for i in range(500)] + [(i, "y" * 20, i) for i in range(100, 200)] + [(None, "z" * 30, 0), (3, None, 1),
                                                                                                      (4, "w" * 900, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.assign(docs, 400).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes.setdefault((r["shard"], r["page"]), []).append(r["n_bytes"])
    assert all(sum(b) <= 400 or len(b) == 1 for b in sizes.values())
    assert sorted(((r["doc_id"], r["shard"], r["depth"], r["n_bytes"], r["shard_bytes"], r["n_docs"]) for r in got), key=repr) == brute(
        [(k, len((t or "").encode())) for k, t, _ in rows], 400)
    assert {r["page"] for r in got if r["doc_id"] != 7} == {0}
    assert sharding.assign(docs.limit(0), 400).count() == 0


def test_written_shards_hold_all_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), 50_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0 and back.count() == docs.count()


def test_repeated_and_missing_keys_are_written_once(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, None), (1, "c"), (2, "d" * 50)] + [(5, f"{i}" * 9) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sharding.write_shards(docs, str(tmp_path / "out"), 60)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in back.collect()))) == sorted(map(str, rows))
    sizes = back.groupBy("shard", "page").agg({"text": "count"}).count()
    assert sizes > 10
    with pytest.raises(ValueError, match="page"):
        sharding.write_shards(docs.withColumnRenamed("text", "page"), str(tmp_path / "no"))
