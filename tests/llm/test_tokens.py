"""Counts of the transducer against the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortloom.llm import tokens, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
MACHINE = tokens.Transducer(tokens.Merges(open(PATH, encoding="utf-8").read()))
SIGNS = [*" \n\t'abcdelmrstvTHE.,!?-_019é", "ß", "ñ", "…", "’", "漢", "字", "😀", " ", "　", "​", "é",
         "'s", "'re", "'ll", "'ve", " the", "  ", "ing", "tion", "<|", "|>"]


def expected(text):
    return len(TOK.encode(text or "", add_special_tokens=False).ids)


def test_fixed_texts():
    texts = ["don't", "we'll 'tis ''s 's's 'r 'rx 'lx 'l", "a  b   c", "a \n b\n\nc \t", "", "'", "it's  'ok' '' 're", "  x", " ",
             "\n", "a\n", None, "x" * 3000, "é" * 999 + "1234567 !!!", "y" * 20_000, "<|endoftext|>a <|endoftext|>\n<|endoftext", "\x00\x85 a"]
    assert tokens.counted(pa.array(texts), MACHINE).tolist() == [expected(t) for t in texts]


@pytest.mark.parametrize("chunk", [1, 3, 7, 64])
def test_chunk_maps_compose(chunk):
    rng = random.Random(chunk)
    texts = ["".join(rng.choices(SIGNS, k=rng.randrange(0, 60))) for _ in range(400)]
    texts = [t.replace("<|endoftext|>", "") for t in texts]
    data, offsets = words.utf8(pa.array(texts))
    assert MACHINE.counts(data, offsets, chunk).tolist() == [expected(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert tokens.counted(pa.array(texts, pa.string()), MACHINE).tolist() == [expected(t) for t in texts]


def test_rebuilt_tables_give_the_same_counts():
    small = tokens.Transducer(MACHINE.merges, max_states=50)
    texts = [f"word{i} and other things, don't stop {i * i}" for i in range(50)]
    for part in range(0, 50, 5):
        own = texts[part:part + 5]
        assert tokens.counted(pa.array(own), small).tolist() == [expected(t) for t in own]


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = tokens.token_counts(docs, PATH, ["doc_id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), expected(text), expected(text) > 512)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "a b", 7), (2, "a b", 8), (2, "a b", 8)],
                               "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tokens.token_counts(df, PATH, ["doc_id"]).collect()), key=repr)
    assert got == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 3, 2, False), (2, 3, 2, False), (2, 3, 2, False)], key=repr)
    assert tokens.token_counts(df.limit(0), PATH, ["doc_id"]).count() == 0


def test_array_growth_keeps_learned_transitions():
    before = MACHINE.next[MACHINE.start, MACHINE.column[32]]
    tokens.counted(pa.array(["".join(chr(c) for c in range(0x400, 0x700))]), MACHINE)
    assert MACHINE.next[MACHINE.start, MACHINE.column[32]] == before
    assert np.array_equal(MACHINE.next.shape, MACHINE.change.shape)
