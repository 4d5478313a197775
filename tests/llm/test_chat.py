"""Formatting and reading back, reply trees against a walk in plain Python, and masks."""

import pytest

from cohortloom.llm import chat


def test_round_trip(spark):
    said = ["", "plain", "a\\", "\\", "\\\\", "</s>", "\\</s>", "<s>[INST] user [/INST] x </s>", " </s>", " </s> <s>[INST] ", "[/INST] ",
            "[INST", "</s", "line\nbreak </s>\n", "é 😀 [INST]", "$1 \\1 \\$", " ", "<" * 50_000, None]
    roles = ["user", "assistant", "[/INST]", "a \\", None, "assistant"]
    rows = [(i // 3, i % 3, roles[i % len(roles)], t, "x") for i, t in enumerate(said)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, path string")
    tree = chat.turn_chains(turns)
    out = chat.format_branches(tree, chat.chosen_branches(chat.leaf_paths(tree)))
    got = {r["tree"]: r for r in out.select("tree", chat.read_back(out["formatted"]).alias("turns"), "formatted", "loss_mask",
                                            chat.masked_text(out["formatted"], out["loss_mask"]).alias("learned")).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c]["learned"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
        for span in got[c]["loss_mask"]:
            assert got[c]["formatted"][span["start"] + span["length"]:].startswith(" </s>")


def test_trees_have_a_path_per_leaf(spark):
    nodes = [(1, 1, None, 1.0), (1, 2, 1, 2.0), (1, 3, 1, 5.0), (1, 4, 2, 0.5), (1, 5, 2, 4.0), (1, 6, 5, 0.0), (2, 1, None, 0.0),
             (3, 7, 99, 1.0), (3, 8, 7, 1.0), (None, 1, None, 0.0), (None, 2, 1, 0.0)]
    nodes += [(4, i, i - 1 if i else None, 0.1) for i in range(70)]
    tree = spark.createDataFrame([(*n[:3], "user", f"t{n[1]}", n[3]) for n in nodes],
                                 "tree long, node long, parent long, role string, text string, score double")
    by = {(t, n): (p, s) for t, n, p, s in nodes}
    want = set()
    for t, n in by:
        if not any(t2 == t and p == n for (t2, _), (p, _) in by.items()):
            path, score, at = [], 0.0, n
            while (t, at) in by:
                path.insert(0, at)
                score += by[t, at][1]
                at = by[t, at][0]
            want.add((t, n, tuple(path), round(score, 6)))
    paths = chat.leaf_paths(tree)
    assert {(r["tree"], r["leaf"], tuple(r["path"]), round(r["score"], 6)) for r in paths.collect()} == want
    best = {r["tree"]: r["leaf"] for r in chat.chosen_branches(paths, 1).collect()}
    assert best == {1: 6, 2: 1, 3: 8, 4: 69, None: 2}
    formatted = chat.format_branches(tree, chat.chosen_branches(paths, 2))
    assert formatted.where("tree = 1").count() == 2 and formatted.count() == 6


def test_cycles_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(chat, "MAX_ROUNDS", 4)
    schema = "tree long, node long, parent long, role string, text string, score double"
    loop = spark.createDataFrame([(1, 1, 2, "u", "a", 0.0), (1, 2, 1, "u", "b", 0.0)], schema)
    with pytest.raises(ValueError):
        chat.leaf_paths(loop)
    empty = loop.limit(0)
    assert chat.format_branches(empty, chat.chosen_branches(chat.leaf_paths(empty))).count() == 0


def test_repeated_turns_stay(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "b")],
                                  "conv_id long, turn int, role string, text string")
    tree = chat.turn_chains(turns)
    row = chat.digests(chat.format_branches(tree, chat.leaf_paths(tree).withColumn("branch", chat.F.lit(1)))).first()
    assert row["n_turns"] == 3 and row["loss_chars"] == 1
