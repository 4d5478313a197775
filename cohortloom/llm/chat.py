"""Chat formatting of reply trees, in DataFrame operations only.

A tree is a set of messages with parents. Paths from the roots to the leaves come from iterative self-joins that
double their reach each round. Branches are
ranked by the score of their path, and each chosen path becomes one conversation.

The template writes a turn as ``<s>[INST] role [/INST] text </s>``. These four control strings and the backslash
get a backslash before them where they occur inside a role or text. A real mark always follows a space and an
escaped one a backslash, so formatting can be reversed, whatever is said.
The loss mask holds the (start, length) of every assistant text, in code points of the formatted conversation.

NULL texts and roles are empty. Messages whose parent is missing are roots. Repeated rows become turns of their own
that follow each other. Cycles are an error. An empty table gives an empty result, and extra columns are not read.
A conversation is one output row, so one conversation has to fit a row; how many share a text does not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.session import materialise

ASSISTANT = "assistant"
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", " </s>"
CONTROL = r"(\\|</?s>|\[/?INST\])"
ESCAPED = r"\\(\\|</?s>|\[/?INST\])"
MAX_ROUNDS = 40  # of doubling: paths of up to 2^40 messages


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


def turn_chains(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """Reply trees (tree, node, parent, role, text, score) of conversations stored by turn: every turn
    answers the one before. Equal turns are ordered by role and text."""
    clean = turns.select(F.col(conversation).alias("tree"), F.col(turn).alias("__turn"),
                         F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    place = F.row_number().over(W.partitionBy("tree").orderBy(F.col("__turn").asc_nulls_last(), "role", "text")).cast("long")
    return clean.withColumn("node", place).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"))


def leaf_paths(tree: DataFrame) -> DataFrame:
    """(tree, leaf, path, score): the nodes from root to leaf and the sum of their scores, for every leaf.

    Ancestor links double their reach each round, and so do the paths that climb from the leaves along them; nodes
    whose links have passed the root drop out, so rounds for one deep tree don't touch the others. ``path`` holds
    node numbers only; texts are joined once the branches are chosen.
    """
    here = lambda a, b: F.col("tree").eqNullSafe(F.col("__t")) & (F.col(a) == F.col(b))
    known = tree.select(F.col("tree").alias("__t"), F.col("node").alias("__n"))
    # A parent that is not in the tree makes its child a root.
    links = materialise(tree.where("parent is not null").join(known, here("parent", "__n"), "left_semi")
                        .select("tree", "node", F.col("parent").alias("up")), "links")
    parents = links.select(F.col("tree").alias("__t"), F.col("up").alias("__n")).distinct()
    leaves = tree.join(parents, here("node", "__n"), "left_anti")
    climbed = [materialise(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("far")), "climb")]
    reach = 1
    for _ in range(MAX_ROUNDS):
        if links.isEmpty():
            break
        jump = links.select(F.col("tree").alias("__t"), F.col("node").alias("__n"), F.col("up").alias("__u"))
        so_far = reduce(DataFrame.unionByName, climbed)
        climbed.append(materialise(so_far.join(jump, here("node", "__n")).select(
            "tree", "leaf", F.col("__u").alias("node"), (F.col("far") + reach).alias("far")), "climb"))
        links = materialise(links.join(jump, here("up", "__n")).select("tree", "node", F.col("__u").alias("up")), "links")
        reach *= 2
    else:
        raise ValueError("reply trees hold a cycle")
    scores = tree.select(F.col("tree").alias("__t"), F.col("node").alias("__n"), "score")
    steps = reduce(DataFrame.unionByName, climbed).join(scores, here("node", "__n"))
    return steps.groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("far", "node")), asc=False).alias("steps"), F.sum("score").alias("score")).select(
        "tree", "leaf", F.col("steps.node").alias("path"), "score")


def chosen_branches(paths: DataFrame, best: int | None = None) -> DataFrame:
    """Add ``branch``, the rank of a leaf's path in its tree by score (then by leaf), and keep the first
    ``best`` of them, or all."""
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    ranked = paths.withColumn("branch", rank)
    return ranked if best is None else ranked.where(F.col("branch") <= best)


def format_branches(tree: DataFrame, branches: DataFrame) -> DataFrame:
    """(tree, branch, formatted, loss_mask): one conversation per chosen branch."""
    steps = branches.select("tree", "branch", F.posexplode("path").alias("at", "node"))
    said = tree.select(F.col("tree").alias("__t"), F.col("node").alias("__n"), escape(F.col("role")).alias("__role"),
                       escape(F.col("text")).alias("__text"), "role")
    turns = steps.join(said, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("node") == F.col("__n")))
    head = F.concat(F.lit(OPEN), "__role", F.lit(MIDDLE))
    size = F.length(head) + F.length("__text") + len(CLOSE)
    earlier = W.partitionBy("tree", "branch").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = turns.select("tree", "branch", "at", F.concat(head, "__text", F.lit(CLOSE)).alias("piece"),
                          (F.coalesce(F.sum(size).over(earlier), F.lit(0)) + F.length(head)).alias("start"),
                          F.length("__text").alias("length"), (F.col("role") == ASSISTANT).alias("learned"))
    whole = placed.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(F.struct(
        "at", "piece", "start", "length", "learned"))).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["learned"]),
                       lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return whole.select("tree", "branch", F.array_join("turns.piece", "").alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as array of (role, text)."""
    turns = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")

    def turn(x):
        at = F.instr(x, MIDDLE)
        return F.struct(unescape(x.substr(F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
                        unescape(x.substr(at + len(MIDDLE), F.length(x))).alias("text"))

    return F.transform(turns, turn)


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss_mask, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: turns and masked text as counts and hashes."""
    f, turns = F.col("formatted"), F.col("turns")
    read = conversations.select("tree", "branch", "formatted", read_back(f).alias("turns"),
                                masked_text(f, F.col("loss_mask")).alias("learned"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length(f).cast("long").alias("formatted_chars"))
