"""Chat formatting of reply trees [DataFrame functions only].

Messages point at the message they answer.  Iterative self-joins double the
known stretch of every path towards its root (a tree of depth d takes
log2(d) joins of ids and scores, no texts); the leaves of a tree are ranked by
their path's mean score, and each chosen path becomes one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for every turn.  In texts and
roles a backslash becomes ``\\0``, the first character of a control string
``\\1`` (for ``<``) or ``\\2`` (for ``[``), and in roles a line break ``\\3``; so
no control string is left inside a text, and reading back is exact.

Defined results: null texts and roles are empty; a null tree id is a tree of
its own; a message whose parent does not exist is a root; equal scores rank
by message id; repeated (tree, message) ids and parent cycles raise; an empty
table gives an empty result; other columns are never read.  For a linear
conversation ties in ``turn`` are ordered by role and text, repeated rows are
turns of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm._store import materialise

START, END = "<|im_start|>", "<|im_end|>\n"
_ANGLE = r"<(?=/?s>|</?SYS>>|\|[A-Za-z0-9_]+\|>)"
_SQUARE = r"\[(?=/?INST\])"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\0"))
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, r"\\1"), _SQUARE, r"\\2")


def unescape(text: Column) -> Column:
    for mark, char in (("\\1", "<"), ("\\2", "["), ("\\3", "\n"), ("\\0", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def _piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("\\3")), F.lit("\n"), text, F.lit(END))


def linear_messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                    role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A linear conversation as a tree: every turn answers the one before it."""
    rows = turns.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("_turn"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("tree").orderBy("_turn", "role", "text")
    rows = rows.withColumn("msg", F.row_number().over(order).cast("long"))
    return rows.select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"),
                       F.lit(0.0).alias("score"), "role", "text")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def _ancestors(links: DataFrame, nodes: int) -> tuple[list[DataFrame], DataFrame]:
    """Level k holds the 2**k-th ancestor of every message that has one; the last
    table holds each message's depth and the score sum of its path.  Messages
    whose root is known take no further part."""
    state = links.select("tree", "msg", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("depth"),
                         F.coalesce("score", F.lit(0.0)).alias("total"))
    levels: list[DataFrame] = []
    done: list[DataFrame] = []
    for _ in range(math.ceil(math.log2(max(2, nodes))) + 2):
        state = materialise(state, "ancestors")
        done.append(state.filter("anc is null"))
        state = state.filter("anc is not null")
        if state.isEmpty():
            return levels, _union(done)
        levels.append(state.select("tree", "msg", "anc"))
        up = _union([state, *done]).select(F.col("tree").alias("t"), F.col("msg").alias("m"), F.col("anc").alias("a"),
                                           F.col("depth").alias("d"), F.col("total").alias("s"))
        state = state.join(up, _same("tree", "t") & (F.col("anc") == F.col("m"))).select(
            "tree", "msg", F.col("a").alias("anc"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("s")).alias("total"))
    raise ValueError("the parents of some messages form a cycle")


def chosen_paths(messages: DataFrame, paths_per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, msg, depth) of every message on a chosen path; ``None`` takes all paths."""
    links = materialise(messages.select("tree", "msg", "parent", "score"), "links")
    nodes = links.count()
    if links.groupBy("tree", "msg").count().filter("count > 1").limit(1).count():
        raise ValueError("a message id occurs twice in a tree")
    known = links.select(F.col("tree").alias("t"), F.col("msg").alias("m"))
    links = links.join(known, _same("tree", "t") & (F.col("parent") == F.col("m")), "left").select(
        "tree", "msg", F.col("m").alias("parent"), "score")
    levels, whole = _ancestors(links, nodes)
    answered = links.filter("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("m")).distinct()
    leaves = whole.join(answered, _same("tree", "t") & (F.col("msg") == F.col("m")), "left_anti")
    if paths_per_tree is not None:
        rank = Window.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), "msg")
        leaves = leaves.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= paths_per_tree)
    parts = [materialise(leaves.select("tree", F.col("msg").alias("leaf"), "msg"), "paths")]
    for level in levels:  # each level adds the messages that lie 2**k above those known
        up = level.select(F.col("tree").alias("t"), F.col("msg").alias("m"), "anc")
        more = _union(parts).join(up, _same("tree", "t") & (F.col("msg") == F.col("m")))
        parts.append(materialise(more.select("tree", "leaf", F.col("anc").alias("msg")), "paths"))
    paths = _union(parts)
    depth = whole.select(F.col("tree").alias("t"), F.col("msg").alias("m"), "depth")
    return paths.join(depth, _same("tree", "t") & (F.col("msg") == F.col("m"))).drop("t", "m")


def formatted(messages: DataFrame, paths_per_tree: int | None = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, ``formatted`` text, and ``loss_mask``,
    the code-point spans of the assistant texts in it.

    Texts are escaped where they lie and shuffled once, to their path.
    """
    messages = materialise(messages, "messages")
    pieces = messages.select(F.col("tree").alias("t"), F.col("msg").alias("m"), F.col("role").alias("_role"),
                             escape(F.col("text")).alias("_text"))
    rows = chosen_paths(messages, paths_per_tree).join(pieces, _same("tree", "t") & (F.col("msg") == F.col("m")))
    rows = rows.select("tree", "leaf", "depth", _piece(F.col("_role"), F.col("_text")).alias("piece"),
                       F.length("_text").cast("long").alias("_size"), (F.col("_role") == LEARNED_ROLE).alias("_learn"))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("piece").cast("long")).over(before) - F.length(F.lit(END))
    rows = rows.withColumn("_end", end)
    path = F.sort_array(F.collect_list(F.struct("depth", "piece", "_size", "_learn", "_end")))
    return rows.groupBy("tree", "leaf").agg(path.alias("_path")).select(
        "tree", "leaf", F.array_join(F.transform("_path", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("_path", lambda x: x["_learn"]),
                    lambda x: F.struct((x["_end"] - x["_size"]).alias("start"), x["_end"].alias("end"))).alias("loss_mask"))


def turns_of(text: Column) -> Column:
    """Read back: array of (role, text) of a formatted conversation."""
    parts = F.split(text, r"<\|im_end\|>\n", -1)
    parts = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x)))
    return F.transform(parts, lambda x: F.struct(
        unescape(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x))).alias("text")))


def learned_text(text: Column, mask: Column) -> Column:
    """Read back: all text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(
        F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """Per formatted conversation, everything read back from the output."""
    rows = conversations.select("tree", "formatted", turns_of(F.col("formatted")).alias("turns"),
                                learned_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
