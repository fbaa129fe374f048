"""Chat formatting of reply trees, in DataFrame functions only.

Messages point to the message they answer. Root-to-leaf paths come from
iterated self-joins: a table of jumps from each message to its 2 ** k-th
ancestor is joined with itself each round, and each leaf's known ancestors are
joined with it, so a tree of depth d takes log2(d) rounds and no table is larger
than the messages or the paths. Branches of a conversation are ranked by their
mean score and the best `top` are formatted, each as one conversation.

Template: `<|im_start|>ROLE\\nTEXT<|im_end|>\\n` for each turn. In roles and
texts a `<`, any backslashes and a `|` get one backslash more, so neither holds
`<|`, and the way back takes one away; a line break in a role is `<|nl|>`.
The output has the text (`formatted`) and its parts in order (`parts`: text
and whether it is under the loss mask, as the assistant's texts are).

Defined results: null texts and roles count as empty, null scores as 0; a null
conversation or message id is an id like any other, and a null parent, or one
that isn't there, makes a root; of rows with the same conversation and message
id the one with the smallest parent, role and text stays; equal scores rank by
the smaller leaf id; branches that lead into a ring of replies have no root and
are left out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.state import forget
from .common import written

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def replies_by_turn(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages (conv, id, parent, score, role, text) of conversations that are a row a turn: each answers the one before."""
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    line = Window.partitionBy("conv").orderBy("turn", "role", "text")
    return own.withColumn("id", F.row_number().over(line).cast("long")).select("conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def paths(messages: DataFrame) -> DataFrame:
    """conv, leaf, id, up: every message on the way from each leaf to its root, `up` steps above the leaf."""
    nodes = messages.select("conv", "id", "parent")
    known = nodes.select(F.col("conv").alias("c"), F.col("id").alias("i"))
    answered = nodes.filter("parent is not null").select("conv", "parent").distinct()
    jump = written(nodes.filter("parent is not null").alias("n").join(known.alias("k"), F.expr("n.conv <=> k.c and n.parent <=> k.i"), "left_semi").select("conv", "id", F.col("parent").alias("to")), "jumps")
    leaves = nodes.alias("n").join(answered.alias("a"), F.expr("n.conv <=> a.conv and n.id <=> a.parent"), "left_anti").select("conv", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    # No way is longer than its conversation: what still jumps after as many steps is in a ring or leads to one.
    longest = messages.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    jumps = []
    while not jump.isEmpty() and 1 << len(jumps) <= longest:
        jumps.append(jump)
        second = jump.select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("to").alias("beyond"))
        jump = written(jump.join(second, F.expr("conv <=> c and to <=> i")).select("conv", "id", F.col("beyond").alias("to")), "jumps")
    last = jump
    ring = jump.select(F.col("conv").alias("c"), F.col("id").alias("i"))
    found = written(leaves.join(ring, F.expr("conv <=> c and leaf <=> i"), "left_anti"), "ways")
    for k, jump in enumerate(jumps):
        j = jump.select(F.col("conv").alias("c"), F.col("id").alias("i"), "to")
        further = found.join(j, F.expr("conv <=> c and id <=> i")).select("conv", "leaf", F.col("to").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        longer = written(found.unionByName(further), "ways")
        forget(found, jumps[k])
        found = longer
    forget(last)
    return found


def format_chats(messages: DataFrame, *, top: int = 1) -> DataFrame:
    """conv, leaf, rank, path_score, n_turns, formatted, parts: the best `top` branches of each conversation."""
    clean = messages.select("conv", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = Window.partitionBy("conv", "id").orderBy("parent", "role", "text", "score")
    clean = written(clean.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n"), "messages")
    ways = paths(clean)
    scored = ways.join(clean.select(F.col("conv").alias("c"), F.col("id").alias("i"), "score"), F.expr("conv <=> c and id <=> i"))
    branch = scored.groupBy("conv", "leaf").agg(F.avg("score").alias("path_score"))
    # The best of each of 64 lots, then of those: no task ranks all branches of one conversation.
    order = [F.desc("path_score"), F.asc_nulls_first("leaf")]
    lot = Window.partitionBy("conv", F.pmod(F.xxhash64("leaf"), F.lit(64))).orderBy(*order)
    best = branch.withColumn("rank", F.row_number().over(lot)).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(*order))).filter(F.col("rank") <= top)
    chosen = ways.join(best.select(F.col("conv").alias("c"), F.col("leaf").alias("l"), "rank", "path_score"), F.expr("conv <=> c and leaf <=> l")).select("conv", "leaf", "id", "up", "rank", "path_score")
    turn = F.struct(
        (-F.col("up")).alias("at"),
        F.concat(F.lit(START), F.regexp_replace(escape(F.col("role")), "\n", BREAK), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("loss"),
    )
    told = chosen.join(clean.select(F.col("conv").alias("c"), F.col("id").alias("i"), "role", "text"), F.expr("conv <=> c and id <=> i"))
    turns = told.groupBy("conv", "leaf").agg(F.first("rank").alias("rank"), F.first("path_score").alias("path_score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = F.flatten(F.transform("turns", lambda t: F.array(F.struct(t.head.alias("text"), F.lit(False).alias("loss")), F.struct(t.body.alias("text"), t.loss.alias("loss")), F.struct(F.lit(f"{END}\n").alias("text"), F.lit(False).alias("loss")))))
    return turns.select("conv", "leaf", "rank", "path_score", F.size("turns").alias("n_turns"), parts.alias("parts")).withColumn("formatted", F.array_join(F.transform("parts", lambda p: p.text), ""))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, unescaped."""
    inner = F.substring(formatted, len(START) + 1, F.length(formatted) - len(START) - len(END) - 1)
    pieces = F.split(inner, r"<\|im_end\|>\n<\|im_start\|>", -1)
    role = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_replace(role(p), r"<\|nl\|>", "\n")).alias("role"), unescape(F.substring(p, F.length(role(p)) + 2, F.length(p))).alias("text")))


def loss_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p.loss), lambda p: unescape(p.text)), "")
