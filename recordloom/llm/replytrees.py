"""Conversations from reply trees.

Turns form trees by their parents.  Root-to-leaf paths are enumerated by
iterative self-joins that double the length of the known part of every path, so
trees of depth d take about log2(d) rounds.  Branches are ranked by score within
their tree, and each chosen one is written as one conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import save

_BEGIN, _END = "<|im_start|>", "<|im_end|>"


def escaped(text: F.Column) -> F.Column:
    """text in which no control token of the format can be read: each <| gets a space between its characters."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def nodes_of(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, parent_col: str | None, score_col: str | None = None) -> DataFrame:
    """(conv, node, parent, turn, role, text, score), a row for every distinct turn; see conversations()."""
    own = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (F.col(parent_col).cast("long") if parent_col else F.lit(None).cast("long")).alias("reply_to"),
        (F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(None).cast("double")).alias("given"),
    ).where("conv is not null").distinct()
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text", F.col("reply_to").asc_nulls_first(), "given")
    own = own.withColumn("node", F.row_number().over(order).cast("long")).withColumn("score", F.col("given") if score_col else F.length("text").cast("long"))
    if parent_col:
        # several rows may share a turn number: replies to it hang on the first of them
        first = own.where("turn is not null").groupBy("conv", "turn").agg(F.min("node").alias("parent")).withColumnRenamed("turn", "reply_to")
        return own.join(first, ["conv", "reply_to"], "left").select("conv", "node", "parent", "turn", "role", "text", "score")
    before = Window.partitionBy("conv").orderBy("node")
    changed = F.lag("role").over(before) != F.col("role")
    own = own.withColumn("turned", F.when(changed, F.lag("node").over(before)))
    return own.withColumn("parent", F.last("turned", ignorenulls=True).over(before)).select("conv", "node", "parent", "turn", "role", "text", "score")


def paths(nodes: DataFrame) -> DataFrame:
    """(conv, root, leaf, path, score) of every root-to-leaf path of nodes (conv, node, parent, score).

    Paths grow from the leaves by self-joins.  In round k an inner node knows the
    2^k nodes from itself upwards (its hop), and every path that is not at its
    root yet takes the hop of the node above it.  Paths that are done are not
    joined again.  Nodes on or below a cycle have no root, so they are on no path.
    """
    inner = nodes.where("parent is not null").select("conv", F.col("parent").alias("node")).distinct()
    tree = nodes.select("conv", "node", "parent", "score")
    found = tree.join(inner, ["conv", "node"], "left_anti")
    # open: paths by their leaf, from `up` (not on the path yet) down; hops: nodes with the piece of path above them
    opened = save(found.select("conv", F.col("node").alias("leaf"), F.col("parent").alias("up"), F.array("node").alias("path"), F.col("score").alias("total")), "open")
    hops = tree.where("parent is not null").join(inner, ["conv", "node"]).select("conv", "node", F.col("parent").alias("next"), F.array("node").alias("piece"), F.col("score").alias("more"))
    roots = tree.where("parent is null").join(inner, ["conv", "node"]).select("conv", "node", F.lit(None).cast("long").alias("next"), F.array("node").alias("piece"), F.col("score").alias("more"))
    hops = save(hops.unionByName(roots), "hops")
    done = [opened.where("up is null")]
    opened = opened.where("up is not null")
    while opened.head(1):
        step = hops.select("conv", F.col("node").alias("up"), "next", "piece", "more")
        longer = opened.join(step, ["conv", "up"]).select("conv", "leaf", F.col("next").alias("up"), F.concat("piece", "path").alias("path"), (F.col("total") + F.col("more")).alias("total"))
        # a path with a node twice runs in a cycle
        longer = save(longer.where("size(path) = size(array_distinct(path))"), "open")
        done.append(longer.where("up is null"))
        opened = longer.where("up is not null")
        # pieces that end at a root stay as they are; of the others, only those that an open path can still meet
        far = hops.select("conv", F.col("node").alias("next"), F.col("next").alias("beyond"), F.col("piece").alias("head"), F.col("more").alias("above"))
        both = hops.where("next is not null").join(far, ["conv", "next"]).select("conv", "node", F.col("beyond").alias("next"), F.concat("head", "piece").alias("piece"), (F.col("more") + F.col("above")).alias("more"))
        both = both.where("size(piece) = size(array_distinct(piece))")
        hops = save(both.unionByName(hops.where("next is null")), "hops") if opened.head(1) else hops
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every.select("conv", F.element_at("path", 1).alias("root"), "leaf", "path", F.col("total").alias("score"))


def conversations(
    turns: DataFrame,
    top: int = 3,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parent_col: str | None = None,
    score_col: str | None = None,
) -> DataFrame:
    """The best branches of every reply tree: (conv_id, root, leaf, rank, score, n_turns, conversation).

    parent_col holds the turn that a row replies to (null: a root; a turn that
    does not exist makes a root too).  Without it, a turn replies to the last
    turn before it that has another role, so neighbours of one role are
    alternative replies.  root and leaf are turns numbered from 1 by turn, role and
    text within their conversation.  A branch scores the sum of score_col over
    its turns, a null counting 0, or without it the characters of its texts; the
    `top` branches of every root stay, of equal scores the one with the smaller
    leaf first, and each is formatted as one chat.  A control token inside a role
    or text is broken up by a space, so it can't end or begin a turn.

    Rows that repeat in full count once, and rows that share a turn number are
    alternatives or replies by the same rule.  A null role is "unknown", a null
    text empty, a null turn comes first, and rows with a null conversation are
    left out, as are turns on or below a cycle of replies.  A very long text is a
    turn like any other.  Other columns are ignored whatever their names.  An
    empty table gives an empty result.
    """
    nodes = save(nodes_of(turns, conv_col, turn_col, role_col, text_col, parent_col, score_col), "turns")
    ranked = paths(nodes.select("conv", "node", "parent", "score")).withColumn("rank", F.row_number().over(Window.partitionBy("conv", "root").orderBy(F.col("score").desc(), "leaf")))
    chosen = ranked.where(F.col("rank") <= top)
    steps = chosen.select("conv", "root", "leaf", "rank", F.col("score").alias("branch"), F.posexplode("path").alias("at", "node")).join(nodes, ["conv", "node"])
    chat = F.concat(F.lit(_BEGIN), escaped(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(f"{_END}\n"))
    whole = steps.groupBy("conv", "root", "leaf", "rank", "branch").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("at", chat.alias("chat")))).alias("chats"))
    return whole.select(F.col("conv").alias("conv_id"), "root", "leaf", "rank", F.col("branch").alias("score"), "n_turns", F.array_join(F.col("chats.chat"), "").alias("conversation"))


def oracle(top: int = 3) -> str:
    """conversations() over the conversations table as DuckDB SQL."""
    return f"""
WITH RECURSIVE own AS (
  SELECT DISTINCT conv_id AS conv, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS node FROM own
), turned AS (
  SELECT *, CASE WHEN lag(role) OVER w <> role THEN lag(node) OVER w END AS turned FROM numbered WINDOW w AS (PARTITION BY conv ORDER BY node)
), nodes AS (
  SELECT *, last_value(turned IGNORE NULLS) OVER (PARTITION BY conv ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent FROM turned
), walk AS (
  SELECT conv, node AS root, node, length(text) AS score, 1 AS n_turns, '{_BEGIN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{_END}' || chr(10) AS conversation FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT w.conv, w.root, n.node, w.score + length(n.text), w.n_turns + 1, w.conversation || '{_BEGIN}' || replace(n.role, '<|', '< |') || chr(10) || replace(n.text, '<|', '< |') || '{_END}' || chr(10)
  FROM walk w JOIN nodes n ON n.conv = w.conv AND n.parent = w.node
), branches AS (
  SELECT *, row_number() OVER (PARTITION BY conv, root ORDER BY score DESC, node) AS rank
  FROM walk w WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.conv = w.conv AND n.parent = w.node)
)
SELECT conv AS conv_id, root, node AS leaf, CAST(rank AS INT) AS rank, CAST(score AS BIGINT) AS score, CAST(n_turns AS BIGINT) AS n_turns, conversation
FROM branches WHERE rank <= {top}
"""
