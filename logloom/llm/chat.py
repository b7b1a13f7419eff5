"""Reply trees as conversations, with DataFrame functions only.

A tree is rows (tree, node, parent, role, text, score). Iterative self-joins double the distance to an ancestor in each
round, so depth d takes log2(d) rounds: first they sum the scores up to the root, which ranks the leaves; then they list
the nodes of the chosen root-to-leaf paths only.

Rows: a parent that is null, missing or the node itself makes a root. Repeated ids in a tree are one node, the first row
by (parent, role, text). Nodes on a cycle or below one have no path from a root and come out in none. Null role or text
is empty, a null score 0, a null tree a tree. Empty tables give no rows; extra columns are not read.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.checkpoints import materialize


@dataclass(frozen=True)
class ChatTemplate:
    """Turns look like ``[INST]role[/INST]text</s>``.

    Inside roles and texts a backslash is doubled and a control string gets one after its first character; so no
    control string is left, single backslashes are ours, and ``unescape`` gives the text back.
    """

    begin: str = "[INST]"
    middle: str = "[/INST]"
    end: str = "</s>"

    def escape(self, text: Column) -> Column:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for control in (self.begin, self.middle, self.end):
            text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
        return text

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\(\\?)", "$1")

    def format(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.begin), self.escape(role), F.lit(self.middle), self.escape(text), F.lit(self.end))


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables k = 0, 1, ... of (tree, node, jump, total, depth): the ancestor 2^k steps up (null above the root), and the
    sum and number of scores from the node to below that ancestor. In the last one every jump is null."""
    links = nodes.select("tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), "score")
    have = nodes.select(F.col("tree").alias("t"), F.col("node").alias("parent_node"))
    known = links.where(F.col("parent").isNotNull()).join(
        have, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("parent_node")), "left"
    )
    start = known.select("tree", "node", F.col("parent_node").alias("jump"), F.col("score").alias("total"), F.lit(1).alias("depth"))
    roots = links.where(F.col("parent").isNull()).select(
        "tree", "node", F.col("parent").alias("jump"), F.col("score").alias("total"), F.lit(1).alias("depth")
    )
    tables = [materialize(start.unionByName(roots), "chat-jumps")]
    most = nodes.count()
    while True:
        state = tables[-1]
        live = state.where(F.col("jump").isNotNull())
        if live.isEmpty() or 1 << (len(tables) - 1) > most:
            return tables
        above = state.select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("jump").alias("next"), F.col("total").alias("more"), F.col("depth").alias("deeper")
        )
        longer = live.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("jump") == F.col("n"))).select(
            "tree", "node", F.col("next").alias("jump"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("deeper")).alias("depth")
        )
        tables.append(materialize(longer.unionByName(state.where(F.col("jump").isNull())), "chat-jumps"))


def format_reply_trees(
    nodes: DataFrame, branches: int | None = 1, template: ChatTemplate = ChatTemplate(), loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """``tree, branch, leaf, score, n_turns, formatted, loss_spans``: one row per chosen path.

    ``nodes`` has tree, node, parent, role, text, score. A branch's score is the mean over its nodes; the ``branches``
    best of each tree are kept (None: all), ties by the longer path, then the smaller leaf. ``loss_spans`` marks the texts of ``loss_roles``: (segment, start, length), where segments are what
    the end marks separate and starts are code points from 0.
    """
    first = F.min(F.struct("parent", "role", "text", "score"))
    tidy = nodes.select(
        "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    )
    tree = materialize(tidy.where(F.col("node").isNotNull()).groupBy("tree", "node").agg(first.alias("row")).select("tree", "node", "row.*"), "chat-nodes")
    jumps = _jumps(tree)
    done = jumps[-1].where(F.col("jump").isNull())
    parents = jumps[0].where(F.col("jump").isNotNull()).select(F.col("tree").alias("t"), F.col("jump").alias("p")).distinct()
    leaves = done.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti").select(
        "tree", F.col("node").alias("leaf"), (F.col("total") / F.col("depth")).alias("score"), "depth"
    )
    if branches is None:
        chosen = leaves.withColumn("branch", F.lit(None).cast("int"))
    else:
        best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "leaf")
        chosen = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    chosen = materialize(chosen, "chat-leaves")
    paths = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, table in enumerate(jumps[:-1]):
        step = table.where(F.col("jump").isNotNull()).select(F.col("tree").alias("t"), F.col("node").alias("n"), "jump")
        above = paths.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        paths = materialize(
            paths.unionByName(above.select("tree", "leaf", F.col("jump").alias("node"), (F.col("up") + (1 << k)).alias("up"))), "chat-paths"
        )
    texts = tree.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(
        "tree", "leaf", F.struct((-F.col("up")).alias("at"), "role", "text").alias("turn")
    )
    # A conversation is one value, however it is made.
    whole = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    head = len(template.begin) + len(template.middle)

    def span(turn, i):
        start = F.lit(head) + F.length(template.escape(turn["role"]))
        return F.struct(i.alias("segment"), start.alias("start"), F.length(template.escape(turn["text"])).alias("length"), turn["role"].isin(*loss_roles).alias("loss"))

    spans = F.filter(F.transform("turns", span), lambda s: s["loss"])
    formatted = F.array_join(F.transform("turns", lambda t: template.format(t["role"], t["text"])), "")
    rows = whole.select(
        F.col("tree").alias("t"),
        F.col("leaf").alias("l"),
        F.size("turns").cast("long").alias("n_turns"),
        formatted.alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["segment"].alias("segment"), s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
    )
    return chosen.join(rows, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).select(
        "tree", "branch", "leaf", "score", "n_turns", "formatted", "loss_spans"
    )


def read_conversations(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text``, both read from ``formatted`` and ``loss_spans`` and unescaped."""
    segments = F.split("formatted", re.escape(template.end), -1)

    def turn(segment):
        parts = F.split(segment, re.escape(template.middle), 2)
        role = F.substr(parts[0], F.lit(len(template.begin) + 1))
        return F.struct(template.unescape(role).alias("role"), template.unescape(parts[1]).alias("text"))

    cut = formatted.withColumn("segments", F.slice(segments, 1, F.size(segments) - 1))
    masked = F.transform("loss_spans", lambda s: template.unescape(F.substr(F.get("segments", s["segment"]), s["start"] + 1, s["length"])))
    return cut.withColumn("turns", F.transform("segments", turn)).withColumn("loss_text", F.array_join(masked, "")).drop("segments")


def linear_trees(rows: DataFrame, tree: str, order: str, role: str, text: str) -> DataFrame:
    """Plain conversations as trees: each row, by ``order`` (then role and text), replies to the one before."""
    by_turn = Window.partitionBy(tree).orderBy(order, role, text)
    numbered = rows.select(F.col(tree).alias("tree"), F.row_number().over(by_turn).alias("node"), F.col(role).alias("role"), F.col(text).alias("text"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
