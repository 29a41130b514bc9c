"""Chat formatting of reply trees, in DataFrame operations alone.

Messages point to the message they answer.  Self-joins by pointer doubling give
every message its root, its depth and the best score of a path below it, in a
number of joins that grows with the logarithm of the depth.  Each tree's best
leaf is taken, its path marked by the same jumps downward, and the path formatted
as one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm._base import written

#: Marks of a turn, and the sign put into texts to break a mark in them; doubling it keeps the escape reversible.
START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "\\"


def escaped(text: Column) -> Column:
    """Every escape sign doubled, then every '<|' broken by one."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit("<|"), F.lit(f"<{ESCAPE}|"))


def unescaped(text: Column) -> Column:
    """The text before escaped(): each single escape sign goes, each pair becomes one."""
    held = F.replace(text, F.lit(ESCAPE * 2), F.lit(ESCAPE + "\0"))
    return F.replace(F.replace(held, F.lit(f"<{ESCAPE}|"), F.lit("<|")), F.lit(ESCAPE + "\0"), F.lit(ESCAPE))


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From (tree, id, parent, score): jump tables (tree, id, up) of 1, 2, 4, ... steps, and (tree, id, root, depth, total).

    total is the sum of scores from the root down.  A cycle is cut at its smallest id, which becomes a root.
    """
    known = nodes.select(F.col("tree").alias("its_tree"), F.col("id").alias("known"))
    state = (
        nodes.join(known, (F.col("tree") == F.col("its_tree")) & (F.col("parent") == F.col("known")), "left")
        .select("tree", "id", F.col("known").alias("up"), F.col("score").alias("total"), F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"))
    )
    levels, bound = [], nodes.count()
    state = written(state, "jump")
    settled, active = state.where("up is null"), state.where("up is not null")
    while active.limit(1).count():
        if 1 << len(levels) > 2 * bound:  # no chain is that long
            return jumps(without_cycles(nodes, active))
        levels.append(active.select("tree", "id", "up"))
        below, above = active.alias("below"), settled.unionByName(active).alias("above")
        steps = F.lit(1 << (len(levels) - 1)).cast("long")
        moved = written(below.join(above, (F.col("below.tree") == F.col("above.tree")) & (F.col("below.up") == F.col("above.id"))).select(
            "below.tree", "below.id", F.col("above.up").alias("up"), (F.col("below.total") + F.col("above.total")).alias("total"),
            F.col("above.root").alias("root"), (steps + F.col("above.depth")).alias("depth"),
        ), "jump")
        settled, active = settled.unionByName(moved.where("up is null")), moved.where("up is not null")
    return levels, settled.drop("up")


def without_cycles(nodes: DataFrame, stuck: DataFrame) -> DataFrame:
    """Nodes with the parent of each cycle's smallest id made null; stuck holds at least all whose parents lead to a cycle, and no other.

    By doubled steps each of these learns the smallest id among all that its parents
    lead to: a cycle's smallest id alone finds itself.
    """
    of = ["tree", "id"]
    state = written(nodes.join(stuck.select(*of), of, "left_semi").select(*of, F.col("parent").alias("up"), F.col("parent").alias("low"), F.lit(True).alias("new")), "cycles")
    while state.where("new").limit(1).count():
        below, above = state.alias("below"), state.alias("above")
        least = F.least("below.low", "above.low")
        state = written(below.join(above, (F.col("below.tree") == F.col("above.tree")) & (F.col("below.up") == F.col("above.id"))).select("below.tree", "below.id", F.col("above.up").alias("up"), least.alias("low"), (least < F.col("below.low")).alias("new")), "cycles")
    cut = state.where("low = id").select(*of, F.lit(True).alias("cut"))
    return written(nodes.join(cut, of, "left").withColumn("parent", F.when(F.col("cut").isNull(), F.col("parent"))).drop("cut"), "nodes")


def best_paths(messages: DataFrame, *, branches: int = 1) -> DataFrame:
    """(tree, root, leaf, branch, branch_score, id, depth) of the chosen paths' messages.

    messages: tree, id, parent, score.  A branch's score is the mean score of its
    messages; ties go to the smaller leaf id.
    """
    nodes = written(messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "nodes")
    levels, placed = jumps(nodes)
    parents = levels[0].select("tree", F.col("up").alias("id")).distinct() if levels else nodes.select("tree", "id").where("false")
    rank = F.row_number().over(_by("tree", "root").orderBy(F.desc("branch_score"), "leaf"))
    chosen = (
        placed.join(parents, ["tree", "id"], "left_anti")
        .select("tree", "root", F.col("id").alias("leaf"), (F.col("total") / (F.col("depth") + 1)).alias("branch_score"))
        .withColumn("branch", rank).where(F.col("branch") <= branches)
    )
    path = chosen.select("tree", "leaf", F.col("leaf").alias("id"))
    for level in reversed(levels):  # distances are sums of different jumps, so each message comes once
        path = written(path.union(path.join(level, ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"))), "path")
    return chosen.join(path, ["tree", "leaf"]).join(placed.select("tree", "id", "depth"), ["tree", "id"])


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def format_conversations(messages: DataFrame, *, tree_col: str = "conv_id", id_col: str = "id", parent_col: str = "parent", role_col: str = "role", text_col: str = "text", score_col: str = "score", branches: int = 1, trained_role: str = "assistant") -> DataFrame:
    """One row for each chosen path: tree_col, root, leaf, branch, branch_score, n_turns, formatted, loss_spans.

    A message whose parent is null or unknown is a root, and so is the smallest
    id of a cycle; each root's best branches are formatted.  An empty table gives no
    rows.  Messages without a tree or an id belong to no
    conversation and are left out; of messages that share tree and id the
    smallest by (parent, role, text) stands.  Null roles and texts are empty,
    null scores 0.  formatted has, for each turn, the start mark, the role, a
    line end, the text, the end mark and a line end; marks inside roles and
    texts are escaped.  loss_spans are [start, length] in characters of
    formatted, one for each text of trained_role, empty texts included.
    """
    read = messages.select(
        F.col(f"`{tree_col}`").alias("tree"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{parent_col}`").alias("parent"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{score_col}`").alias("score"),
    ).where("tree is not null and id is not null")
    read = read.groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "id", "m.*")
    held = written(read, "messages")
    turn = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(ESCAPE + "n")), F.lit("\n"), F.col("escaped"), F.lit(f"{END}\n"))
    before = _by("tree", "leaf").orderBy("depth")
    return (
        best_paths(held, branches=branches).join(held.select("tree", "id", "role", "text"), ["tree", "id"])
        .withColumn("escaped", escaped(F.col("text"))).withColumn("turn", turn)
        .withColumn("ends", F.sum(F.length("turn")).over(before))
        .withColumn("span", F.when(F.col("role") == trained_role, F.struct(
            (F.col("ends") - F.length("escaped") - len(END) - 1).cast("long").alias("start"), F.length("escaped").cast("long").alias("length"))))
        .groupBy("tree", "leaf")
        .agg(F.first("root").alias("root"), F.first("branch").alias("branch"), F.first("branch_score").alias("branch_score"),
             F.sort_array(F.collect_list(F.struct("depth", "turn", "span"))).alias("turns"))
        .select(
            F.col("tree").alias(tree_col), "root", "leaf", "branch", "branch_score", F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
            F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        )
    )


def parsed_turns(formatted: Column) -> Column:
    """Array of (role, text), unescaped, from a formatted conversation."""
    parts = F.split(formatted, "<\\|im_end\\|>\n", -1)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def read(part: Column) -> Column:
        body = F.substring(part, len(START) + 1, 2147483647)
        at = F.instr(body, "\n")
        role = F.substr(body, F.lit(1), at - 1)
        held = F.replace(F.replace(role, F.lit(ESCAPE * 2), F.lit(ESCAPE + "\0")), F.lit(ESCAPE + "n"), F.lit("\n"))
        role = F.replace(F.replace(held, F.lit(f"<{ESCAPE}|"), F.lit("<|")), F.lit(ESCAPE + "\0"), F.lit(ESCAPE))
        return F.struct(role.alias("role"), unescaped(F.substr(body, at + 1)).alias("text"))

    return F.transform(whole, read)


def trained_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss_spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
