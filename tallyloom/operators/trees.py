"""Trees given as (id, parent_id) links, of any depth, by doubling links: log2(depth) joins, no limit on depth or rows.

A parent that is no id of the table counts as none. Repeated links count once; an id with two parents is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.scratch import dropped, kept


NEAR = 64  # nodes at most of one row of `paths`


def links(tree: DataFrame, id_: str = "id", parent: str = "parent_id") -> tuple[DataFrame, DataFrame]:
    """(id, node; node, up): nodes numbered in the order of their ids, and one row for each with its parent, null at the top.

    Rounds move numbers, of 8 bytes, not ids. The tree is read once.
    """
    t = kept(tree.select(F.col(id_).alias("id"), F.col(parent).alias("up")).where("id is not null").distinct(), "links")
    twice = t.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].id} has several parents")
    nodes = kept(t.repartitionByRange("id").sortWithinPartitions("id").withColumn("node", F.monotonically_increasing_id()), "nodes")
    dropped(t)
    known = nodes.select(F.col("id").alias("__k"), F.col("node").alias("__n"))
    return nodes.select("id", "node"), kept(nodes.join(known, F.col("up") == F.col("__k"), "left").select("node", F.col("__n").alias("up")), "links")


def _until(state: DataFrame, ends: Column) -> tuple[DataFrame, DataFrame]:
    """(ended, lost) of (node, up, steps): in each round, rows that have not ended follow the link of where they are.

    Rows that have ended are not written again. Lost are those in cycles, or below: more steps than rows would not end them.
    """
    state = kept(state, "links")
    n, reach, ended, moving = state.count(), 1, state.where(ends), state.where(~ends)
    while reach <= 2 * n and moving.limit(1).count():
        far = ended.unionByName(moving).select(F.col("node").alias("__n"), F.col("up").alias("__u"), F.col("steps").alias("__s"))
        new = kept(moving.join(far, F.col("up") == F.col("__n")).select("node", F.col("__u").alias("up"), (F.col("steps") + F.col("__s")).alias("steps")), "links")
        ended, moving, reach = ended.unionByName(new.where(ends)), new.where(~ends), 2 * reach
    return ended, moving


def summed(tree_links: DataFrame, weight: Column) -> tuple[DataFrame, DataFrame]:
    """((node, steps), (node)): the sum of weight from each node's top down to it; the nodes without a top. weight: of (node, up, ..)."""
    done, lost = _until(tree_links.select("node", "up", weight.cast("long").alias("steps")), F.col("up").isNull())
    return done.select("node", "steps"), lost.select("node")


def descend(tree: DataFrame, root, id_: str = "id", parent: str = "parent_id") -> DataFrame:
    """root and everything below it: id, depth (0: root). An unknown root gives no rows; a cycle elsewhere does no harm.

    A root inside a cycle heads what hangs below it: links end where they reach it.
    """
    names, state = links(tree, id_, parent)
    found = names.where(F.col("id") == F.lit(root)).collect()
    top = F.lit(found[0].node if found else None).cast("long")
    is_root = F.coalesce(F.col("node") == top, F.lit(False))
    steps = F.when(is_root | F.col("up").isNull(), 0).otherwise(1).cast("long")
    # a link that reaches the root stays there, one that reaches another top ends as null
    ends = F.col("up").isNull() | F.coalesce(F.col("up") == top, F.lit(False))
    done, _ = _until(state.select("node", F.when(is_root, top).otherwise(F.col("up")).alias("up"), steps.alias("steps")), ends)
    return done.where(F.col("up") == top).join(names, "node").select("id", F.col("steps").alias("depth"))


def cycles(tree: DataFrame, id_: str = "id", parent: str = "parent_id") -> DataFrame:
    """id of every node that has no top: on a cycle, or below one."""
    names, tree_links = links(tree, id_, parent)
    return names.join(summed(tree_links, F.lit(1))[1], "node", "left_semi").select("id")


def _lines(tree_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, top, steps; top, up): lines of nodes that go on from parent to child, each node in one; the top's own parent.

    A parent's line goes on with one child, by preference one with most children. steps: from the line's top down to the
    node. A line that is a whole cycle has no top, and its nodes no rows.
    """
    below = tree_links.where("up is not null").groupBy("up").agg(F.count("*").alias("__below")).withColumnRenamed("up", "node")
    heirs = tree_links.where("up is not null").join(below, "node", "left").groupBy("up").agg(F.max(F.struct(F.coalesce("__below", F.lit(0)).alias("b"), "node"))["node"].alias("node"))
    state = kept(tree_links.join(heirs.select("node", F.lit(True).alias("on")), "node", "left"), "heirs")
    # a line's top is where its nodes end: below 0, -1 - top
    up, steps = F.when(F.col("on"), F.col("up")).otherwise(-1 - F.col("node")), F.when(F.col("on"), 1).otherwise(0).cast("long")
    done, _ = _until(state.select("node", up.alias("up"), steps.alias("steps")), F.col("up") < 0)
    return done.select("node", (-1 - F.col("up")).alias("top"), "steps"), state.where("on is null").select(F.col("node").alias("top"), "up")


def paths(tree: DataFrame, id_: str = "id", parent: str = "parent_id", of: Column | None = None) -> DataFrame:
    """id, depth, ancestor: one row for each node and each node on its way from the top (depth 0) to itself.

    of: which ids are asked for (all). Nodes without a top, on a cycle or below one, have no rows: see `cycles`.
    Lines of nodes are cut into pieces of NEAR, each with the ids of its own nodes, so an id is written once. The ids asked
    for of a piece go as one row to each piece above it, and are multiplied there. What is shuffled is a row for each two
    pieces of a way, and the result never.
    """
    tree = tree if of is None else kept(tree, "tree")
    names, tree_links = links(tree, id_, parent)
    lines, tops = _lines(tree_links)
    above = lines.select(F.col("node").alias("up"), F.col("top").alias("__t"), F.col("steps").alias("__s"))
    # a top without a parent, or with one in a line; a parent in no line is on a cycle
    forest = kept(tops.join(above, "up", "left").where("up is null or __t is not null").select(F.col("top").alias("node"), F.col("__t").alias("up"), F.coalesce(F.col("__s") + 1, F.lit(0)).cast("long").alias("steps")), "forest")
    ended = _until(forest, F.col("up").isNull())[0]
    deep = kept(ended.select(F.col("node").alias("top"), F.col("steps").alias("from")), "depths")

    marks = [] if of is None else ["mine"]  # which ids of a piece are asked for
    asked = names if of is None else names.join(tree.where(of).select(F.col(id_).alias("id"), F.lit(True).alias("mine")).distinct(), "id", "left").fillna(False, "mine")
    one = lines.join(asked, "node").select("top", F.expr(f"steps div {NEAR}").alias("k"), "steps", "id", *marks)
    whole = one.repartition("top", "k").groupBy("top", "k").agg(F.array_sort(F.collect_list(F.struct("steps", "id", *marks))).alias("x"))
    pieces = kept(whole.join(deep, "top").select("top", "k", (F.col("from") + F.col("k") * NEAR).alias("from"), *[F.col(f"x.{c}").alias(c) for c in ("id", *marks)]).withColumnRenamed("id", "ids"), "pieces")

    # the lines above each line, and the place on them where its way goes up
    jumps = kept(forest.join(deep.select(F.col("top").alias("node")), "node", "left_semi").where("up is not null").select(F.col("node").alias("__n"), "up", (F.col("steps") - 1).alias("upto")), "jumps")
    found = jumps.select(F.col("__n").alias("top"), F.col("up").alias("at"), "upto")
    for done in (names, tree_links, lines, tops, forest, ended, deep):  # numbers and ids, all of them written here
        dropped(done)
    while jumps.limit(1).count():
        more = kept(found.join(jumps.withColumnRenamed("upto", "__upto"), F.col("at") == F.col("__n")).select("top", F.col("up").alias("at"), F.col("__upto").alias("upto")), "found")
        far = jumps.select(F.col("__n").alias("__f"), F.col("up").alias("__u"), F.col("upto").alias("__upto"))
        jumps = kept(jumps.join(far, F.col("up") == F.col("__f")).select("__n", F.col("__u").alias("up"), F.col("__upto").alias("upto")), "jumps")
        found = found.unionByName(more)

    who = F.col("ids") if of is None else F.filter("ids", lambda _, i: F.get("mine", i))
    some = pieces.select("top", "k", who.alias("who")).where(F.size("who") > 0)
    own = some.where("k > 0").select("who", F.col("top").alias("at"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"), F.lit(NEAR).cast("long").alias("m"))
    up = some.join(found, "top").select("who", "at", "upto", F.explode(F.expr(f"sequence(0, upto div {NEAR})")).alias("j"))
    up = up.select("who", "at", "j", F.least(F.lit(NEAR).cast("long"), F.col("upto") + 1 - F.col("j") * NEAR).alias("m"))
    there = pieces.select(F.col("top").alias("at"), F.col("k").alias("j"), "from", "ids")
    far = own.unionByName(up).join(there, ["at", "j"]).select(F.explode("who").alias("id"), "from", F.slice("ids", 1, F.col("m").cast("int")).alias("ids"))
    near = pieces.select(F.posexplode("ids").alias("i", "id"), "from", "ids", *marks)
    near = (near if of is None else near.where(F.get("mine", F.col("i")))).select("id", "from", F.slice("ids", 1, F.col("i") + 1).alias("ids"))
    rows = near.unionByName(far).select("id", "from", F.posexplode("ids").alias("__i", "ancestor"))
    return rows.select("id", (F.col("from") + F.col("__i")).alias("depth"), "ancestor")


def sizes(tree_links: DataFrame) -> DataFrame:
    """node, size: how many nodes each node and what is below it are; of nodes without a top, any number."""
    out, n, reach = kept(tree_links.select("node", F.lit(1).cast("long").alias("size")), "sizes"), tree_links.count(), 1
    jumps = kept(tree_links.where("up is not null"), "jumps")
    while reach <= 2 * n and jumps.limit(1).count():
        below = jumps.join(out, "node").groupBy("up").agg(F.sum("size").alias("__more")).withColumnRenamed("up", "node")
        new = kept(out.join(below, "node", "left").select("node", (F.col("size") + F.coalesce("__more", F.lit(0))).alias("size")), "sizes")
        far = jumps.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
        jumped = kept(jumps.join(far, F.col("up") == F.col("__n")).select("node", F.col("__u").alias("up")), "jumps")
        dropped(out)
        dropped(jumps)
        out, jumps, reach = new, jumped, 2 * reach
    return out


def running(df: DataFrame, scope: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """Adds name: the sum of weight (a bigint) up to and with each row, in order within each scope. Rows are dealt by ranges of
    (scope, order), summed by range, and each range goes on from the ones before it: no task holds a scope. Order must be
    unique within a scope."""
    dealt = kept(df.withColumn("__w", weight.cast("long")).repartitionByRange(*scope, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    whole = dealt.groupBy(*scope, "__part").agg(F.sum("__w").alias("__sum"))
    upto = Window.partitionBy(*scope).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = whole.select(*scope, "__part", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__before"))
    k = F.sum("__w").over(Window.partitionBy(*scope, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*scope, "__part")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    j = dealt.withColumn("__k", k).alias("a").join(before.alias("b"), on)
    return j.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("b.__before") + F.col("a.__k")).cast("long").alias(name))


def numbered(df: DataFrame, scope: list[str], order: list[str], name: str) -> DataFrame:
    """Adds name: 1, 2, .. in order within each scope, by ranges as `running` sums. Order must be unique within a scope."""
    return running(df, scope, order, F.lit(1), name)
