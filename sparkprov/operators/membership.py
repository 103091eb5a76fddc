"""Operators over memberships: closure, condensing, time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut


def closure(memberships: DataFrame) -> DataFrame:
    """(top, node): each container with all it holds, however deep; path lengths double each round."""
    known = cut(memberships.select(F.col("src").alias("top"), F.col("dst").alias("node")).distinct(), "closure")
    n = known.count()
    while True:
        step = known.select(F.col("top").alias("node"), F.col("node").alias("below"))
        known = cut(known.union(known.join(step, "node").select("top", F.col("below").alias("node"))).distinct(), "closure")
        if (m := known.count()) == n:
            return known
        n = m


def condense(nodes: DataFrame, edges: DataFrame, preserve=()) -> tuple[DataFrame, DataFrame]:
    """Graph without members that no function uses and whose label isn't preserved; paths through them become edges
    with joined labels.  A member of several containers connects to each; of parallel paths the least label stays."""
    functions = nodes.where("type = 'function'").select(F.col("id").alias("dst"))
    feeding = edges.join(functions, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    gone = edges.where("membership").select(F.col("dst").alias("id")).distinct().join(feeding, "id", "left_anti")
    if preserve:
        gone = gone.join(nodes.where(F.col("label").isin(list(preserve))).select("id"), "id", "left_anti")
    gone = cut(gone, "condense-gone")
    edges = cut(edges, "condense-edges")
    flag = gone.select(F.col("id").alias("dst"), F.lit(True).alias("out"))
    front = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(flag, "dst")
    front = cut(front.select("src", F.col("dst").alias("via"), F.coalesce("label", F.lit("")).alias("label")), "condense-front")
    found = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    found = found.select("src", "dst", "membership", "label")
    inner = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").join(flag, "dst", "left")
    next_ = F.coalesce("label", F.lit("")).alias("next")
    inner = cut(inner.select(F.col("src").alias("via"), "dst", next_, F.coalesce("out", F.lit(False)).alias("out")), "condense-inner")
    most, rounds = gone.count(), 0
    while not front.isEmpty():
        if (rounds := rounds + 1) > most:  # a path without repeats has no more steps
            raise ValueError("memberships form a cycle")
        on = front.join(inner, "via").select("src", "dst", F.concat("label", "next").alias("label"), "out")
        found = found.unionByName(on.where("NOT out").select("src", "dst", F.lit(True).alias("membership"), "label"))
        front = cut(on.where("out").select("src", F.col("dst").alias("via"), "label").distinct(), "condense-front")
    edges = found.groupBy("src", "dst").agg(F.min("membership").alias("membership"), F.min("label").alias("label"))
    return nodes.join(gone, "id", "left_anti"), edges


def subgraph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that stand in a membership, and all edges between them."""
    held = edges.where("membership")
    ids = held.select(F.col("src").alias("id")).union(held.select("dst")).distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside.select(*edges.columns)


def levels(tops: DataFrame, memberships: DataFrame, depth: int) -> DataFrame:
    """(top, node, level): what containers (id) hold, level by level to ``depth``; level 0 is the container itself."""
    at = tops.select(F.col("id").alias("top"), F.col("id").alias("node"), F.lit(0).alias("level"))
    below = memberships.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    out = at
    for n in range(1, depth + 1):
        at = at.join(below, "node").select("top", F.col("next").alias("node"), F.lit(n).alias("level"))
        out = out.unionByName(at)
    return out


def interval_text(orders) -> F.Column:
    """<[a,a];[b,b]> of an array of execution orders."""
    piece = F.transform(F.array_sort(orders), lambda x: F.format_string("[%.1f,%.1f]", x.cast("double"), x.cast("double")))
    return F.concat(F.lit("<"), F.array_join(piece, ";"), F.lit(">"))


def interval_rows(touches: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, execution_order): a node's own executions; containers that have none get those of all they hold."""
    held = edges.where("membership")
    inherited = closure(held).join(touches.withColumnRenamed("id", "node"), "node").select(F.col("top").alias("id"), "execution_order")
    return touches.unionByName(inherited.join(touches.select("id").distinct(), "id", "left_anti"))


def intervals(touches: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, orders): the same with a node's executions in one row, as its text needs them."""
    return interval_rows(touches, edges).groupBy("id").agg(F.array_sort(F.collect_list("execution_order")).alias("orders"))
