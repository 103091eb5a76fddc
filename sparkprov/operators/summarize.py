"""Summaries of a graph: groups by attributes, refined by topology."""

from __future__ import annotations

import inspect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut, drop


def refine(groups: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """Split groups (id, g) until the members of each have edges to the same groups: (groups, rounds).

    Each round all groups split at once.  The set of groups a node reaches is held as its size and 128 bits of exclusive ors of
    hashes, grouped partially before the shuffle; the coarsest stable partition is unique, so the order of splits is no matter.
    """
    groups = cut(groups.select("id", F.sha1(F.col("g").cast("string")).alias("g")), "refine")
    edges = cut(edges.select("src", "dst").distinct(), "refine-edges")
    n, rounds = groups.select("g").distinct().count(), 0
    while True:
        reach = edges.join(groups.withColumnRenamed("id", "dst"), "dst").select("src", "g").distinct()
        marks = [F.bit_xor(F.xxhash64(F.lit(salt), "g")).cast("string") for salt in range(2)]
        sign = reach.groupBy(F.col("src").alias("id")).agg(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *marks).alias("sign"))
        after = cut(groups.join(sign, "id", "left").select("id", F.sha1(F.concat_ws("|", "g", F.coalesce("sign", F.lit("")))).alias("g")), "refine")
        drop(groups)
        groups = after
        rounds += 1
        m = groups.select("g").distinct().count()
        if m == n:
            drop(edges)
            return groups, rounds
        n = m


def _cell(x, nodes: DataFrame, edges: DataFrame | None) -> Column | DataFrame:
    """What one entry of a group key takes: an attribute's value, or what a callable gives."""
    if not callable(x):
        return F.col("attrs")[x]["value"]
    several = sum(p.default is p.empty for p in inspect.signature(x).parameters.values()) > 1
    return x(nodes, edges) if several else x(nodes)


def group_key(
    nodes: DataFrame, attributes: dict[str, tuple], use_function_parameters: bool = True, edges: DataFrame | None = None
) -> DataFrame:
    """(id, g): label, then parameter values in order of name for functions, else the chosen attributes; missing is null.

    A callable takes the nodes, or nodes and edges so that it can look at neighbours.  It gives a Column of the nodes, or
    a DataFrame (id, value) of at most one row a node, which is joined.
    """
    held, more = nodes, 0
    key: Column = F.lit(None).cast("array<string>")
    for label, names in attributes.items():
        cells = []
        for x in (names,) if isinstance(names, str) or callable(names) else names:
            c = _cell(x, nodes, edges)
            if isinstance(c, DataFrame):
                name, more = f"_key{more}", more + 1
                held = held.join(c.select("id", F.col("value").cast("string").alias(name)), "id", "left")
                c = F.col(name)
            cells.append(c.cast("string"))
        key = F.when(F.col("label") == label, F.array(*cells)).otherwise(key)
    if use_function_parameters:
        params = F.transform(F.array_sort(F.map_keys("params")), lambda k: F.col("params")[k]["value"])
        key = F.when(F.col("type") == "function", params).otherwise(key)
    whole = F.struct("label", F.coalesce(key, F.array().cast("array<string>")).alias("key"))
    return held.select("id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("g"))


def joined_values(value: Column, num: Column) -> Column:
    """Distinct values joined by ;, numbers in order of number and others in order of text."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(num.alias("num"), value.alias("value")))), lambda x: x["value"]), ";")


def merge_intervals(text: Column) -> Column:
    """The intervals of a ;-joined text of them, brackets < > and repeats allowed, as one text: sorted as text."""
    pieces = F.filter(F.split(F.translate(text, "<>", ""), ";"), lambda x: x != "")
    return F.concat(F.lit("<"), F.array_join(F.array_sort(pieces), ";"), F.lit(">"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Rows with their place (long, from 0) in the order of a column without repeats.

    Rows are sorted by range; a place is the place within the range plus the ranges' sizes before, one row a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(parts, order).sortWithinPartitions(order)
    sorted_ = cut(sorted_.withColumn("_range", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND((1 << 33) - 1)), "numbered")
    before = F.sum("n").over(Window.orderBy("_range")) - F.col("n")
    sizes = sorted_.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", before.alias("_before"))
    return sorted_.join(F.broadcast(sizes), "_range").withColumn("place", F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def values(nodes: DataFrame, groups: DataFrame, left_out=()) -> DataFrame:
    """(g, name, value, num): the distinct values of each group's members, a row each; however many, no row holds them all."""

    def entry(name, value: Column, num: Column) -> Column:
        return F.struct(name.alias("name"), value.alias("value"), num.alias("num"))

    none = F.lit(None).cast("double")
    fixed = [c for c in ("type", "label", "python_name", "data_hash", "hash_type", "execution_id", "execution_order") if c in nodes.columns]
    fixed = [entry(F.lit(c), F.col(c).cast("string"), F.col(c).cast("double") if c == "execution_order" else none) for c in fixed]
    own = F.transform(F.map_entries("attrs"), lambda e: entry(e["key"], e["value"]["value"], e["value"]["num"]))
    rows = nodes.select("id", F.explode(F.concat(F.array(*fixed), own)).alias("c")).select("id", "c.*")
    rows = rows.where(F.col("value").isNotNull() & ~F.col("name").isin(list(left_out)))
    return rows.join(groups, "id").select("g", "name", "value", "num").distinct()


def aggregate(
    nodes: DataFrame,
    edges: DataFrame,
    attributes: dict[str, tuple],
    use_function_parameters: bool = True,
    remove_attributes=None,
    record_members: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(summary nodes (id, attrs, member_count, members), summary edges (src, dst)).

    A callable in ``attributes`` takes the nodes DataFrame (and the edges, if it has a second parameter) and gives a
    Column of the nodes, or rows (id, value).  Steps are numbered by least member id.
    """
    left_out = [remove_attributes] if isinstance(remove_attributes, str) else list(remove_attributes or ())
    groups, _ = refine(group_key(nodes, attributes, use_function_parameters, edges), edges)
    listed = [F.array_join(F.array_sort(F.collect_set("id")), ";").alias("members")] if record_members else []
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("member_count"), F.min("id").alias("least"), *listed)
    steps = cut(numbered(sizes, "least").withColumn("step", F.concat(F.lit("Step "), "place")).drop("least", "place"), "steps")
    joined = values(nodes, groups, left_out).groupBy("g", "name").agg(joined_values(F.col("value"), F.col("num")).alias("value"))
    joined = joined.withColumn("value", F.when(F.col("name") == "Time Interval", merge_intervals(F.col("value"))).otherwise(F.col("value")))
    attrs = joined.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("attrs"))
    out = steps.join(attrs, "g", "left").select(F.col("step").alias("id"), "attrs", "member_count", *(["members"] if record_members else []))
    at = groups.join(steps.select("g", "step"), "g").select("id", "step")
    ends = edges.join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst")
    return out, ends.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
