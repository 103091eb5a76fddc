"""Triples to a property graph: nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urns import activity_info, entity_info, membership_label
from ..plans.tables import cut

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
NONE = "builtins.NoneType"
ATTRS = "map<string,struct<value:string,num:double>>"


def local_name(p: Column | str) -> Column:
    """What follows the last # or / of a predicate: the ontology's own namespace doesn't matter."""
    return F.substring_index(F.substring_index(p, "#", -1), "/", -1)


def is_none(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).contains(NONE)


def pairs(t: DataFrame, relation: str) -> DataFrame:
    """(id, name, value, num): name/value nodes of a relation, both literals found in one grouping, no self-join."""
    value = F.col("l") == "pairValue"
    numeric = F.col("o_datatype").rlike("#(integer|double|decimal|float|int|long)$")
    both = t.where(F.col("l").isin("pairName", "pairValue")).groupBy(F.col("s").alias("pair")).agg(
        F.max(F.when(~value, F.col("o"))).alias("name"),
        F.max(F.when(value, F.col("o"))).alias("value"),
        F.max(F.when(value & numeric, F.col("o").try_cast("double"))).alias("num"),
    )
    owners = t.where(F.col("l") == relation).select(F.col("s").alias("id"), F.col("o").alias("pair"))
    return owners.join(both, "pair").select("id", "name", "value", "num", "pair")


def conflicts(rows: DataFrame) -> DataFrame:
    """(id, name) with several values."""
    return rows.groupBy("id", "name").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def attribute_map(rows: DataFrame) -> DataFrame:
    """(id, attrs); several values of one name are an error."""
    one = rows.groupBy("id", "name").agg(F.min("value").alias("value"), F.max("value").alias("other"), F.min("num").alias("num"))
    name = F.when(F.col("value") != F.col("other"), F.raise_error(F.lit("Several values of one attribute; keep the namespaces apart"))).otherwise(F.col("name"))
    entries = F.collect_list(F.struct("name", F.struct("value", "num").alias("v")))
    return one.withColumn("name", name).groupBy("id").agg(F.map_from_entries(entries).alias("attrs"))


def place(pair: Column | str) -> Column:
    """A pair's place among its owner's, which blank nodes of recorded histories carry as their third part; null for others."""
    return F.regexp_extract(pair, r"\.(?:hasParameter|hasAttribute|hasAnnotation)\.(\d+)\.", 1).try_cast("long")


def last_wins(rows: DataFrame) -> DataFrame:
    """(id, name, value, num): of several values of one name the last stays, by the pair's place, then by the pair."""
    best = F.max_by(F.struct("value", "num"), F.struct(F.coalesce(place("pair"), F.lit(-1)), "pair"))
    return rows.groupBy("id", "name").agg(best.alias("v")).select("id", "name", "v.value", "v.num")


def chosen(rows: DataFrame, names) -> DataFrame:
    return rows if names == "all" else rows.where(F.col("name").isin(list(names)))


#: The relations that each part of a graph is built from.
PARTS = {
    "entities": ("type", "filePath"),
    "functions": ("wasGeneratedBy", "executionOrder", "usedFunction", "functionName"),
    "parameters": ("hasParameter", "pairName", "pairValue"),
    "edges": ("used", "wasGeneratedBy", "hadMember", "containerIndex", "containerSlice", "fromAttribute"),
    "touches": ("used", "wasGeneratedBy", "executionOrder"),
}
NODES = ("entities", "functions", "parameters")


def needed(parts, annotations=None, attributes=None, value_attribute: str | None = None) -> list[str]:
    """The relations that ``build`` reads for these parts ("nodes" are entities, functions and parameters)."""
    found = {r for p in parts for part in (NODES if p == "nodes" else (p,)) for r in PARTS[part]}
    if "type" in found:
        for relation, asked in (("hasAttribute", attributes), ("hasAnnotation", annotations)):
            found |= {relation, "pairName", "pairValue"} if asked else set()
        found |= {"value"} if value_attribute else set()
    return sorted(found)


def build(
    triples: DataFrame,
    annotations=None,
    attributes=None,
    strip_namespace: bool = True,
    remove_none: bool = True,
    use_name_in_parameter: bool = True,
    use_class_in_method_name: bool = True,
    value_attribute: str | None = None,
    drop_falsy: bool = False,
    parts=("nodes", "edges", "touches"),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, touches): touches are (id, execution_order) of all a function execution reaches, for intervals.

    Nothing that isn't asked for is in the plan: without attributes and annotations their pairs are never joined.
    ``drop_falsy`` leaves out stored values 0, false and "".  Of ``parts`` ("nodes" are "entities", "functions" and their
    "parameters") those that aren't named are empty.
    """
    wanted = needed(parts, annotations, attributes, value_attribute)
    is_entity = (F.col("p") == RDF_TYPE) & local_name("o").isin("DataObjectEntity", "FileEntity")
    t = triples.select("s", "p", "o", "o_datatype", local_name("p").alias("l")).where(F.col("l").isin(*wanted) & ((F.col("l") != "type") | is_entity))
    t = cut(t, "build-triples", by="l")  # the source is read once, each part of the graph reads its relations alone
    parts = {x for p in parts for x in (NODES if p == "nodes" else (p,))}

    def keep(rows: DataFrame, column: str) -> DataFrame:
        return rows.where(~is_none(column)) if remove_none else rows

    ids = keep(t.where(F.col("l") == "type").select(F.col("s").alias("id")).distinct(), "id")
    wanted = []
    for relation, names, prefix in (("hasAttribute", attributes, "attribute"), ("hasAnnotation", annotations, "annotation")):
        if names:
            rows = chosen(pairs(t, relation), names).drop("pair")
            wanted.append(rows if strip_namespace else rows.withColumn("name", F.concat(F.lit(prefix + ":"), "name")))
    if value_attribute:
        stored = t.where(F.col("p") == "http://www.w3.org/ns/prov#value")
        if drop_falsy:
            stored = stored.where(~F.col("o").isin("", "0", "false", "0.0"))
        num = F.when(F.col("o_datatype").rlike("#(integer|double)$"), F.col("o").try_cast("double"))
        wanted.append(stored.select(F.col("s").alias("id"), F.lit(value_attribute).alias("name"), F.col("o").alias("value"), num.alias("num")))
    paths = t.where(F.col("l") == "filePath")
    wanted.append(paths.select(F.col("s").alias("id"), F.lit("File_path").alias("name"), F.col("o").alias("value"), F.lit(None).cast("double").alias("num")))
    rows = wanted[0]
    for w in wanted[1:]:
        rows = rows.unionByName(w)
    info = entity_info("id")
    empty = F.from_json(F.lit("{}"), ATTRS)
    none = F.lit(None)
    entities = ids.join(attribute_map(rows), "id", "left").select(
        "id",
        *(info[k].alias(k) for k in ("type", "label", "python_name", "data_hash", "hash_type")),
        none.cast("string").alias("execution_id"),
        none.cast("long").alias("execution_order"),
        F.coalesce("attrs", empty).alias("attrs"),
        empty.alias("params"),
    )

    made = t.where(F.col("l") == "wasGeneratedBy").select(F.col("s").alias("entity"), F.col("o").alias("exec"))
    execs = made.select("exec").distinct()
    order = t.where(F.col("l") == "executionOrder").select(F.col("s").alias("exec"), F.col("o").cast("long").alias("execution_order"))
    name = t.where(F.col("l") == "functionName").select(F.col("s").alias("fn"), F.col("o").alias("function_name"))
    name = t.where(F.col("l") == "usedFunction").select(F.col("s").alias("exec"), F.col("o").alias("fn")).join(name, "fn").select("exec", "function_name")
    label = F.col("function_name") if use_class_in_method_name else F.element_at(F.split("function_name", r"\."), -1)
    act = activity_info("exec")
    functions = execs.join(order, "exec", "left").join(name, "exec", "left").withColumn("label", label)
    if "parameters" in parts:
        params = last_wins(pairs(t, "hasParameter")).groupBy("id")
        params = params.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("value", "num").alias("v")))).alias("p"))
        functions = functions.join(params.withColumnRenamed("id", "exec"), "exec", "left").withColumn("p", F.coalesce("p", empty))
    else:
        functions = functions.withColumn("p", empty)
    prefix = F.col("label") if use_name_in_parameter else F.lit("parameter")
    functions = functions.select(
        F.col("exec").alias("id"),
        act["type"].alias("type"),
        "label",
        act["python_name"].alias("python_name"),
        none.cast("string").alias("data_hash"),
        none.cast("string").alias("hash_type"),
        act["execution_id"].alias("execution_id"),
        "execution_order",
        F.transform_keys("p", lambda k, _: F.concat(prefix, F.lit(":"), k)).alias("attrs"),
        F.col("p").alias("params"),
    )
    found = [rows for part, rows in (("entities", entities), ("functions", functions)) if part in parts]
    nodes = found[0].unionByName(found[1]) if len(found) > 1 else found[0] if found else entities.limit(0)

    used = t.where(F.col("l") == "used").select(F.col("s").alias("exec"), F.col("o").alias("entity")).join(execs, "exec", "left_semi")
    part = t.where(F.col("l").isin("containerIndex", "containerSlice", "fromAttribute"))
    part = part.select(F.col("s").alias("member"), membership_label(F.when(F.col("l") == "fromAttribute", "attribute").otherwise("index"), "o").alias("label"))
    member = part.groupBy("member").agg(F.min("label").alias("label"))
    held = t.where(F.col("l") == "hadMember").select(F.col("s").alias("src"), F.col("o").alias("member")).join(member, "member", "left")
    label = F.coalesce("label", F.raise_error(F.lit("membership without a label")))
    held = held.select("src", F.col("member").alias("dst"), F.lit(True).alias("membership"), label.alias("label"))
    into = keep(used.select(F.col("entity").alias("src"), F.col("exec").alias("dst")), "src")
    out_of = keep(made.select(F.col("exec").alias("src"), F.col("entity").alias("dst")), "dst")
    plain = into.union(out_of).distinct()
    edges = plain.select("src", "dst", F.lit(False).alias("membership"), none.cast("string").alias("label")).unionByName(held)
    ordered = made.join(order, "exec")
    touches = ordered.select(F.col("exec").alias("id"), "execution_order")
    touches = touches.unionByName(ordered.select(F.col("entity").alias("id"), "execution_order"))
    reads = used.select("exec", F.col("entity").alias("id"))
    touches = touches.unionByName(ordered.select("exec", "execution_order").join(reads, "exec").select("id", "execution_order"))
    return nodes, edges if "edges" in parts else edges.limit(0), keep(touches, "id") if "touches" in parts else touches.limit(0)
