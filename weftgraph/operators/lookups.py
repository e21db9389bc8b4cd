"""Lookups around nodes. All take many nodes at once: a DataFrame of ids, of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import ENTRY_TYPES, class_of, file_role, framework_noise, visible_call
from weftgraph.model import CodeGraph
from weftgraph.sources.graphs import top_per_group


def find_nodes(graph: CodeGraph, ids: DataFrame) -> DataFrame:
    """Rows of the nodes asked for."""
    return graph.nodes.join(ids.select("id"), "id", "left_semi").select("id", "type", "name", "parent", "file", "start_row", "end_row")


def incoming_calls(graph: CodeGraph, ids: DataFrame, limit: int = 20, include_resolved: bool = False) -> DataFrame:
    """(id, from_id, file, call_type, via): the first `limit` visible calls of each id whose caller is a node."""
    e = graph.edges.where(visible_call(include_resolved)).join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    callers = graph.nodes.select(F.col("id").alias("from_id"), "file")
    found = e.join(callers, "from_id").select(F.col("to_id").alias("id"), "from_id", "file", "call_type", "via", F.col("id").alias("edge_id"))
    return top_per_group(found, ["id"], ["from_id", "edge_id"], limit)


def outgoing_calls(graph: CodeGraph, ids: DataFrame, limit: int = 20, include_resolved: bool = False) -> DataFrame:
    """(id, to_id, file, call_type, via): the first `limit` visible calls by each id whose callee is a node."""
    e = graph.edges.where(visible_call(include_resolved)).join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    callees = graph.nodes.select(F.col("id").alias("to_id"), "file")
    found = e.join(callees, "to_id").select(F.col("from_id").alias("id"), "to_id", "file", "call_type", "via", F.col("id").alias("edge_id"))
    return top_per_group(found, ["id"], ["to_id", "edge_id"], limit)


def depends_on(graph: CodeGraph, ids: DataFrame, limit: int = 20) -> DataFrame:
    """(id, direction, other, type, file): dependencies either way; the other end need not be a node."""
    e = graph.edges.where(F.col("type") == "DEPENDS_ON").select("from_id", "to_id")
    nodes = graph.nodes.select(F.col("id").alias("other"), F.col("type"), "file")
    parts = []
    for direction, own, other in (("outgoing", "from_id", "to_id"), ("incoming", "to_id", "from_id")):
        some = e.join(ids.select(F.col("id").alias(own)), own, "left_semi").select(F.col(own).alias("id"), F.lit(direction).alias("direction"), F.col(other).alias("other"))
        parts.append(top_per_group(some.join(nodes, "other", "left"), ["id"], ["other"], limit))
    return parts[0].unionByName(parts[1]).select("id", "direction", "other", "type", "file")


def methods_by_parent(graph: CodeGraph, parents: DataFrame) -> DataFrame:
    """(parent, id, name, visibility) of the methods of each class."""
    m = graph.nodes.where(F.col("type") == "method")
    return m.join(parents.select(F.col("id").alias("parent")), "parent", "left_semi").select("parent", "id", "name", "visibility")


def incoming_entries(graph: CodeGraph, ids: DataFrame, limit: int = 20) -> DataFrame:
    """(id, kind, from_id): calls, then routes, then view actions, cut at `limit` for each id."""
    kind = F.when(F.col("type") == "CALLS", 0).when(F.col("type") == "ROUTES_TO", 1).otherwise(2)
    e = graph.edges.where(visible_call() | F.col("type").isin(*ENTRY_TYPES)).join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    known = e.join(graph.nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    rows = known.select(F.col("to_id").alias("id"), kind.alias("kind"), "from_id", F.col("id").alias("edge_id"))
    return top_per_group(rows, ["id"], ["kind", "from_id", "edge_id"], limit).drop("edge_id")


def scoped_edges(graph: CodeGraph, ids: DataFrame, types: list[str]) -> DataFrame:
    """Edges of some types that touch an id or one of its members (`id::...`) on either side."""
    e = graph.edges.where(F.col("type").isin(*types))
    own = ids.select(F.lower("id").alias("k"))
    keys = lambda c: F.array_distinct(F.array(F.lower(c), F.lower(class_of(F.col(c)))))
    touched = e.select("id", F.explode(F.array_distinct(F.concat(keys("from_id"), keys("to_id")))).alias("k"))
    return e.join(touched.join(own, "k", "left_semi").select("id").distinct(), "id", "left_semi").select("id", "from_id", "to_id", "type")


def implementations(graph: CodeGraph, interfaces: DataFrame | None = None) -> DataFrame:
    """(interface, method, target, candidates): methods by which source classes implement those of an interface or parent, or of those of `interfaces` (class); resolved where there is one candidate."""
    e = graph.edges.where(F.col("type").isin("IMPLEMENTS", "EXTENDS")).select(F.col("to_id").alias("interface"), F.col("from_id").alias("class")).distinct()
    if interfaces is not None:
        e = e.join(interfaces.select(F.col("class").alias("interface")), "interface", "left_semi")
    m = graph.nodes.where("type = 'method'").select(F.col("parent").alias("class"), F.col("name").alias("method"), F.col("id").alias("target"), "file")
    # the role of a file is found where its class implements something
    source = F.when(file_role(F.col("file")) == "source", F.col("target"))
    return e.join(m, "class").groupBy("interface", "method").agg(F.min(source).alias("target"), F.countDistinct(source).alias("candidates")).where("candidates > 0")


def abstract_targets(graph: CodeGraph) -> DataFrame:
    """(id): interfaces, traits, implemented classes and classes named like bases."""
    implemented = graph.edges.where(F.col("type") == "IMPLEMENTS").select(F.col("to_id").alias("id"))
    named = F.substring_index("id", "\\", -1).rlike(r"^(Abstract|Base)[A-Z]|Interface$|Contracts?$")
    own = graph.nodes.where(F.col("type").isin("interface", "trait") | (F.col("type").isin("class") & named)).select("id")
    return own.unionByName(implemented).distinct()


def without_noise(calls: DataFrame, column: str = "to_id") -> DataFrame:
    """Calls whose callee is not of the framework."""
    return calls.where(~framework_noise(F.col(column)))


def field_intake(edges: DataFrame) -> DataFrame:
    """Assignments, and those reads of fields that no assignment continues."""
    sources = edges.where((F.col("type") == "ASSIGNS") & F.col("from_id").startswith("request_field:")).select(F.col("from_id").alias("to_id"))
    return edges.where(F.col("type") == "ASSIGNS").unionByName(edges.where(F.col("type") == "READS_FIELD").join(sources, "to_id", "left_anti").select(*edges.columns))


def field_flow(edges: DataFrame) -> DataFrame:
    """Flows of arguments; a flow into a method goes if the parameter that it reaches is known."""
    arguments = edges.where(F.col("type") == "ARGUMENT_TO").select("from_id", F.coalesce("via", F.lit("")).alias("_via"))
    flows = edges.where(F.col("type") == "FLOWS_TO").withColumn("_via", F.coalesce("via", F.lit("")))
    return edges.where(F.col("type") != "FLOWS_TO").unionByName(flows.join(arguments, ["from_id", "_via"], "left_anti").select(*edges.columns))


def relations(graph: CodeGraph) -> DataFrame:
    """(id, direction, kind, n): how many edges of each kind (a call's own type, else the edge's) every node has, either way."""
    kind = F.coalesce("call_type", "type")
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("to_id").alias("id"), F.lit("in").alias("direction")), F.struct(F.col("from_id").alias("id"), F.lit("out").alias("direction")))).alias("e"), kind.alias("kind"))
    counts = ends.groupBy("e.id", "e.direction", "kind").agg(F.count("*").alias("n"))
    return counts.join(graph.nodes.select("id"), "id", "left_semi").select("id", "direction", "kind", "n")


def unresolved_calls(graph: CodeGraph) -> DataFrame:
    """(from_id, to_id, n): calls of what is no node, by nodes."""
    e = graph.edges.where("type = 'CALLS'")
    missing = e.join(graph.nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti").join(graph.nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return missing.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))


def file_fan_in(graph: CodeGraph, type_: str) -> DataFrame:
    """(id, files): from how many files each target of an edge type is used."""
    f = graph.nodes.select(F.col("id").alias("from_id"), "file")
    return graph.edges.where(F.col("type") == type_).join(f, "from_id").groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("file").alias("files"))


def code_location(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """(file, directory, workspace, runtime) of the longest scope directory that holds each file.

    Every directory above a file is looked up by equality; files under no scope have nulls.
    """
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = files.select("file").distinct().select("file", F.explode(above).alias("directory"))
    best = each.join(scopes.select("directory", "workspace", "runtime"), "directory").groupBy("file").agg(F.max_by(F.struct("directory", "workspace", "runtime"), F.length("directory")).alias("s"))
    return files.select("file").distinct().join(best, "file", "left").select("file", "s.directory", "s.workspace", "s.runtime")
