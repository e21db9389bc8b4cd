"""Passes that resolve calls and endpoints: abstract methods, automatic imports, equal endpoints, concrete callees, rendered components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import class_of
from weftgraph.functions.text import endpoint_path, endpoint_verb
from weftgraph.model import CodeGraph
from weftgraph.operators.inheritance import descendants
from weftgraph.operators.lookups import abstract_targets


def extends_calls(graph: CodeGraph) -> DataFrame:
    """(id, from_id, to_id, type, call_type): calls of an abstract method, also to the methods by which descendants of its class fill it in."""
    own = graph.nodes.where("type = 'method'").select("id", F.col("parent").alias("owner"), F.col("name").alias("method"), F.coalesce("is_abstract", F.lit(False)).alias("is_abstract"))
    calls = graph.edges.where("type = 'CALLS'").select("from_id", F.col("to_id").alias("id"))
    wanted = calls.join(own.where("is_abstract"), "id").select("from_id", F.col("owner").alias("dst"), "method").distinct()
    down = descendants(graph, wanted.select(F.col("dst").alias("id")).distinct()).select(F.col("id").alias("dst"), F.col("descendant").alias("owner"))
    filled = down.join(own.where("NOT is_abstract"), "owner").select("dst", "method", F.col("id").alias("to_id"))
    found = wanted.join(filled, ["dst", "method"]).select("from_id", "to_id").distinct()
    return found.select(F.concat_ws("->", "from_id", "to_id").alias("id"), "from_id", "to_id", F.lit("CALLS").alias("type"), F.lit("EXTENDS_RESOLVED").alias("call_type"))


def auto_imports(graph: CodeGraph) -> DataFrame:
    """(from_id, old_id, to_id, confidence): calls of what is no node, led to the one composable or helper of that name; several of a name lead nowhere."""
    called = graph.edges.where("type = 'CALLS'").select("from_id", F.col("to_id").alias("id")).distinct()
    missing = called.join(graph.nodes.select("id"), "id", "left_anti").select("from_id", F.col("id").alias("old_id"), F.substring_index("id", "::", -1).alias("name"))
    offered = graph.nodes.where(F.col("file").rlike("(^|/)(composables|utils)/") & F.col("id").contains("::"))
    one = offered.groupBy("name").agg(F.min("id").alias("to_id"), F.countDistinct("id").alias("n")).where("n = 1").drop("n")
    return missing.join(one, "name").select("from_id", "old_id", "to_id", F.lit(0.8).alias("confidence"))


def canonical_endpoint(id: Column) -> Column:
    """An endpoint id with every placeholder as `{param}`, single slashes and none at the end; other ids as they are."""
    path = F.regexp_replace(F.regexp_replace(endpoint_path(id), r"\$?\{[^}]+\}", "{param}"), "/+", "/")
    path = F.regexp_replace(path, "(?<=.)/$", "")
    return F.coalesce(F.concat(F.substring_index(id, ":", 1), F.lit(":"), endpoint_verb(id), F.lit(":"), path), id)


def canonical_endpoints(graph: CodeGraph) -> CodeGraph:
    """Endpoints that mean the same become one node, and their edges meet there; equal edges become one.

    Of several nodes the one with the smallest id stays, with the keywords of all. It needs no map of ids: both ends are rewritten where edges are read.
    """
    renamed = graph.nodes.withColumn("_old", F.col("id")).withColumn("id", canonical_endpoint(F.col("id")))
    others = [c for c in graph.nodes.columns if c not in ("id", "keywords")]
    first = F.min_by(F.struct(*others), "_old").alias("first")
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("words")
    merged = renamed.groupBy("id").agg(first, words).withColumn("keywords", F.when(F.size("words") > 0, F.col("words")))
    nodes = merged.select(*[F.col(c) if c in ("id", "keywords") else F.col(f"first.{c}").alias(c) for c in graph.nodes.columns])
    ends = graph.edges.withColumns({c: canonical_endpoint(F.col(c)) for c in ("from_id", "to_id")})
    keys = ["from_id", "to_id", "type", "via"]
    rest = [c for c in graph.edges.columns if c not in ("id", *keys)]
    best = ends.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("ord", "id")).alias("first"))
    named = best.withColumn("id", F.concat(F.col("from_id"), F.lit("->"), F.col("to_id"), F.lit(":"), F.col("type"), F.lit(":"), F.coalesce("via", F.lit(""))))
    edges = named.select(*[F.col(c) if c in ("id", *keys) else F.col(f"first.{c}").alias(c) for c in graph.edges.columns])
    return CodeGraph(nodes, edges, graph.meta)


def prefer_concrete(graph: CodeGraph, calls: DataFrame) -> DataFrame:
    """Of the calls (from_id, to_id) that one caller makes to methods of one name: the concrete ones, or else the first abstract one."""
    abstract = abstract_targets(graph).select(F.col("id").alias("_class"), F.lit(True).alias("_abstract"))
    marked = calls.select("from_id", "to_id").distinct().withColumn("_class", class_of(F.col("to_id"))).withColumn("_name", F.substring_index("to_id", "::", -1))
    known = marked.join(abstract, "_class", "left").withColumn("_abstract", F.coalesce("_abstract", F.lit(False)))
    stand_in = known.groupBy("from_id", "_name").agg(F.min("to_id").alias("to_id"), F.bool_and("_abstract").alias("_all")).where("_all").select("from_id", "to_id")
    return known.where("NOT _abstract").select("from_id", "to_id").unionByName(stand_in)


def rendered_children(graph: CodeGraph) -> DataFrame:
    """(parent, child, fan_in): the components that each module or its members render, and how many files render each."""
    drawn = graph.edges.where(F.col("type") == "RENDERS_COMPONENT").where(F.col("to_id").endswith(".vue"))
    pairs = drawn.select(F.col("from_id").alias("id"), F.substring_index("from_id", "::", 1).alias("parent"), F.col("to_id").alias("child"))
    files = pairs.select("id", "child").join(graph.nodes.select("id", "file"), "id").groupBy("child").agg(F.countDistinct("file").alias("fan_in"))
    return pairs.select("parent", "child").distinct().join(files, "child", "left").select("parent", "child", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"))
