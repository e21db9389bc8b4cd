"""Passes over a whole graph that add, rewrite or remove edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import comparable_path, endpoint_path, endpoint_verb
from weftgraph.model import CodeGraph
from weftgraph.operators.inheritance import chains, forest, lineage
from weftgraph.sources.storage import stored


def link_endpoints(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """(from_id, to_id, confidence): client requests (id) and the routes (id, mount) that serve them.

    Equal verb and path link with 1; a mounted route also under `/api` with 0.8; an unmounted one also without `/api` or `/api/vN`
    with 0.7. The best links of a client stay; several equally good ones are uncertain.
    """
    c = clients.select(F.col("id").alias("from_id"), endpoint_verb(F.col("id")).alias("verb"), comparable_path(endpoint_path(F.col("id"))).alias("path"))
    r = routes.select(F.col("id").alias("to_id"), endpoint_verb(F.col("id")).alias("verb"), comparable_path(endpoint_path(F.col("id"))).alias("path"), "mount")
    api = F.col("path").rlike(r"^/api(/|$)")
    bare = F.regexp_replace("path", r"^/api(/v\d+)?(?=/|$)", "")
    ways = [
        (c, r, 1.0),
        (c.where(~api).withColumn("path", F.concat(F.lit("/api"), "path")), r.where("mount IS NOT NULL"), 0.8),
        (c.where(api).withColumn("path", F.when(bare == "", "/").otherwise(bare)), r.where("mount IS NULL"), 0.7),
    ]
    found = None
    for left, right, confidence in ways:
        some = left.join(right.drop("mount"), ["verb", "path"]).select("from_id", "to_id", F.lit(confidence).alias("confidence"))
        found = some if found is None else found.unionByName(some)
    each = found.groupBy("from_id", "to_id").agg(F.max("confidence").alias("confidence"))
    best = each.join(each.groupBy("from_id").agg(F.max("confidence").alias("top")), "from_id").where("confidence = top")
    many = best.groupBy("from_id").agg(F.count("*").alias("n"))
    return best.join(many, "from_id").select("from_id", "to_id", F.when(F.col("n") > 1, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")).alias("confidence"))


def prune_dangling(graph: CodeGraph, type: str, prefix: str = "") -> CodeGraph:
    """Without edges of a type whose target (with that prefix) is no node."""
    some = (F.col("type") == type) & F.col("to_id").startswith(prefix)
    kept = graph.edges.where(some).join(graph.nodes.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*graph.edges.columns)
    return CodeGraph(graph.nodes, graph.edges.where(~some).unionByName(kept), graph.meta)


def _resolved(calls: DataFrame, targets: DataFrame, kind: str) -> DataFrame:
    """New calls from (from_id, class, method) to methods (class, owner) of the same name."""
    pairs = calls.join(targets, ["class", "method"]).select("from_id", F.col("target").alias("to_id")).distinct()
    # what follows from the ends is added when each pair is there once
    return pairs.select(F.concat_ws("->", "from_id", "to_id").alias("id"), "from_id", "to_id", F.lit("CALLS").alias("type"), F.lit(kind).alias("call_type"))


def _calls(graph: CodeGraph, skip: tuple[str, ...]) -> DataFrame:
    e = graph.edges.where((F.col("type") == "CALLS") & F.col("to_id").contains("::") & (F.col("call_type").isNull() | ~F.col("call_type").isin(*skip)))
    return e.select("from_id", F.substring_index("to_id", "::", 1).alias("class"), F.substring_index("to_id", "::", -1).alias("method"))


def interface_calls(graph: CodeGraph) -> DataFrame:
    """Calls of an interface's method, also to the method of each class that implements it directly."""
    impl = graph.edges.where("type = 'IMPLEMENTS'").select(F.col("to_id").alias("class"), F.col("from_id").alias("owner")).distinct()
    m = graph.nodes.where("type = 'method'").select(F.col("parent").alias("owner"), F.col("name").alias("method"), F.col("id").alias("target"))
    return _resolved(_calls(graph, ()), impl.join(m, "owner"), "INTERFACE_RESOLVED")


#: Calls that are no calls of what overrides their callee.
_FIXED = ("STATIC", "EXTENDS_RESOLVED", "OVERRIDE_RESOLVED")


def _overriding(graph: CodeGraph) -> DataFrame:
    """(owner, method, target): the methods that may override others."""
    return graph.nodes.where("type = 'method' AND coalesce(is_abstract, false) = false").select(F.col("parent").alias("owner"), F.col("name").alias("method"), F.col("id").alias("target"))


def override_calls(graph: CodeGraph) -> DataFrame:
    """Calls of a class's method, also to the overriding methods of its descendants."""
    calls = _calls(graph, _FIXED).distinct()
    return _override_pairs(graph, calls, _overriding(graph).join(calls.select("method").distinct(), "method", "left_semi"))  # other names are called nowhere


def _override_pairs(graph: CodeGraph, calls: DataFrame, m: DataFrame) -> DataFrame:
    up = lineage(graph, m.select(F.col("owner").alias("id")).distinct()).select(F.col("dst").alias("class"), F.col("src").alias("owner"))
    return _resolved(calls, up.join(m, "owner"), "OVERRIDE_RESOLVED")


def override_counts(graph: CodeGraph) -> DataFrame:
    """(to_id, n): how many calls `override_calls` gives each overriding method, counted without making them.

    Where every class on the way up has one parent, the callers of a method's ancestors are counted at the topmost class that each calls: classes are numbered so
    that those under a class follow it without a gap, a caller's calls are sorted by that number once, and one that lies under an earlier one is not new. What a
    class adds is then summed along the ancestors of each method. Classes of several parents or in loops, what descends from them, and methods
    that stand in several classes are counted by their pairs.
    """
    up, mixed = _spans(graph)
    m = stored(_overriding(graph).join(up.select("id").unionByName(mixed).select(F.col("id").alias("owner")), "owner", "left_semi").distinct())
    unlike = m.groupBy("target").agg(F.count("*").alias("n")).where("n > 1").select("target")
    owners = mixed.select(F.col("id").alias("owner"))
    other = m.join(owners, "owner", "left_anti")
    rest = stored(m.join(owners, "owner", "left_semi").unionByName(other.join(unlike, "target", "left_semi")))
    plain = other.join(unlike, "target", "left_anti")
    above = stored(up.withColumnRenamed("id", "owner").join(plain, "owner").select("target", "method", "class", "tree", "first", "last"))
    # only calls of what some method overrides matter
    wanted = stored(above.select("class", "method", "tree", "first", "last").distinct())
    calls = _calls(graph, _FIXED).join(wanted, ["class", "method"]).select("from_id", "method", "tree", "first", "last")
    before = Window.partitionBy("from_id", "method", "tree").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    new = calls.withColumn("_end", F.max("last").over(before)).where("_end IS NULL OR _end < first").groupBy("tree", "first", "method").agg(F.count("*").alias("n"))
    counts = above.select("target", "method", "tree", "first").join(stored(new), ["tree", "first", "method"]).groupBy(F.col("target").alias("to_id")).agg(F.sum("n").alias("n"))
    if rest.isEmpty():
        return counts
    called = _calls(graph, _FIXED).join(rest.select("method").distinct(), "method", "left_semi").distinct()
    return counts.unionByName(_override_pairs(graph, called, rest).groupBy("to_id").agg(F.count("*").alias("n")))


def _spans(graph: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """(id, class, tree, first, last): of each class that descends by single parents the classes above it, with their numbers and the last number under each;
    and (id): the classes that have several parents, run in loops, or descend from such."""
    parents = stored(graph.edges.where("type = 'EXTENDS' AND from_id <> to_id").select(F.col("from_id").alias("id"), F.col("to_id").alias("up")).distinct())
    several = stored(parents.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    trees = forest(parents.join(several, "id", "left_anti"))
    straight = stored(parents.join(several, "id", "left_anti").join(trees.looped.select("id"), "id", "left_anti"))
    pairs = stored(chains(trees, straight).join(trees.looped.select("id"), "id", "left_anti"))
    under = pairs.join(several.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
    mixed = stored(several.unionByName(trees.looped.select("id")).unionByName(under).distinct())
    pairs = pairs.join(mixed, "id", "left_anti").select("id", "ancestor", "dist")
    below = stored(pairs.groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("below")))
    # a child's number is its parent's, and one more for each class at or under the children before it, and one
    own = straight.join(mixed, "id", "left_anti").join(below, "id", "left").select("id", "up", (F.coalesce("below", F.lit(0)) + 1).alias("size"))
    place = own.withColumn("place", F.sum("size").over(Window.partitionBy("up").orderBy("id")) - F.col("size") + 1).select(F.col("id").alias("ancestor"), "place")
    way = pairs.unionByName(own.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("dist"))).join(place, "ancestor", "left")
    tops = below.join(own.select("id"), "id", "left_anti").select("id")
    numbered = stored(tops.select(F.col("id").alias("top"), F.monotonically_increasing_id().alias("tree")))
    at = way.groupBy("id").agg(F.sum("place").alias("first"), F.max_by("ancestor", "dist").alias("top"))
    spans = at.unionByName(tops.select("id", F.lit(0).cast("long").alias("first"), F.col("id").alias("top"))).join(numbered, "top").join(below, "id")
    spans = stored(spans.select(F.col("id").alias("class"), "tree", "first", (F.col("first") + F.col("below")).alias("last")))
    return pairs.select("id", F.col("ancestor").alias("class")).join(spans, "class"), mixed


def argument_edges(graph: CodeGraph) -> DataFrame:
    """(from_id, to_id, argument_index): flows into a method as flows into its parameter at that place."""
    flows = graph.edges.where("type = 'FLOWS_TO'").select("from_id", F.col("to_id").alias("method"), "argument_index")
    params = graph.edges.where("type = 'HAS_PARAMETER'").select(F.col("from_id").alias("method"), F.col("to_id").alias("to_id"), "argument_index")
    return flows.join(params, ["method", "argument_index"]).select("from_id", "to_id", "argument_index").distinct()


def blade_calls(graph: CodeGraph) -> DataFrame:
    """(from_id, to_id): method names called in views, with public methods of that name."""
    refs = graph.edges.where("type = 'BLADE_METHOD_CALL'").join(graph.nodes.where("type = 'blade_method_ref'").select(F.col("id").alias("to_id"), F.lower("name").alias("k")), "to_id").select("from_id", "k")
    m = graph.nodes.where("type = 'method' AND visibility = 'public'").select(F.col("id").alias("to_id"), F.lower("name").alias("k"))
    return refs.join(m, "k").select("from_id", "to_id").distinct()


# The routes of a resource controller: verb, path after the base, action.
RESOURCE_ROUTES = (
    ("GET", "", "index"), ("GET", "/create", "create"), ("POST", "", "store"), ("GET", "/{param}", "show"),
    ("GET", "/{param}/edit", "edit"), ("PUT", "/{param}", "update"), ("PATCH", "/{param}", "update"), ("DELETE", "/{param}", "destroy"),
)


def expand_resources(resources: DataFrame) -> DataFrame:
    """(verb, path, action) for each resource (base, kind); `apiResource` has no forms; dots nest with a parameter between."""
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("verb"), F.lit(s).alias("suffix"), F.lit(a).alias("action")) for v, s, a in RESOURCE_ROUTES])).alias("r")
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("base", r"\.", "/{param}/"), "^/+", ""))
    return resources.select("*", rows).where((F.col("kind") == "resource") | ~F.col("r.action").isin("create", "edit")).select("base", "kind", F.col("r.verb").alias("verb"), F.concat(path, F.col("r.suffix")).alias("path"), F.col("r.action").alias("action"))


#: Patterns of what a view refers to: edge type, pattern, group.
BLADE = (
    ("BLADE_EXTENDS", r"@extends\(\s*['\"]([^'\"]+)['\"]", 1),
    ("BLADE_INCLUDES", r"@include(?:If|When|Unless|First)?\(\s*['\"]([^'\"]+)['\"]", 1),
    ("BLADE_INCLUDES", r"<x-([A-Za-z0-9_.:-]+)", 1),
    ("BLADE_USES_ROUTE", r"\broute\(\s*['\"]([^'\"]+)['\"]", 1),
    ("BLADE_USES_ACTION", r"\baction\(\s*['\"]([^'\"]+)['\"]", 1),
    ("BLADE_METHOD_CALL", r"\$\w+->(\w+)\(", 1),
)


def scan_views(files: DataFrame) -> DataFrame:
    """(file, type, ref): what views (file, text) extend, include, link to and call, by patterns alone."""
    out = None
    for type_, pattern, group in BLADE:
        some = files.select("file", F.lit(type_).alias("type"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("ref"))
        out = some if out is None else out.unionByName(some)
    return out.distinct()


def best_by_group(df: DataFrame, key: str, score: str) -> DataFrame:
    """Rows whose score is the highest of their group; ties stay."""
    return df.withColumn("_m", F.max(score).over(Window.partitionBy(key))).where(F.col(score) == F.col("_m")).drop("_m")
