"""What surrounds a node: entries of one route, warnings, bridges over HTTP, factories, groups of matches, and rendered components.

All take many nodes at once and join; an id with `::` in it also counts for the nodes that it is a member of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import visible_call
from weftgraph.functions.text import short_label, workspace_matches
from weftgraph.model import CodeGraph
from weftgraph.operators.lookups import code_location
from weftgraph.operators.navigation import http_clients, http_downstream
from weftgraph.operators.search import find
from weftgraph.operators.traversal import call_chain
from weftgraph.sources.graphs import top_per_group
from weftgraph.sources.storage import cut

# Files that render a component from which on it is generic, components kept at each level, and weights of a flow.
GENERIC_FROM, PER_LEVEL = 8, 12
FLOW_HTTP, FLOW_STATE, FLOW_CALL, FLOW_DEPTH = 100, 20, 5, 40


def owners(id: Column) -> Column:
    """An id and all that it is a member of: `a::b::c`, `a::b`, `a`."""
    parts = F.split(id, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))


def sfc_modules(graph: CodeGraph) -> DataFrame:
    """(id, module): the module node of each single-file component."""
    own = graph.nodes.where("type = 'vue_component'").where(F.col("file").endswith(".vue")).select("id", F.concat(F.lit("js:"), "file").alias("module"))
    return own.join(graph.nodes.select(F.col("id").alias("module")), "module", "left_semi").select("id", "module")


def important_methods(graph: CodeGraph, parents: DataFrame, limit: int = 10, include_resolved: bool = False) -> DataFrame:
    """(parent, id, outgoing, incoming): the methods of each class with the most calls either way; a call of itself counts both ways."""
    methods = graph.nodes.where("type = 'method'").join(parents.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi").select("parent", "id")
    one = lambda end, out: F.struct(F.col(end).alias("id"), F.lit(out).alias("o"), F.lit(1 - out).alias("i"))
    ends = graph.edges.where(visible_call(include_resolved)).select(F.explode(F.array(one("from_id", 1), one("to_id", 0))).alias("e")).select("e.*")
    counts = ends.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
    rows = methods.join(counts, "id", "left").fillna(0, ["outgoing", "incoming"])
    return top_per_group(rows, ["parent"], [F.desc(F.col("outgoing") + F.col("incoming")), "id"], limit).select("parent", "id", "outgoing", "incoming")


def call_kinds(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kinds): how many edges of each kind, as text, the most frequent first: `CALLS(3), EXTENDS(1)`."""
    kind = F.coalesce("call_type", "type", F.lit("UNKNOWN"))
    n = edges.groupBy(*keys, kind.alias("kind")).agg(F.count("*").alias("n"))
    each = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("kind"))))
    return n.groupBy(*keys).agg(F.array_join(F.transform(each, lambda k: F.concat(k["kind"], F.lit("("), -k["n"], F.lit(")"))), ", ").alias("kinds"))


def group_by_file(matches: DataFrame) -> DataFrame:
    """(id, type, file, score, nodes, types) of matches: of each file the best one, by score and then id, and what else matched there.

    A file's name counts whatever its case and separators; matches without a file stand alone.
    """
    key = F.coalesce(F.concat(F.lit("file:"), F.lower(F.translate("file", "\\", "/"))), F.concat(F.lit("id:"), "id"))
    best = F.min_by(F.struct("id", "type", "file", "score"), F.struct((-F.col("score")).alias("s"), F.col("id")))
    one = matches.groupBy(key.alias("_k")).agg(best.alias("b"), F.count("*").alias("nodes"), F.array_sort(F.collect_set("type")).alias("types"))
    return one.select("b.*", "nodes", "types")


def find_in(graph: CodeGraph, query: str, scopes: DataFrame, types: list[str] | None = None, workspace: str | None = None, runtime: str | None = None, limit: int = 20, by_file: bool = False) -> DataFrame:
    """Matches of `find` of some types, in a workspace or runtime of `scopes` (directory, workspace, runtime), each file once if asked for.

    Filters come before the limit, so that no match is lost behind others.
    """
    own = CodeGraph(graph.nodes.where(F.col("type").isin(*types)), graph.edges, graph.meta) if types else graph
    found = find(own, query, None)
    if workspace or runtime:
        place = code_location(found.where("file IS NOT NULL").select("file").distinct(), scopes)
        wanted = (workspace_matches(F.col("workspace"), workspace) if workspace else F.lit(True)) & (F.col("runtime") == runtime if runtime else F.lit(True))
        found = found.join(place.where(wanted).select("file"), "file", "left_semi")
    rows = group_by_file(found) if by_file else found.select("id", "type", "file", "score")
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def route_scoped_entries(graph: CodeGraph, pairs: DataFrame, limit: int = 20, include_resolved: bool = False) -> DataFrame:
    """(endpoint, handler, kind, from_id): clients of an endpoint, then callers of its handler, `limit` for each pair (endpoint, handler)."""
    pairs = pairs.select("endpoint", "handler").distinct()
    # a pair takes the first of its endpoint's clients and of its handler's callers, so no more than `limit` of each meet the pairs
    clients = http_clients(graph, limit).select("endpoint", F.col("client").alias("from_id")).join(pairs, "endpoint").withColumn("kind", F.lit("http_client"))
    calls = graph.edges.where(visible_call(include_resolved)).select("from_id", F.col("to_id").alias("handler")).join(pairs.select("handler"), "handler", "left_semi").distinct()
    callers = top_per_group(calls.join(graph.nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi"), ["handler"], ["from_id"], limit)
    known = callers.join(pairs, "handler").withColumn("kind", F.lit("call"))
    columns = ["endpoint", "handler", "kind", "from_id"]
    return top_per_group(clients.select(*columns).unionByName(known.select(*columns)), ["endpoint", "handler"], [F.desc("kind"), "from_id"], limit)


def navigation_counts(graph: CodeGraph, ids: DataFrame) -> DataFrame:
    """(id, type, parent, routes, views, callers, callees, requests, fields, flows) of each node, from one pass over the edges."""
    call = visible_call()
    kinds = {"routes": F.col("type") == "ROUTES_TO", "views": F.col("type") == "BLADE_USES_ACTION", "callers": call}
    outs = {"callees": call, "requests": F.col("type") == "HTTP_REQUEST", "fields": F.col("type").isin("ASSIGNS", "READS_FIELD"), "flows": F.col("type").isin("FLOWS_TO", "ARGUMENT_TO")}
    names = [*kinds, *outs]
    # an end carries the place of its counter in `names`; ends that no counter counts make no row
    place = lambda some: F.coalesce(*[F.when(c, names.index(k)) for k, c in some.items()])
    end = lambda c, some: F.struct(F.col(c).alias("id"), place(some).alias("k"))
    counted = graph.edges.where(place(kinds | outs).isNotNull())
    ends = counted.select(F.explode(F.array(end("to_id", kinds), end("from_id", outs))).alias("e")).select("e.*").where("k IS NOT NULL")
    sums = ends.groupBy("id").agg(*[F.count_if(F.col("k") == i).alias(name) for i, name in enumerate(names)])
    own = graph.nodes.select("id", "type", "parent").join(ids.select("id"), "id", "left_semi")
    return own.join(sums, "id", "left").fillna(0, names)


def navigation_warnings(counts: DataFrame) -> DataFrame:
    """Adds `warnings` to `navigation_counts`: no_entry, no_route (controllers), no_fields (controllers), no_flow."""
    owner = F.when(F.col("type") == "method", F.coalesce("parent", F.substring_index("id", "::", 1))).otherwise(F.col("id"))
    controller = short_label(owner).rlike("(?i)Controller$")
    none = (F.col("routes") == 0) & (F.col("views") == 0)
    tests = {
        "no_entry": none & (F.col("callers") == 0) & (F.col("requests") == 0),
        "no_route": controller & none,
        "no_fields": controller & (F.col("fields") == 0),
        "no_flow": (F.col("callees") > 0) & (F.col("flows") == 0) & (F.col("fields") > 0),
    }
    return counts.withColumn("warnings", F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]), lambda w: w.isNotNull()))


def outbound_bridges(graph: CodeGraph, ids: DataFrame, limit: int = 4) -> DataFrame:
    """(id, from_id, endpoint): requests that a node or its members make, its own first."""
    asks = graph.edges.where("type = 'HTTP_REQUEST'").select("from_id", F.col("to_id").alias("endpoint")).distinct()
    each = asks.select(F.explode(owners(F.col("from_id"))).alias("id"), "from_id", "endpoint").join(ids.select("id"), "id", "left_semi")
    return top_per_group(each, ["id"], [(F.col("from_id") != F.col("id")).cast("int"), "endpoint", "from_id"], limit)


def factory_dependencies(graph: CodeGraph, ids: DataFrame, limit: int = 6) -> DataFrame:
    """(id, needs): what the factory that a method belongs to depends on."""
    made = graph.nodes.join(ids.select("id"), "id", "left_semi").where(short_label(F.col("parent")).rlike("(?i)factory")).select("id", "parent")
    needs = graph.edges.where("type = 'DEPENDS_ON'").select(F.col("from_id").alias("parent"), F.col("to_id").alias("needs")).distinct()
    return top_per_group(made.join(needs, "parent").select("id", "needs"), ["id"], ["needs"], limit)


def rendered_flows(graph: CodeGraph, starts: DataFrame, depth: int = 2, most: int = 3, call_depth: int = 2, call_limit: int = 6, known: DataFrame | None = None) -> DataFrame:
    """(start, id, depth, path, score, calls, endpoints): the components that each start renders, level by level, which request or hold something.

    Of a level the twelve that fewest files render go on; those that eight or more render are generic and aren't followed.
    A component counts if it or its calls reach an endpoint, or if it isn't generic and calls a composable or store. A call shown
    with a better component of its start, or in `known` (start, id), isn't shown again.
    """
    drawn = graph.edges.where("type = 'RENDERS_COMPONENT'").join(graph.nodes.where(F.col("file").endswith(".vue")).select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id")
    children = cut(drawn.select(F.explode(owners(F.col("from_id"))).alias("parent"), F.col("to_id").alias("id")).distinct())
    fan = drawn.join(graph.nodes.select(F.col("id").alias("from_id"), "file"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("file").alias("fan_in"))
    children = cut(children.join(fan, "id", "left").fillna(0, ["fan_in"]))
    front = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array().cast("array<string>").alias("path"), F.lit(0).alias("place")).distinct())
    seen, found = front.select("start", F.col("at").alias("id")), None
    for level in range(1, depth + 1):
        step = front.join(children.withColumnRenamed("parent", "at"), "at").join(seen, ["start", "id"], "left_anti")
        new = cut(step.groupBy("start", "id", "fan_in").agg(F.min_by("path", "place").alias("path")))
        if new.isEmpty():
            break
        seen = seen.unionByName(new.select("start", "id"))
        kept = cut(top_per_group(new, ["start"], ["fan_in", "id"], PER_LEVEL).select("start", "id", "fan_in", F.lit(level).alias("depth"), F.concat("path", F.array("id")).alias("path")))
        found = kept if found is None else found.unionByName(kept)
        front = kept.where(F.col("fan_in") < GENERIC_FROM).select("start", F.col("id").alias("at"), "path", F.struct("fan_in", "id").alias("place"))
    if found is None:
        found = front.select("start", F.col("at").alias("id"), F.lit(0).cast("long").alias("fan_in"), F.lit(0).alias("depth"), "path").where("false")
    return _ranked(graph, found, most, call_depth, call_limit, known)


def _ranked(graph: CodeGraph, found: DataFrame, most: int, call_depth: int, call_limit: int, known: DataFrame | None) -> DataFrame:
    """The best components (start, id, fan_in, depth, path) of each start, with their calls and endpoints."""
    chain = call_chain(graph, found.select("id").distinct(), call_depth, call_limit).select(F.col("start").alias("id"), F.col("id").alias("call"))
    calls = found.select("start", "id").join(chain, "id")
    if known is not None:
        calls = calls.join(known.select("start", F.col("id").alias("call")), ["start", "call"], "left_anti")
    calls = cut(calls.select("start", "id", "call").distinct())
    way = http_downstream(graph, 2).select(F.col("client").alias("call"), "endpoint")
    http = found.select("start", "id", F.col("id").alias("call")).unionByName(calls).join(way, "call").groupBy("start", "id").agg(F.array_sort(F.collect_set("endpoint")).alias("endpoints"))
    state = F.substring_index("call", "::", -1).rlike("^use[A-Z]") | F.col("call").rlike("/(?:composables|stores)/")
    sums = calls.groupBy("start", "id").agg(F.count("*").alias("n_calls"), F.count_if(state).alias("n_state"))
    rows = found.join(sums, ["start", "id"], "left").join(http, ["start", "id"], "left").fillna(0, ["n_calls", "n_state"])
    n_http = F.when(F.col("endpoints").isNull(), 0).otherwise(F.size("endpoints"))
    score = n_http * FLOW_HTTP + F.col("n_state") * FLOW_STATE + F.col("n_calls") * FLOW_CALL - F.col("depth") * FLOW_DEPTH
    good = rows.where((n_http > 0) | ((F.col("fan_in") < GENERIC_FROM) & (F.col("n_state") > 0))).withColumn("score", score)
    best = cut(top_per_group(good, ["start"], [F.desc("score"), "depth", "id"], most).select("start", "id", "depth", "path", "score", "endpoints"))
    order = F.struct((-F.col("score")).alias("s"), F.col("depth"), F.col("id"))
    shown = calls.join(best.select("start", "id", "depth", "score"), ["start", "id"]).groupBy("start", "call").agg(F.min_by("id", order).alias("id")).groupBy("start", "id").agg(F.array_sort(F.collect_list("call")).alias("calls"))
    none = F.array().cast("array<string>")
    return best.join(shown, ["start", "id"], "left").select("start", "id", "depth", "path", "score", F.coalesce("calls", none).alias("calls"), F.coalesce("endpoints", none).alias("endpoints"))
