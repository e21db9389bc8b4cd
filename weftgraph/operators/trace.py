"""Traces of many starts at once: from pages over requests, bridges, routes and handlers into calls; what surrounds a target; how much is covered.

A trace's state is (start, node, phase). Each phase allows its own edges and leads into its own next phase (`STEPS`); where edges lead, with abstract
and inherited callees rewritten to what is really traversed, is one table that is made once and dealt out by node. Starts are numbered and travel together, 64 as the
bits of one number, so that an edge is followed once for all of them: a level is one join of the frontier with the table and one window over what it leads to.
A state is reached once, at its least distance, and keeps the state that it came from, so every path can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.predicates import framework_noise, layer_priority, visible_call
from weftgraph.model import CodeGraph
from weftgraph.operators.context import navigation_warnings, owners, route_scoped_entries, sfc_modules
from weftgraph.operators.inheritance import resolve_through_inheritance
from weftgraph.operators.lookups import abstract_targets, implementations
from weftgraph.operators.navigation import http_clients, http_downstream, route_handlers
from weftgraph.sources.graphs import top_per_group
from weftgraph.sources.storage import dealt, stored

#: (phase, edge type, next phase): what each phase may follow.
STEPS = (
    ("call", "CALLS", "call"),
    ("call", "RENDERS_COMPONENT", "call"),
    ("call", "HTTP_REQUEST", "request"),
    ("handler", "CALLS", "call"),
    ("handler", "HTTP_REQUEST", "request"),
    ("request", "RESOLVES_TO", "bridge"),
    ("request", "ROUTES_TO", "handler"),
    ("bridge", "ROUTES_TO", "handler"),
    ("route", "ROUTES_TO", "handler"),
)
# Names of classes that stand for others, and how many methods of a class are looked at.
ABSTRACT_NAME = r"(^|\\|\b)(Abstract|Base)[A-Z]|(Interface|Contracts?)$"
CLASS_METHODS = 8


def split_member(id: Column) -> tuple[Column, Column]:
    """(class, method) of `class::method`; nulls for other ids."""
    member = id.contains("::")
    return F.when(member, F.regexp_extract(id, "(?s)^(.*)::.*?$", 1)), F.when(member, F.substring_index(id, "::", -1))


def _led(graph: CodeGraph, known: DataFrame) -> DataFrame:
    """`known` (id, file) with `_to`, where a trace that does not call it statically goes on, and `candidates`.

    Most go on where they are; only those of abstract classes or without a file meet implementations and inheritance, once for each.
    """
    class_, method = split_member(F.col("id"))
    known = known.select("id", "file", class_.alias("class"), method.alias("method"))
    # written down, so that Spark knows how few they are before it deals out what is known
    abstract = stored(abstract_targets(graph).select(F.col("id").alias("class"), F.lit(True).alias("_abstract")))
    marked = known.join(abstract, "class", "left").withColumn("_abstract", F.coalesce("_abstract", F.col("class").rlike(ABSTRACT_NAME), F.lit(False)))
    other = F.col("_abstract") | F.col("file").isNull()
    plain = marked.where(~other).select("id", "file", F.col("id").alias("_to"), F.lit(None).cast("long").alias("candidates"))
    special = stored(marked.where(other).distinct())
    one = implementations(graph, special.where("_abstract").select("class")).select(F.col("interface").alias("class"), "method", F.col("target").alias("_target"), F.col("candidates"))
    led = special.join(one, ["class", "method"], "left").withColumn("candidates", F.when(F.col("_abstract"), F.coalesce("candidates", F.lit(0).cast("long"))))
    led = stored(led.withColumn("_target", F.when(F.col("candidates") == 1, F.col("_target"))))
    orphan = led.where("_target IS NULL AND file IS NULL AND class IS NOT NULL")
    above = resolve_through_inheritance(graph, orphan).select("class", "method", F.col("target").alias("_above"))
    led = stored(led.join(above, ["class", "method"], "left").select("id", "file", F.coalesce("_target", F.when(F.col("file").isNull(), F.col("_above")), "id").alias("_to"), "candidates"))
    return plain.unionByName(led)


def _static() -> Column:
    return F.coalesce(F.col("call_type") == "STATIC", F.lit(False))


def traversal_targets(graph: CodeGraph, calls: DataFrame) -> DataFrame:
    """`calls` (id, call_type, file and more) with `target`, where a trace goes on, and `candidates`, the implementations of an abstract callee.

    Static calls stay. A method of an interface, a trait, an implemented class or one named like a base goes to its one implementation in source code.
    What has no file otherwise goes to the class above it that has the method; the rest stays.
    """
    to = _led(graph, calls.select("id", "file").distinct()).withColumnRenamed("file", "_file")
    found = calls.join(to, (calls["id"] == to["id"]) & calls["file"].eqNullSafe(to["_file"]), "left").drop(to["id"]).drop("_file")
    return found.withColumn("target", F.when(_static(), F.col("id")).otherwise(F.coalesce("_to", "id"))).withColumn("candidates", F.when(~_static(), F.col("candidates"))).drop("_to")


def ways(graph: CodeGraph, include_resolved: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """(node, to, type, called, candidates): where each edge that traces may follow leads, whatever their phase; `called` is the callee before it was rewritten.

    With `nodes` (id), of the calls only those by them.
    """
    e = graph.edges.where(F.col("type").isin(*{t for _, t, _ in STEPS}) & ((F.col("type") != "CALLS") | visible_call(include_resolved)))
    calls = e.where("type = 'CALLS'").where(~framework_noise(F.col("to_id"))).select("from_id", F.col("to_id").alias("id"), "call_type")
    if nodes is not None:
        calls = stored(calls.join(nodes.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi").select("from_id", "id", "call_type"))
    # what a callee leads to is found once for each, and brought to its calls by one join
    to = _led(graph, graph.nodes.select("id", "file"))
    led = calls.join(to, "id").select(F.col("from_id").alias("node"), F.when(_static(), F.col("id")).otherwise(F.col("_to")).alias("to"), F.lit("CALLS").alias("type"), F.col("id").alias("called"), F.when(~_static(), F.col("candidates")).alias("candidates"))
    rest = e.where("type <> 'CALLS'").select("from_id", F.col("to_id").alias("to"), "type", F.col("to_id").alias("called"), F.lit(None).cast("long").alias("candidates"))
    # members of a component act for it
    acting = rest.select(F.explode(F.when(F.col("type").isin("RENDERS_COMPONENT", "HTTP_REQUEST"), owners(F.col("from_id"))).otherwise(F.array("from_id"))).alias("node"), "to", "type", "called", "candidates")
    parts = int(graph.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return led.unionByName(acting).repartition(parts, "node").groupBy("node", "to", "type").agg(F.min("called").alias("called"), F.max("candidates").alias("candidates"))


def _next() -> Column:
    """The phase that follows `phase` along `type`; null where it may not go."""
    return F.create_map(*[F.lit(x) for a, t, b in STEPS for x in (f"{a} {t}", b)])[F.concat_ws(" ", "phase", "type")]


def start_states(graph: CodeGraph, starts: DataFrame) -> DataFrame:
    """(start, node, phase): a route begins as one, a request as one, a component at its module, all else as code."""
    own = graph.nodes.join(starts.select("id").distinct(), "id", "left_semi").select("id", "type").join(sfc_modules(graph), "id", "left")
    phase = F.when(F.col("type") == "api_endpoint", "route").when(F.col("type") == "http_endpoint", "request").otherwise("call")
    return own.select(F.col("id").alias("start"), F.coalesce("module", "id").alias("node"), phase.alias("phase"))


def trace(graph: CodeGraph, starts: DataFrame, depth: int = 4, limit: int | None = None, include_resolved: bool = False) -> DataFrame:
    """(start, hop, node, phase, type, called, candidates, parent, parent_phase, dropped): all states within `depth` steps of each start.

    With a limit, each start keeps that many new states a step, those of the weightiest layers first; `dropped` counts the others of the step.
    The state that another comes from is the one whose node sorts first.
    """
    own = stored(start_states(graph, starts).distinct().select("*", F.monotonically_increasing_id().alias("_n")).select("start", "node", "phase", F.shiftright("_n", 6).alias("block"), F.expr("cast(_n % 64 AS int)").alias("bit")))
    held = own.select("block", "start", "bit")
    one = F.expr("shiftleft(1L, bit)")
    seen = front = stored(own.groupBy("block", "node", "phase").agg(F.bit_or(one).alias("bits")))
    none = F.lit(None).cast("string")
    found = own.select("start", F.lit(0).alias("hop"), "node", "phase", none.alias("type"), none.alias("called"), F.lit(None).cast("long").alias("candidates"), none.alias("parent"), none.alias("parent_phase"), F.lit(0).cast("long").alias("dropped"))
    # one step needs the calls of the starts alone
    with dealt(ways(graph, include_resolved, own.select(F.col("node").alias("id")) if depth == 1 else None), "node") as table:
        for hop in range(1, depth + 1):
            new = _new_states(front, table, seen)
            each = lambda new: new.join(held, "block").where(F.getbit("bits", F.col("bit")) == 1)  # noqa: E731, B023
            if limit is not None:
                rows = stored(each(new).select("start", "block", "bit", *STATE))
                counts = rows.groupBy("start").agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("dropped"))
                rows = stored(top_per_group(rows, ["start"], [F.desc(layer_priority(F.col("node"))), "node", "phase"], limit).join(counts, "start"))
                front = rows.select("block", "node", "phase", one.alias("bits"))
            else:
                new = stored(new)
                rows, front = each(new).withColumn("dropped", F.lit(0).cast("long")), new
            front = stored(front.groupBy("block", "node", "phase").agg(F.bit_or("bits").alias("bits")))
            if front.isEmpty():
                break
            found, seen = found.unionByName(rows.select("start", F.lit(hop).alias("hop"), *STATE, "dropped")), seen.unionByName(front)
    return found


#: What is known of a state besides its start and hop.
STATE = ("node", "phase", "type", "called", "candidates", "parent", "parent_phase")


def _new_states(front: DataFrame, ways: DataFrame, seen: DataFrame) -> DataFrame:
    """(block, bits, and `STATE`): the states one step from `front` that are not `seen` (block, node, phase, bits), by the first state that leads to each.

    What leads to a state, and what was seen of it, is sorted and passed over once; a row keeps those starts that no earlier one had.
    """
    step = front.join(ways, "node").withColumn("next", _next()).where("next IS NOT NULL")
    step = step.select("block", "bits", F.col("to").alias("node"), F.col("next").alias("phase"), "type", "called", "candidates", F.col("node").alias("parent"), F.col("phase").alias("parent_phase"))
    all_ = seen.withColumn("_seen", F.lit(0)).unionByName(step.withColumn("_seen", F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy("block", "node", "phase").orderBy("_seen", "parent", "parent_phase", "type").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("bits").over(before), F.lit(0).cast("long"))))
    return all_.withColumn("bits", fresh).where("_seen = 1 AND bits <> 0").select("block", "bits", *STATE)


def _edges_by_section(graph: CodeGraph, include_resolved: bool, wanted: DataFrame) -> DataFrame:
    """(subject, section, kind, from_id, to_id, via): the edges that say something about a subject in `wanted`, from one pass over them."""
    row = lambda section, subject: F.struct(F.lit(section).alias("section"), subject.alias("subject"))
    at = lambda c: F.array(F.lower(F.col(c)))
    scoped = F.array_union(owners(F.lower("from_id")), owners(F.lower("to_id")))
    of = lambda section, subjects: F.transform(subjects, lambda s: row(section, s))
    kinds = (
        F.when(F.col("type") == "ROUTES_TO", of("route_entries", at("to_id")))
        .when(F.col("type") == "BLADE_USES_ACTION", of("blade_entries", at("to_id")))
        .when(F.col("type").isin("ASSIGNS", "READS_FIELD"), of("field_assignments", scoped))
        .when(F.col("type").isin("FLOWS_TO", "ARGUMENT_TO"), of("field_flows", scoped))
        .when(F.col("type").isin("VALIDATES", "VALIDATES_FIELD"), of("validates", at("from_id")))
        .when(F.col("type") == "PERSISTS", of("persists", at("from_id")))
        .when(F.col("type") == "REFERENCES", of("config_refs", at("from_id")))
    )
    out = F.when(F.col("type").isin("ASSIGNS", "FLOWS_TO", "ARGUMENT_TO"), F.array(row("out", F.lower("from_id")))).otherwise(F.array().cast("array<struct<section:string,subject:string>>"))
    all_ = F.concat(F.coalesce(kinds, F.array().cast("array<struct<section:string,subject:string>>")), out)
    columns = [F.col("type").alias("kind"), "from_id", "to_id", "via"]
    # most edges are calls, which are about their callee alone and need no list of subjects
    each = graph.edges.where(visible_call(include_resolved)).select(F.lit("calls").alias("section"), F.lower("to_id").alias("subject"), *columns)
    each = each.unionByName(graph.edges.where("type <> 'CALLS'").select(F.explode(all_).alias("s"), *columns).select("s.*", "kind", "from_id", "to_id", "via"))
    # most edges are about other subjects: they go before anything else is asked of them
    each = stored(each.join(wanted.select("subject"), "subject", "left_semi"))
    callers = graph.nodes.select(F.col("id").alias("from_id"))
    return each.where("section <> 'calls'").unionByName(each.where("section = 'calls'").join(callers, "from_id", "left_semi").select(*each.columns)).distinct()


def _subjects(graph: CodeGraph, targets: DataFrame, limit: int) -> DataFrame:
    """(target, kind, subject, most): the methods, or other nodes, whose surroundings make up a target's."""
    own = stored(graph.nodes.join(targets.select("id"), "id", "left_semi").select(F.col("id").alias("target"), "type"))
    end = F.col("type").isin("api_endpoint", "http_endpoint")
    kind = F.when(F.col("type") == "method", "method").when(F.col("type") == "class", "class").when(end, "endpoint").otherwise("other")
    own = own.select("target", kind.alias("kind"))
    methods = graph.nodes.where("type = 'method'").select(F.col("parent").alias("target"), F.col("id").alias("subject"))
    first = top_per_group(methods.join(own.where("kind = 'class'"), "target", "left_semi"), ["target"], ["subject"], CLASS_METHODS)
    handlers = route_handlers(graph, 1).select(F.col("endpoint").alias("target"), F.col("handler").alias("subject"))
    return (
        own.where("kind IN ('method', 'other')").select("target", "kind", F.col("target").alias("subject"), F.lit(limit).alias("most"))
        .unionByName(first.select("target", F.lit("class").alias("kind"), "subject", F.lit(max(5, limit // 2)).alias("most")))
        .unionByName(own.where("kind = 'class'").select("target", F.lit("whole").alias("kind"), F.col("target").alias("subject"), F.lit(limit).alias("most")))
        .unionByName(own.where("kind = 'endpoint'").join(handlers, "target").select("target", "kind", "subject", F.lit(limit).alias("most")))
    )


#: Sections of a context, and which kinds of subject give them.
_ALL = ("method", "class")
SECTIONS = {
    "route_entries": _ALL, "blade_entries": _ALL, "calls": _ALL, "http_upstream": _ALL, "http_downstream": (*_ALL, "whole", "other"),
    "field_assignments": (*_ALL, "endpoint"), "field_flows": (*_ALL, "endpoint"), "validates": (*_ALL, "endpoint"), "persists": (*_ALL, "endpoint"), "config_refs": (*_ALL, "endpoint"), "out": ("other",),
}


def navigation_context(graph: CodeGraph, targets: DataFrame, limit: int = 20, include_resolved: bool = False) -> DataFrame:
    """(target, section, kind, from_id, to_id, via, place): what surrounds each target, in sections of `limit` rows at most.

    Sections: route_entries, blade_entries, graph_entries (calls, then routes, then views; clients, then calls for a route), http_upstream, http_downstream,
    field_assignments, field_flows, validates, persists, config_refs. A class takes those of its first methods together with the routes of all its members; an
    endpoint takes the fields of its handler, its own route, and that route's clients; anything else has what it requests and passes on.
    Reads of a field that an assignment from the request continues, and flows that a known argument continues, are left out.
    """
    subjects = stored(_subjects(graph, targets, limit))
    by_edge = _edges_by_section(graph, include_resolved, subjects.select(F.lower("subject").alias("subject")))
    requested = graph.edges.where("type = 'HTTP_REQUEST'").select(F.col("from_id").alias("client"), F.col("to_id").alias("endpoint"))
    asks = requested.join(route_handlers(graph, None), "endpoint").select(F.lower("handler").alias("subject"), F.lit("http_upstream").alias("section"), F.lit("HTTP_REQUEST").alias("kind"), F.col("client").alias("from_id"), F.col("endpoint").alias("to_id"), F.col("handler").alias("via"))
    asked = http_downstream(graph, limit).select(F.lower("client").alias("subject"), F.lit("http_downstream").alias("section"), F.lit("HTTP_REQUEST").alias("kind"), F.col("client").alias("from_id"), F.col("endpoint").alias("to_id"), F.col("handler").alias("via"))
    rows = by_edge.unionByName(asks.distinct()).unionByName(asked.distinct())
    gives = F.create_map(*[x for k, v in SECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    near = subjects.select("target", F.col("kind").alias("of"), F.col("subject").alias("own"), F.lower("subject").alias("subject"), "most").join(rows, "subject").where(F.array_contains(gives[F.col("section")], F.col("of")))
    out = F.col("section") == "out"
    near = near.withColumn("section", F.when(out & (F.col("kind") == "ASSIGNS"), "field_assignments").when(out, "field_flows").otherwise(F.col("section")))
    kept = stored(_unread(stored(_first(near))))
    routed = _route_rows(graph, targets, limit, include_resolved)
    members = _class_routes(graph, subjects, limit)
    calls = kept.where("section = 'calls'")
    entries = calls.unionByName(kept.where("section IN ('route_entries', 'blade_entries')")).withColumn("section", F.lit("graph_entries"))
    columns = ["target", "section", "kind", "from_id", "to_id", "via"]
    all_ = kept.where("section <> 'calls'").select(*columns).unionByName(entries.select(*columns)).unionByName(routed).unionByName(members).distinct()
    order = F.when(F.col("section") != "graph_entries", 0).when(F.col("kind").isin("HTTP_REQUEST", "CALLS"), F.when(F.col("kind") == "HTTP_REQUEST", 0).otherwise(1)).when(F.col("kind") == "ROUTES_TO", 2).otherwise(3)
    return _placed(all_.withColumn("_o", order), limit).select(*columns, "place")


def _first(near: DataFrame) -> DataFrame:
    """The first `most` rows of each section of each subject."""
    w = Window.partitionBy("target", "own", "section").orderBy("kind", "from_id", "to_id", F.asc_nulls_first("via"))
    return near.withColumn("_n", F.row_number().over(w)).where("_n <= most").drop("_n")


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("target", "section").orderBy("_o", "kind", "from_id", "to_id", F.asc_nulls_first("via"))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def _unread(rows: DataFrame) -> DataFrame:
    """Without reads of fields that an assignment from the request continues, and flows that a known argument continues."""
    key = ["target", "own"]
    taken = rows.where("section = 'field_assignments' AND kind = 'ASSIGNS' AND startswith(from_id, 'request_field:')").select(*key, F.col("from_id").alias("to_id")).distinct().withColumn("_gone", F.lit(True))
    known = rows.where("section = 'field_flows' AND kind = 'ARGUMENT_TO'").select(*key, "from_id", F.coalesce("via", F.lit("")).alias("_via")).distinct().withColumn("_passed", F.lit(True))
    marked = rows.withColumn("_via", F.coalesce("via", F.lit(""))).join(taken, [*key, "to_id"], "left").join(known, [*key, "from_id", "_via"], "left")
    gone = (F.col("kind") == "READS_FIELD") & F.coalesce("_gone", F.lit(False)) & (F.col("section") == "field_assignments")
    passed = (F.col("kind") == "FLOWS_TO") & F.coalesce("_passed", F.lit(False)) & (F.col("section") == "field_flows")
    return marked.where(~gone & ~passed).select(*rows.columns)


def _route_rows(graph: CodeGraph, targets: DataFrame, limit: int, include_resolved: bool) -> DataFrame:
    """Sections of endpoints: the route with its handler, that route's clients, and who reaches both."""
    ends = graph.nodes.where("type IN ('api_endpoint', 'http_endpoint')").join(targets.select("id"), "id", "left_semi").select(F.col("id").alias("target"))
    routes = graph.edges.where("type = 'ROUTES_TO'").select(F.col("from_id").alias("route"), F.col("to_id").alias("handler"))
    resolved = graph.edges.where("type = 'RESOLVES_TO'").select(F.col("from_id").alias("target"), F.col("to_id").alias("route")).join(ends, "target", "left_semi").unionByName(ends.select("target", F.col("target").alias("route")))
    pair = stored(resolved.join(routes, "route").groupBy("target").agg(F.min("route").alias("route"), F.min("handler").alias("handler")))
    null = F.lit(None).cast("string").alias("via")
    own = pair.select("target", F.lit("route_entries").alias("section"), F.lit("ROUTES_TO").alias("kind"), F.col("route").alias("from_id"), F.col("handler").alias("to_id"), null)
    clients = top_per_group(http_clients(graph, None).select(F.col("endpoint").alias("route"), "client").join(pair, "route"), ["target"], ["client"], limit)
    up = clients.select("target", F.lit("http_upstream").alias("section"), F.lit("HTTP_REQUEST").alias("kind"), F.col("client").alias("from_id"), F.col("route").alias("to_id"), null)
    scoped = route_scoped_entries(graph, pair.select(F.col("route").alias("endpoint"), "handler"), limit, include_resolved)
    client = F.col("kind") == "http_client"
    scoped = scoped.select(F.col("endpoint").alias("route"), "handler", F.when(client, "HTTP_REQUEST").otherwise("CALLS").alias("kind"), "from_id", F.when(client, F.col("endpoint")).otherwise(F.col("handler")).alias("to_id"))
    entries = pair.join(scoped, ["route", "handler"]).select("target", F.lit("graph_entries").alias("section"), "kind", "from_id", "to_id", null)
    return own.unionByName(up).unionByName(entries)


def _class_routes(graph: CodeGraph, subjects: DataFrame, limit: int) -> DataFrame:
    """Routes to any member of the classes asked for."""
    whole = subjects.where("kind = 'whole'").select("target", F.lower("target").alias("k"))
    routes = graph.edges.where("type = 'ROUTES_TO' AND contains(to_id, '::')").select("from_id", "to_id", F.explode(owners(F.lower("to_id"))).alias("k"))
    found = routes.join(whole, "k").where(F.lower("to_id") != F.col("k")).select("target", "from_id", "to_id").distinct()
    return top_per_group(found, ["target"], ["from_id", "to_id"], limit).select("target", F.lit("route_entries").alias("section"), F.lit("ROUTES_TO").alias("kind"), "from_id", "to_id", F.lit(None).cast("string").alias("via"))


def context_counts(graph: CodeGraph, context: DataFrame, calls: DataFrame) -> DataFrame:
    """One row for each target (id): type, parent and how many rows each section has; `calls` (target, id) are its callees. With warnings."""
    n = lambda name, *sections: F.count_if(F.col("section").isin(*sections)).alias(name)
    sums = context.groupBy(F.col("target").alias("id")).agg(
        n("routes", "route_entries"), n("views", "blade_entries"), n("callers", "graph_entries"), n("requests", "http_downstream"), n("fields", "field_assignments"),
        n("flows", "field_flows"), n("validated", "validates"), n("persisted", "persists"),
    )
    called = calls.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("callees"))
    names = [*(c for c in sums.columns if c != "id"), "callees"]
    return graph.nodes.select("id", "type", "parent").join(sums.join(called, "id", "full_outer"), "id").fillna(0, names)


def coverage(counts: DataFrame, rendered: DataFrame | None = None, reads: DataFrame | None = None) -> DataFrame:
    """Adds warnings, complete, partial and missing to `context_counts`: which parts of a flow the graph knows. `rendered` and `reads` are ids with such."""
    has = lambda df, name: counts.select("id").where("false").withColumn(name, F.lit(True)) if df is None else df.select("id").distinct().withColumn(name, F.lit(True))
    rows = counts.join(has(rendered, "_rendered"), "id", "left").join(has(reads, "_reads"), "id", "left")
    c, yes = F.col, lambda n: F.coalesce(n, F.lit(False))
    entry = (c("routes") > 0) | (c("views") > 0) | (c("callers") > 0)
    passes = (c("callees") > 0) & (c("fields") > 0) & (c("flows") == 0)
    needed = {"entry": entry, "intake": c("fields") > 0, "validation": c("validated") > 0, "calls": (c("callees") > 0) | (c("requests") > 0)}
    extra = {"rendered components": yes(c("_rendered")), "HTTP downstream": c("requests") > 0, "field flow to callees": c("flows") > 0, "persistence": c("persisted") > 0, "reads": yes(c("_reads"))}
    some = lambda tests: F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    out = rows.withColumns({"complete": some(needed | extra), "partial": some({"field flow to callees": passes}), "missing": some({k: ~t for k, t in needed.items()})})
    return navigation_warnings(out).drop("_rendered", "_reads")
