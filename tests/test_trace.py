"""Traces, rewritten callees and surroundings of a small flow."""

from collections import Counter

import pytest

from tests.joins import most_rows
from weftgraph.model import CodeGraph
from weftgraph.operators import trace

NODES = [
    ("js:p/a.vue", None, "js_module", "p/a.vue"), ("js:p/a.vue::load", None, "js_function", "p/a.vue"), ("vue:a", None, "vue_component", "p/a.vue"),
    ("http:POST:/api/pay", None, "http_endpoint", None), ("api:POST:pay", None, "api_endpoint", "routes/api.php"),
    ("PayController", None, "class", "PayController.php"), ("PayController::store", "PayController", "method", "PayController.php"), ("PayController::show", "PayController", "method", "PayController.php"),
    ("GateInterface", None, "interface", "GateInterface.php"), ("GateInterface::charge", "GateInterface", "method", "GateInterface.php"),
    ("CardGate", None, "class", "CardGate.php"), ("CardGate::charge", "CardGate", "method", "CardGate.php"), ("FakeGate", None, "class", "tests/FakeGate.php"), ("FakeGate::charge", "FakeGate", "method", "tests/FakeGate.php"),
    ("BaseRepo", None, "class", "BaseRepo.php"), ("BaseRepo::save", "BaseRepo", "method", "BaseRepo.php"), ("PayRepo", None, "class", "PayRepo.php"), ("PayRepo::save", "PayRepo", "external", None),
    ("LogInterface", None, "interface", "LogInterface.php"), ("LogInterface::write", "LogInterface", "method", "LogInterface.php"), ("A", None, "class", "A.php"), ("A::write", "A", "method", "A.php"), ("B", None, "class", "B.php"), ("B::write", "B", "method", "B.php"),
]
EDGES = [
    ("js:p/a.vue::load", "http:POST:/api/pay", "HTTP_REQUEST", None, None), ("http:POST:/api/pay", "api:POST:pay", "RESOLVES_TO", None, None), ("api:POST:pay", "PayController::store", "ROUTES_TO", None, None),
    ("PayController::store", "GateInterface::charge", "CALLS", None, None), ("CardGate", "GateInterface", "IMPLEMENTS", None, None), ("FakeGate", "GateInterface", "IMPLEMENTS", None, None),
    ("CardGate::charge", "PayRepo::save", "CALLS", None, None), ("PayRepo", "BaseRepo", "EXTENDS", None, None), ("BaseRepo::save", "PayController::store", "CALLS", None, None),
    ("PayController::store", "LogInterface::write", "CALLS", None, None), ("A", "LogInterface", "IMPLEMENTS", None, None), ("B", "LogInterface", "IMPLEMENTS", None, None), ("PayController::show", "LogInterface::write", "CALLS", "STATIC", None),
    ("PayController::store", "missing::x", "CALLS", None, None), ("request_field:sum", "PayController::store::$sum", "ASSIGNS", None, None), ("PayController::store", "request_field:sum", "READS_FIELD", None, None),
    ("PayController::store", "request_field:note", "READS_FIELD", None, None), ("PayController::store", "request_field:sum", "VALIDATES", None, None),
]


@pytest.fixture(scope="module")
def flow(spark):
    return CodeGraph.of(spark.createDataFrame(NODES, "id string, parent string, type string, file string").selectExpr("*", "substring_index(id, '::', -1) AS name"), spark.createDataFrame(EDGES, "from_id string, to_id string, type string, call_type string, via string").selectExpr("*", "concat_ws('>', from_id, to_id, type) AS id"))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_trace_from_a_component_to_the_data_layer(spark, flow):
    rows = trace.trace(flow, ids(spark, "vue:a", "api:POST:pay", "no"), 8).collect()
    got = {(r.start, r.node, r.phase): (r.hop, r.parent, r.called) for r in rows}
    assert got == {
        ("vue:a", "js:p/a.vue", "call"): (0, None, None),
        ("vue:a", "http:POST:/api/pay", "request"): (1, "js:p/a.vue", "http:POST:/api/pay"),
        ("vue:a", "api:POST:pay", "bridge"): (2, "http:POST:/api/pay", "api:POST:pay"),
        ("vue:a", "PayController::store", "handler"): (3, "api:POST:pay", "PayController::store"),
        ("vue:a", "CardGate::charge", "call"): (4, "PayController::store", "GateInterface::charge"),  # one implementation in source code
        ("vue:a", "LogInterface::write", "call"): (4, "PayController::store", "LogInterface::write"),  # two: it stays
        ("vue:a", "BaseRepo::save", "call"): (5, "CardGate::charge", "PayRepo::save"),  # from the class above
        ("vue:a", "PayController::store", "call"): (6, "BaseRepo::save", "PayController::store"),  # another phase of a node seen before
        ("api:POST:pay", "api:POST:pay", "route"): (0, None, None),
        ("api:POST:pay", "PayController::store", "handler"): (1, "api:POST:pay", "PayController::store"),
        ("api:POST:pay", "CardGate::charge", "call"): (2, "PayController::store", "GateInterface::charge"),
        ("api:POST:pay", "LogInterface::write", "call"): (2, "PayController::store", "LogInterface::write"),
        ("api:POST:pay", "BaseRepo::save", "call"): (3, "CardGate::charge", "PayRepo::save"),
        ("api:POST:pay", "PayController::store", "call"): (4, "BaseRepo::save", "PayController::store"),
    }
    some = {(r.node, r.dropped) for r in trace.trace(flow, ids(spark, "PayController::store"), 1, 1).where("hop = 1").collect()}
    assert some == {("CardGate::charge", 1)}


def test_static_calls_are_not_rewritten(spark, flow):
    calls = spark.createDataFrame([("GateInterface::charge", "STATIC", "x"), ("GateInterface::charge", None, "x"), ("LogInterface::write", None, "x"), ("PayRepo::save", None, None), ("plain", None, None)], "id string, call_type string, file string")
    got = {(r.id, r.call_type): (r.target, r.candidates) for r in trace.traversal_targets(flow, calls).collect()}
    assert got == {("GateInterface::charge", "STATIC"): ("GateInterface::charge", None), ("GateInterface::charge", None): ("CardGate::charge", 1), ("LogInterface::write", None): ("LogInterface::write", 2), ("PayRepo::save", None): ("BaseRepo::save", None), ("plain", None): ("plain", None)}


def test_surroundings_and_coverage(spark, flow):
    targets = ids(spark, "PayController::store", "PayController::show", "PayController", "http:POST:/api/pay", "js:p/a.vue::load")
    context = trace.navigation_context(flow, targets)
    rows = {(r.target, r.section, r.from_id, r.to_id) for r in context.collect()}
    store = {(s, a, b) for t, s, a, b in rows if t == "PayController::store"}
    assert store == {
        ("route_entries", "api:POST:pay", "PayController::store"), ("graph_entries", "BaseRepo::save", "PayController::store"), ("graph_entries", "api:POST:pay", "PayController::store"),
        ("http_upstream", "js:p/a.vue::load", "http:POST:/api/pay"), ("field_assignments", "request_field:sum", "PayController::store::$sum"), ("field_assignments", "PayController::store", "request_field:note"),
        ("validates", "PayController::store", "request_field:sum"),
    }
    assert {(s, a, b) for t, s, a, b in rows if t == "PayController"} == store
    assert ("http:POST:/api/pay", "graph_entries", "js:p/a.vue::load", "api:POST:pay") in rows and ("js:p/a.vue::load", "http_downstream", "js:p/a.vue::load", "http:POST:/api/pay") in rows
    calls = trace.trace(flow, targets, 1).where("hop = 1 AND phase = 'call'").selectExpr("start AS target", "node AS id")
    got = {r.id: (r.complete, r.partial, r.missing, r.warnings) for r in trace.coverage(trace.context_counts(flow, context, calls)).collect()}
    assert got["PayController::store"] == (["entry", "intake", "validation", "calls"], ["field flow to callees"], [], ["no_flow"])
    assert got["PayController::show"] == (["calls"], [], ["entry", "intake", "validation"], ["no_entry", "no_route", "no_fields"])


def test_starts_travel_together(spark, monkeypatch):
    """70 routes of one handler: more than a number's bits, all paths alike, and each call followed once for 64 starts."""
    routes = [(f"api:GET:/{n}", None, "api_endpoint", None) for n in range(70)]
    methods = [(f"m{n}", None, "method", "m") for n in range(31)]
    graph = CodeGraph.of(spark.createDataFrame(routes + methods, "id string, parent string, type string, file string"), spark.createDataFrame([(r[0], "m0", "ROUTES_TO") for r in routes] + [("m0", f"m{n}", "CALLS") for n in range(1, 31)] + [("m1", "m0", "CALLS")], "from_id string, to_id string, type string"))
    followed, new = [], trace._new_states
    monkeypatch.setattr(trace, "_new_states", lambda *a: followed.append(new(*a).count()) or new(*a))
    rows = trace.trace(graph, graph.nodes.where("type = 'api_endpoint'").select("id"), 4).collect()
    want = {(r[0], h, n, p) for r in routes for h, n, p in [(0, r[0], "route"), (1, "m0", "handler"), *((2, f"m{n}", "call") for n in range(1, 31)), (3, "m0", "call")]}
    assert {(r.start, r.hop, r.node, r.parent) for r in rows if r.hop == 3} == {(r[0], 3, "m0", "m1") for r in routes}
    assert len(rows) == len(want) and {(r.start, r.hop, r.node, r.phase) for r in rows} == want
    assert max(followed[1:]) <= 30 * spark.sparkContext.defaultParallelism < 30 * 70  # the hop to the handler comes from 70 routes


def test_edges_of_other_subjects_go_first(spark):
    """Only edges about what is asked for are kept, before callers are looked up."""
    calls = [(f"x{n}", f"x{n + 1}", "CALLS") for n in range(100)] + [("x1", "M", "CALLS"), ("gone", "M", "CALLS")]
    graph = CodeGraph.of(spark.createDataFrame([("M",), *((f"x{n}",) for n in range(101))], "id string"), spark.createDataFrame(calls, "from_id string, to_id string, type string"))
    rows = trace._edges_by_section(graph, False, spark.createDataFrame([("m",), ("m",)], "subject string")).collect()
    assert [(r.subject, r.section, r.from_id) for r in rows] == [("m", "calls", "x1")]


def test_plain_callees_meet_the_abstract_classes_alone(spark):
    """What has a file and no abstract class goes on where it is, without meeting implementations and inheritance."""
    nodes = [(f"P{i}::m", f"P{i}", "method", "m", "p.php") for i in range(300)] + [("OneInterface::m", "OneInterface", "method", "m", "i.php"), ("Impl::m", "Impl", "method", "m", "a.php"), ("Test::m", "Test", "method", "m", "tests/ATest.php"), ("Sub::m", "Sub", "external", "m", None), ("Impl", None, "class", "Impl", "a.php")]
    edges = [("Impl", "OneInterface", "IMPLEMENTS"), ("Test", "OneInterface", "IMPLEMENTS"), ("Sub", "Impl", "EXTENDS")]
    g = CodeGraph.of(spark.createDataFrame(nodes, "id string, parent string, type string, name string, file string"), spark.createDataFrame(edges, "from_id string, to_id string, type string"))
    led = trace._led(g, g.nodes.select("id", "file"))
    got = {r.id: (r._to, r.candidates) for r in led.collect()}
    assert got == {i: (i, None) for i, *_ in nodes} | {"OneInterface::m": ("Impl::m", 1), "Sub::m": ("Impl::m", None)}
    plan = led._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan


def test_calls_make_no_lists_of_subjects(spark, monkeypatch):
    """A call is about its callee alone: only other edges are taken apart."""
    calls = [(f"a::x{i}", "b::m", "CALLS") for i in range(400)] + [("r", "b::m", "ROUTES_TO"), ("b::m::p", "c::m", "FLOWS_TO")]
    nodes = sorted({(x, "method", x.split("::")[-1]) for e in calls for x in e[:2]})
    g = CodeGraph.of(spark.createDataFrame(nodes, "id string, type string, name string"), spark.createDataFrame(calls, "from_id string, to_id string, type string"))
    made, real = [], trace.stored
    monkeypatch.setattr(trace, "stored", lambda df: (made.append(most_rows(df, "Generate")), real(df))[1])
    found = trace._edges_by_section(g, False, spark.createDataFrame([("b::m",)], "subject string"))
    assert sorted((r.section, r.kind, n) for r, n in Counter(found.select("section", "kind").collect()).items()) == [("calls", "CALLS", 400), ("field_flows", "FLOWS_TO", 1), ("route_entries", "ROUTES_TO", 1)]
    assert max(made) < 20
