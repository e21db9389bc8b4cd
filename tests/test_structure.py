"""Inheritance, components and cycles against brute force, loops included."""

import random

import pytest

from weftgraph.model import CodeGraph
from weftgraph.operators import components, inheritance
from weftgraph.sources import storage


def graph(spark, edges, nodes=()):
    n = spark.createDataFrame([(x, "method", f"{x[0]}.php") for x in nodes] or [], "id string, type string, file string")
    return CodeGraph.of(n, spark.createDataFrame(edges, "from_id string, to_id string, type string, ord long").selectExpr("concat_ws('>', from_id, to_id, type, ord) AS id", "*"))


def chain(up, x):
    out = []
    while (x := up.get(x)) is not None and x not in out:
        out.append(x)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_inheritance_of_random_forests_with_loops(spark, seed):
    rng = random.Random(seed)
    names = [f"c{i}" for i in range(60)]
    up = {names[i]: names[rng.randrange(max(0, i - 4), i)] for i in range(1, 60) if rng.random() < 0.9}
    if seed == 2:  # a loop of three, and all that hangs on it
        up |= {"c10": "c12", "c11": "c10", "c12": "c11"}
    edges = [(a, b, "EXTENDS", 0) for a, b in up.items()] + [(a, "c0", "EXTENDS", 1) for a in list(up)[:20]]  # the first one counts
    edges += [(f"c{i}", f"t{i % 7}", "USES_TRAIT", 9 - i % 5) for i in range(0, 60, 3)] + [(f"c{i}", f"t{(i + 1) % 7}", "USES_TRAIT", 5) for i in range(0, 60, 3)]
    nodes = [f"c{i}::m" for i in range(0, 60, 9)] + [f"t{i}::m" for i in (1, 2, 4)] + ["c3::n"]
    g = graph(spark, edges, nodes)
    trees = inheritance.forest(inheritance.first_parents(g))
    got = {}
    for r in inheritance.chains(trees, spark.createDataFrame([(n,) for n in names], "id string")).collect():
        got.setdefault(r.id, {})[r.dist] = r.ancestor
    want = {n: [x for x in chain(up, n) if x != n] for n in names}
    assert {n: [got[n][d] for d in sorted(got[n])] for n in got} == {n: w for n, w in want.items() if w}
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(300)] + [("c5", "c5"), ("no", "no"), ("no", "c5"), ("c5", "no")]
    rows = inheritance.same_or_ancestor(trees, spark.createDataFrame(pairs, "ancestor string, descendant string")).collect()
    assert {(r.ancestor, r.descendant): r.holds for r in rows} == {(a, d): a == d or a in chain(up, d) for a, d in pairs}
    asked = [(n, m) for n in names for m in ("m", "n", "z")]
    traits = {}
    for a, b, kind, ord_ in edges:
        if kind == "USES_TRAIT":
            traits.setdefault(a, []).append((ord_, b))

    def brute(c, m):
        for x in dict.fromkeys([c, *chain(up, c)]):
            for owner in [x, *(t for _, t in sorted(traits.get(x, [])))]:
                if f"{owner}::{m}" in nodes:
                    return f"{owner}::{m}"

    found = {(r["class"], r.method): r.target for r in inheritance.lookup_method(g, spark.createDataFrame(asked, "class string, method string")).collect()}
    assert found == {a: t for a in asked if (t := brute(*a))}


def reach(adj, x):
    seen, todo = set(), [x]
    while todo:
        for y in adj.get(todo.pop(), ()):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


@pytest.mark.parametrize("n, m", [(30, 40), (25, 70)])
def test_components_against_reachability(spark, n, m):
    rng = random.Random(n)
    edges = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)] + [("n00", "n00"), ("x", "y"), ("y", "z")]
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    far = {x: reach(adj, x) for x in {v for e in edges for v in e}}
    groups = {x: {y for y in far if y == x or y in far[x] and x in far[y]} for x in far}
    got = {r.id: r.component for r in components.strongly_connected(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {x: max(g) for x, g in groups.items() if len(g) > 1}


def test_cycles_from_nodes(spark):
    edges = [("a", "b", "CALLS", 0), ("b", "a", "CALLS", 1), ("b", "c", "CALLS", 2), ("c", "a", "DEPENDS_ON", 3), ("c", "d", "CALLS", 4), ("d", "c", "CALLS", 5), ("d", "d", "CALLS", 6), ("c", "a", "CALLS", 7), ("e", "a", "CALLS", 8)]
    g = graph(spark, edges, "abcd")
    asked = spark.createDataFrame([("e", 0), ("c", 1), ("a", 2)], "id string, place int")
    rows = [(r.path, r.length, r.kinds, r.files) for r in components.cycles_from_nodes(g, asked, include_depends_on=True).collect()]
    assert sorted(rows) == sorted([
        (["c", "d"], 2, ["CALLS", "CALLS"], ["c.php", "d.php"]),
        (["a", "b"], 2, ["CALLS", "CALLS"], ["a.php", "b.php"]),
        (["c", "a", "b"], 3, ["DEPENDS_ON", "CALLS", "CALLS"], ["a.php", "b.php", "c.php"]),
    ])
    assert [r.path for r in components.cycles_from_nodes(g, asked, limit=1).collect()] == [["a", "b"]]
    assert components.cycles_from_nodes(g, asked.where("id = 'e'")).collect() == []
    none = spark.createDataFrame([], "src string, dst string, kind string")
    assert components.strongly_connected(none).collect() == [] and components.cycles(none, g.nodes)[0].collect() == []


def _step_graph(spark, n, seed):
    r = random.Random(seed)
    return {(r.randrange(n), r.randrange(n)) for _ in range(int(n * 1.3))}


@pytest.mark.parametrize("serial", [0, 20, 300_000])
def test_components_are_the_same_wherever_they_are_finished(spark, monkeypatch, serial):
    monkeypatch.setattr(components, "SERIAL", serial)
    pairs = _step_graph(spark, 60, 3) | {(60 + i, 60 + (i + 1) % 7) for i in range(7)}
    reach = {i: {i} for i in range(67)}
    while any([new - reach[a] and not reach[a].update(new) for a, b in pairs for new in [set(reach[b])]]):
        pass
    want = {(i, max(j for j in reach[i] if i in reach[j])) for i in range(67) if any(j != i and i in reach[j] for j in reach[i])}
    rows = components.strongly_connected(spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in pairs], "src string, dst string")).collect()
    assert {(int(r.id[1:]), int(r.component[1:])) for r in rows} == want and len(rows) == len(want)


def test_few_edges_are_finished_in_one_task(spark):
    tracker, before = spark.sparkContext.statusTracker(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    ring = spark.range(40).selectExpr("concat('n', id) AS src", "concat('n', (id + 1) % 40) AS dst")
    assert components.strongly_connected(ring).count() == 40
    assert len(tracker.getJobIdsForGroup(None)) - before < 40


def test_shortest_cycles_need_no_longer_paths(spark, monkeypatch):
    rows = [(f"a{i}", f"b{i}", "CALLS") for i in range(30)] + [(f"b{i}", f"a{i}", "CALLS") for i in range(30)] + [(f"b{i}", f"a{(i + 1) % 30}", "CALLS") for i in range(30)]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string")
    cuts = []
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(df.columns) or storage.cut(df))
    found, more = components.cycles(edges, spark.createDataFrame([], "id string, file string"), longest=12, limit=5)
    assert [(r.path, r.length) for r in found.orderBy("path").collect()] == [([f"a{i}", f"b{i}"], 2) for i in sorted(range(30), key=str)[:5]] and more
    assert sum("last" in c for c in cuts) == 1  # paths of two nodes, and none after
