"""Strongly connected components, and cycles inside them.

Components come from colouring: every node takes the name, of those that reach it, with the largest hash, along the edges, until nothing changes; a node that keeps its own
name is a root, and what reaches it, backwards and among nodes of its colour alone, is its component. Nodes that no cycle can pass are dropped before
every round while they are many, and so are the components found, with all edges between different colours, which lie in no component. Every step is a join of edges with the
names of their ends and an aggregation with partial results, so a hub's edges don't meet in one task; rounds follow the graph's breadth, not its size.
Once no more than SERIAL edges are left, rounds over few rows would cost more than the work in them: one task then finishes these, whatever the size of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import RESOLVED, visible_call
from weftgraph.model import CodeGraph
from weftgraph.sources.graphs import top_per_group
from weftgraph.sources.storage import cut

#: Steps between two checkpoints; edges that one task may finish.
HOPS, SERIAL = 2, 300_000


def call_edges(graph: CodeGraph, include_resolved: bool = False, include_depends_on: bool = False) -> DataFrame:
    """(src, dst, kind): one row for each pair of nodes, with the kind of the edge recorded first: CALLS, CALLS:..._RESOLVED, DEPENDS_ON."""
    use = visible_call(include_resolved) | (F.col("type") == "DEPENDS_ON") if include_depends_on else visible_call(include_resolved)
    kind = F.when((F.col("type") == "CALLS") & F.coalesce(F.col("call_type").isin(*RESOLVED), F.lit(False)), F.concat(F.lit("CALLS:"), "call_type")).otherwise(F.col("type"))
    e = graph.edges.where(use & (F.col("from_id") != F.col("to_id")))
    return e.groupBy(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).agg(F.min_by(kind, F.struct(F.coalesce("ord", F.lit(0)), "id")).alias("kind"))


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges (src, dst, ...) without those that no cycle can pass, as long as a round drops a tenth of them; colouring takes care of the rest."""
    e, before = cut(edges), None
    while before is None or SERIAL < (n := e.count()) < 0.9 * before:
        before = n if before is not None else e.count()
        inner = e.select(F.col("src").alias("_n")).distinct().join(e.select(F.col("dst").alias("_n")).distinct(), "_n", "left_semi")
        e = cut(e.join(inner.select(F.col("_n").alias("src")), "src", "left_semi").join(inner.select(F.col("_n").alias("dst")), "dst", "left_semi").select(*edges.columns))
    return e


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that lies on a cycle of two nodes or more of (src, dst); a component is named after its largest node.

    Names are hashed so that roots lie anywhere: components are then found in few rounds, whatever the names.
    """
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    found = e.select(F.col("src").alias("id"), F.col("src").alias("component")).where("false")
    while (left := e.count()) > 0:
        if left <= SERIAL:
            found = cut(found.unionByName(_finished(e)))
            break
        e = trimmed(e)
        if e.count() <= SERIAL:
            continue
        colour = _coloured(e)
        of = lambda c, name: colour.select(F.col("id").alias(c), F.col("colour").alias(name))
        # an edge between colours lies in no component
        e = cut(e.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour")))
        own = _backwards(e)
        found = cut(found.unionByName(own.select("id", F.col("colour").alias("component"))))
        done = own.select("id")
        e = cut(e.join(done.select(F.col("id").alias("src")), "src", "left_anti").join(done.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    named = found.groupBy("component").agg(F.count("*").alias("n"), F.max("id").alias("largest")).where("n > 1")
    return found.join(named, "component").select("id", F.col("largest").alias("component"))


def _finished(e: DataFrame) -> DataFrame:
    """(id, component): the strongly connected components of SERIAL edges (src, dst) at most, found in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: dict[str, list[str]] = {}
        for batch in batches:
            for a, b in zip(batch["src"], batch["dst"], strict=True):
                ends.setdefault(a, []).append(b)
                ends.setdefault(b, [])
        rows = _tarjan(ends)
        yield pd.DataFrame(rows, columns=["id", "component"])

    return e.select("src", "dst").coalesce(1).mapInPandas(run, "id string, component string")


def _tarjan(ends: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(node, a node of its component) for every node."""
    low: dict[str, int] = {}
    stack, out, n = [], [], 0
    done: set[str] = set()
    for start in ends:
        todo = [] if start in low else [(start, iter(ends[start]), n)]
        while todo:
            v, rest, at = todo[-1]
            if v not in low:
                low[v], n = at, n + 1
                stack.append(v)
            for w in rest:
                if w not in low:
                    todo.append((w, iter(ends[w]), n))
                    break
                if w not in done:
                    low[v] = min(low[v], low[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == at:
                    while True:
                        w = stack.pop()
                        low[w] = len(ends)  # higher than any node still open
                        done.add(w)
                        out.append((w, v))
                        if w == v:
                            break
    return out


def _coloured(e: DataFrame) -> DataFrame:
    """(id, colour): the name with the largest hash that reaches each node. Only nodes whose colour changed pass it on, HOPS steps between two checkpoints."""
    name = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("name"))
    colour = cut(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", name).withColumn("moved", F.lit(True)))
    while not colour.where("moved").isEmpty():
        now = colour.withColumn("first", F.col("colour"))
        for _ in range(HOPS):
            passed = e.join(now.where("moved").select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("new"))
            now = now.join(passed, "id", "left").select("id", "first", F.greatest("colour", "new").alias("colour"), F.coalesce(F.col("new") > F.col("colour"), F.lit(False)).alias("moved"))
        colour = cut(now.select("id", "colour", "moved"))
    return colour.select("id", F.col("colour.name").alias("colour"))


def _backwards(e: DataFrame) -> DataFrame:
    """(id, colour): nodes that reach the root of their colour along (src, dst, colour)."""
    found = front = cut(e.select(F.col("colour").alias("id"), "colour").distinct())  # also roots that no cycle passes, so that these go
    while not front.isEmpty():
        seen, step = found, front
        for _ in range(HOPS):
            step = e.join(step.select(F.col("id").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct().join(seen.select("id"), "id", "left_anti")
            seen = seen.unionByName(step)
        before, found = found, cut(seen)
        front = found.join(before.select("id"), "id", "left_anti")
    return found


def cycles(edges: DataFrame, files: DataFrame, starts: DataFrame | None = None, longest: int = 12, limit: int | None = None) -> tuple[DataFrame, bool]:
    """(path, length, kinds, files) of each simple cycle of (src, dst, kind) with at most `longest` nodes, and whether longer ones may be left.

    A cycle is told once: from its smallest node, or, with `starts` (id, place), from that of its nodes which is asked for first; cycles that pass
    none of those are left out. Paths never leave a component and grow only through nodes that come later in that order. Shortest first, `limit` at most.
    `kinds` names the edges along the path and back, `files` those of `files` (id, file) that the nodes are in, sorted.
    """
    edges = cut(edges)
    scc = cut(strongly_connected(edges))
    of = lambda c, name: scc.select(F.col("id").alias(c), F.col("component").alias(name))
    inside = edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a = b").select("src", "dst", "kind")
    if starts is None:
        order = scc.select("id", F.lit(0).alias("place"))
    else:
        first = starts.groupBy("id").agg(F.min("place").alias("place"))
        order = scc.select("id").join(first, "id", "left").select("id", F.coalesce(F.col("place").cast("long"), F.lit(1 << 62)).alias("place"))
    place = lambda c, name: order.select(F.col("id").alias(c), F.struct(F.col("place"), F.col("id")).alias(name))
    e = cut(inside.join(place("src", "p"), "src").join(place("dst", "q"), "dst"))
    paths = e.where("p < q").select(F.col("p").alias("head"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"), F.array("kind").alias("kinds"))
    if starts is not None:
        paths = paths.join(starts.select(F.col("id").alias("_start")).distinct(), F.col("head.id") == F.col("_start"), "left_semi")
    found, n = None, 0
    for size in range(2, longest + 1):
        paths = cut(paths)
        if paths.isEmpty():
            break
        back = e.select(F.col("src").alias("last"), F.col("q").alias("head"), "kind")
        closed = cut(paths.join(back, ["last", "head"]).select("path", F.lit(size).alias("length"), F.array_append("kinds", F.col("kind")).alias("kinds")))
        found = closed if found is None else found.unionByName(closed)
        step = e.select(F.col("src").alias("last"), F.col("dst").alias("next"), "q", "kind")
        grown = paths.join(step, "last").where("q > head AND NOT array_contains(path, next)")
        paths = grown.select("head", F.col("next").alias("last"), F.array_append("path", F.col("next")).alias("path"), F.array_append("kinds", F.col("kind")).alias("kinds"))
        n += closed.count()
        if limit is not None and n >= limit:
            break  # longer ones sort behind these
    if found is None:
        return edges.sparkSession.createDataFrame([], "path array<string>, length int, kinds array<string>, files array<string>"), False
    found = found.withColumn("name", F.array_join(F.array_append("path", F.element_at("path", 1)), " -> "))
    if limit is not None:
        found = found.orderBy("length", "name").limit(limit)
    found = cut(found)
    held = found.select("name", F.explode("path").alias("id")).join(files.where("file IS NOT NULL").select("id", "file"), "id").groupBy("name").agg(F.array_sort(F.collect_set("file")).alias("files"))
    out = found.join(held, "name", "left").select("path", "length", "kinds", F.coalesce("files", F.array().cast("array<string>")).alias("files"))
    return out, not paths.isEmpty()


def cycles_from_nodes(graph: CodeGraph, starts: DataFrame, longest: int = 12, limit: int = 20, include_resolved: bool = False, include_depends_on: bool = False) -> DataFrame:
    """(path, length, kinds, files): the `limit` shortest cycles that pass one of `starts` (id, place), each from the one asked for first."""
    return cycles(call_edges(graph, include_resolved, include_depends_on), graph.nodes, starts, longest, limit)[0]


def component_sizes(graph: CodeGraph, include_resolved: bool = False, include_depends_on: bool = False, members: int = 5) -> DataFrame:
    """(component, size, edges, members): each component with the number of its nodes and inner edges, and its first nodes by name."""
    e = cut(call_edges(graph, include_resolved, include_depends_on))
    scc = cut(strongly_connected(e))
    of = lambda c, name: scc.select(F.col("id").alias(c), F.col("component").alias(name))
    inner = e.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a = b").groupBy(F.col("a").alias("component")).agg(F.count("*").alias("edges"))
    first = top_per_group(scc, ["component"], ["id"], members).groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return scc.groupBy("component").agg(F.count("*").alias("size")).join(inner, "component").join(first, "component").select("component", "size", "edges", "members")
