"""Traversals: level by level over edges, for many starts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.predicates import framework_noise, layer_priority, visible_call
from weftgraph.model import CodeGraph
from weftgraph.operators import components
from weftgraph.sources.graphs import top_per_group
from weftgraph.sources.storage import cut, stored


def bfs_levels(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(batch, node, lvl): nodes within `depth` steps along (src, dst), or however far, each at its least distance. Seeds are (batch, node)."""
    found = cut(seeds.select("batch", "node").distinct().withColumn("lvl", F.lit(0)))
    front, lvl = found, 0
    while depth is None or lvl < depth:
        lvl += 1
        step = front.join(edges.select(F.col("src").alias("node"), F.col("dst")), "node").select("batch", F.col("dst").alias("node")).distinct()
        front = cut(step.join(found.select("batch", "node"), ["batch", "node"], "left_anti").withColumn("lvl", F.lit(lvl)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, dist): all that each source reaches along (src, dst), by doubling the distance in each round, until a round adds nothing."""
    step = cut(edges.where("src <> dst").select("src", "dst").distinct().withColumn("dist", F.lit(1)))
    found, size = step, step.count()
    while True:
        left = found.select("src", F.col("dst").alias("mid"), F.col("dist").alias("d1"))
        right = found.select(F.col("src").alias("mid"), "dst", F.col("dist").alias("d2"))
        longer = left.join(right, "mid").where("src <> dst").select("src", "dst", (F.col("d1") + F.col("d2")).alias("dist"))
        more = cut(found.unionByName(longer).groupBy("src", "dst").agg(F.min("dist").alias("dist")))
        before, size, found = size, more.count(), more
        if size == before:
            return found


def call_chain(graph: CodeGraph, starts: DataFrame, depth: int = 1, limit: int = 20, per_hop: int | None = None, include_resolved: bool = False) -> DataFrame:
    """(start, id, depth, parent): callees level by level, `limit` in all for each start.

    Two places are kept for each level still to come; a level with more callees than places takes those of the weightiest
    layers. A callee belongs to the first caller, by id, that reaches it, and no node is visited twice.
    """
    per_hop = per_hop or limit
    known = graph.nodes.select(F.col("id").alias("to_id"))
    calls = stored(graph.edges.where(visible_call(include_resolved) & ~framework_noise(F.col("to_id"))).select("from_id", "to_id"))
    seen = front = stored(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).distinct())
    for lvl in range(1, depth + 1):
        at = front.select("start", F.col("id").alias("from_id"))
        # only callers that the level has reached are looked at: their calls are few, if it is small
        own = stored(calls.join(at.select("from_id"), "from_id", "left_semi").select("from_id", "to_id"))
        first = top_per_group(own.join(known, "to_id").select("from_id", "to_id").distinct(), ["from_id"], ["to_id"], per_hop)
        step = at.join(first, "from_id").join(seen.select("start", F.col("id").alias("to_id")), ["start", "to_id"], "left_anti")
        new = step.groupBy("start", "to_id").agg(F.min("from_id").alias("parent"))
        used = seen.where("depth > 0").groupBy("start").agg(F.count("*").alias("used"))
        left = F.lit(limit) - F.coalesce("used", F.lit(0))
        places = F.greatest(F.lit(1), left - F.least(left - 1, F.lit((depth - lvl) * 2)))
        ranked = new.join(used, "start", "left").where(left > 0).withColumn("places", places)
        order = Window.partitionBy("start").orderBy(F.desc(layer_priority(F.col("to_id"))), "to_id")
        front = stored(ranked.withColumn("_n", F.row_number().over(order)).where("_n <= places").select("start", F.col("to_id").alias("id"), F.lit(lvl).alias("depth"), "parent"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def cycles(graph: CodeGraph, longest: int = 12, include_resolved: bool = False) -> DataFrame:
    """The cycles of `cycles_up_to`, without its flag."""
    return cycles_up_to(graph, longest, include_resolved)[0]


def cycles_up_to(graph: CodeGraph, longest: int = 12, include_resolved: bool = False) -> tuple[DataFrame, bool]:
    """(path, length): each simple cycle of at most `longest` nodes once, from its smallest node; and whether paths were left that longer ones may follow.

    Loops of one node don't count. The depth is a feature of the analysis: paths multiply with each step, inside components only.
    """
    found, more = components.cycles(components.call_edges(graph, include_resolved), graph.nodes, longest=longest)
    return found.select("path", "length"), more
