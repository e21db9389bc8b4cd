"""Inheritance along the first recorded parent of each class: binary lifting over the forest, for whatever is asked.

The forest's jump tables say which class lies 1, 2, 4, ... steps up. They come from joining each table with itself, are as many as the
logarithm of the deepest chain, and never hold more than one row a class. Ancestors of the classes asked for are found in as many
joins; whether one class descends from another is a climb of exactly as many steps as their depths differ, a join for each
binary digit. No pairs of the whole forest are made. Classes on or under a loop of parents, which has no top, are told
apart by their number and answered by walking the loop.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.model import CodeGraph
from weftgraph.operators.traversal import bfs_levels
from weftgraph.sources.storage import cut


@dataclass(frozen=True)
class Forest:
    """Jump tables (id, up): 1, 2, 4, ... steps; and the parents (id, up) of classes that never come to a top."""

    jumps: list[DataFrame]
    looped: DataFrame


def first_parents(graph: CodeGraph) -> DataFrame:
    """(id, up): the parent that was recorded first."""
    e = graph.edges.where("type = 'EXTENDS' AND from_id <> to_id")
    return e.groupBy(F.col("from_id").alias("id")).agg(F.min_by("to_id", F.struct(F.coalesce("ord", F.lit(0)), "to_id")).alias("up"))


def forest(parents: DataFrame) -> Forest:
    """Jump tables over (id, up), until no chain is longer; a chain longer than there are classes runs in a loop."""
    parents = cut(parents.select("id", "up"))
    most = math.ceil(math.log2(parents.count() + 2))
    tables, last = [], parents
    while len(tables) <= most and not last.isEmpty():
        tables.append(last)
        last = cut(last.join(last.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up")))
    looped = parents.join(last.select("id"), "id", "left_semi")
    if last.isEmpty():
        return Forest(tables, looped)
    straight = parents.join(last.select("id"), "id", "left_anti")  # loops go, so that tables end again
    return Forest(forest(straight).jumps, cut(looped))


def chains(trees: Forest, ids: DataFrame) -> DataFrame:
    """(id, ancestor, dist) of the classes asked for, themselves not included."""
    found = cut(ids.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("dist")).distinct())
    for k, table in enumerate(trees.jumps):
        # all ancestors nearer than 2^k are there; 2^k steps from each lie the next as many
        far = found.join(table.select(F.col("id").alias("ancestor"), F.col("up")), "ancestor").select("id", F.col("up").alias("ancestor"), (F.col("dist") + (1 << k)).alias("dist"))
        found = cut(found.unionByName(far))
    if not trees.looped.isEmpty():
        walk = bfs_levels(trees.looped.select(F.col("id").alias("src"), F.col("up").alias("dst")), ids.join(trees.looped.select("id"), "id", "left_semi").select(F.col("id").alias("batch"), F.col("id").alias("node")))
        # the walk also passes what lies above a class that another way out of a loop leads to: there is none, as each has one parent
        found = found.join(trees.looped.select("id"), "id", "left_anti").unionByName(walk.select(F.col("batch").alias("id"), F.col("node").alias("ancestor"), F.col("lvl").alias("dist")))
    return found.where("dist > 0")


def same_or_ancestor(trees: Forest, pairs: DataFrame) -> DataFrame:
    """(ancestor, descendant, holds) of pairs of classes: whether they are one, or the second descends from the first."""
    pairs = cut(pairs.select("ancestor", "descendant").distinct())
    ends = pairs.select(F.explode(F.array("ancestor", "descendant")).alias("id")).distinct()
    depth = cut(_depths(trees, ends))
    of = lambda c, d: depth.select(F.col("id").alias(c), F.col("depth").alias(d))
    way = pairs.join(of("ancestor", "d_a"), "ancestor").join(of("descendant", "d_d"), "descendant").withColumn("left", F.col("d_d") - F.col("d_a")).withColumn("at", F.col("descendant"))
    way = way.where("left >= 0").select("ancestor", "descendant", "at", "left")
    for k, table in enumerate(trees.jumps):
        step = table.select(F.col("id").alias("at"), "up")
        moved = way.join(step, "at", "left").withColumn("at", F.when(F.col("left").bitwiseAND(1 << k) > 0, F.col("up")).otherwise(F.col("at"))).drop("up")
        way = cut(moved) if k % 4 == 3 else moved
    holds = way.where("at = ancestor").select("ancestor", "descendant")
    if not trees.looped.isEmpty():
        own = pairs.join(trees.looped.select(F.col("id").alias("descendant")), "descendant", "left_semi")
        walk = chains(Forest([], trees.looped), own.select(F.col("descendant").alias("id")))
        looped = own.join(walk.select(F.col("id").alias("descendant"), "ancestor"), ["descendant", "ancestor"], "left_semi").unionByName(own.where("ancestor = descendant"))
        holds = holds.unionByName(looped.select("ancestor", "descendant"))
    return pairs.join(holds.distinct().withColumn("_h", F.lit(True)), ["ancestor", "descendant"], "left").select("ancestor", "descendant", (F.coalesce("_h", F.lit(False)) | (F.col("ancestor") == F.col("descendant"))).alias("holds"))


def _depths(trees: Forest, ids: DataFrame) -> DataFrame:
    """(id, depth) of classes that come to a top: the farthest jumps first, each at most once."""
    at = ids.join(trees.looped.select("id"), "id", "left_anti").select("id", F.col("id").alias("at"), F.lit(0).alias("depth"))
    for k, table in reversed(list(enumerate(trees.jumps))):
        at = at.join(table.select(F.col("id").alias("at"), "up"), "at", "left").select("id", F.coalesce("up", "at").alias("at"), (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth"))
    return at.select("id", "depth")


def lookup_method(graph: CodeGraph, wanted: DataFrame) -> DataFrame:
    """(class, method, target, dist, trait): where each wanted (class, method) is defined.

    A class comes before its traits, in the order in which they were recorded, and these before its parent. What isn't found gives no row.
    """
    wanted = cut(wanted.select("class", "method").distinct())
    line = _lines(graph, wanted)
    traits = graph.edges.where("type = 'USES_TRAIT'").groupBy(F.col("from_id").alias("owner"), F.col("to_id").alias("trait")).agg(F.min(F.coalesce("ord", F.lit(0))).alias("place"))
    through = line.join(traits, "owner").select("class", F.col("trait").alias("owner"), "dist", "place", F.col("trait"))
    places = line.select("class", "owner", "dist", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("trait")).unionByName(through)
    asked = wanted.join(places, "class").withColumn("target", F.concat_ws("::", "owner", "method"))
    found = asked.join(graph.nodes.select(F.col("id").alias("target")), "target", "left_semi")
    best = found.groupBy("class", "method").agg(F.min_by(F.struct("target", "dist", "trait"), F.struct("dist", "place", "owner")).alias("b"))
    return best.select("class", "method", "b.target", "b.dist", "b.trait")


def _lines(graph: CodeGraph, wanted: DataFrame) -> DataFrame:
    """(class, owner, dist): the wanted classes and all above them."""
    classes = wanted.select(F.col("class").alias("id")).distinct()
    up = chains(forest(first_parents(graph)), classes)
    return classes.select(F.col("id").alias("class"), F.col("id").alias("owner"), F.lit(0).alias("dist")).unionByName(up.select(F.col("id").alias("class"), F.col("ancestor").alias("owner"), "dist"))


def inheritance_chain(graph: CodeGraph, classes: DataFrame | None = None) -> DataFrame:
    """(id, ancestor, dist) of the classes asked for, or of all."""
    parents = first_parents(graph)
    return chains(forest(parents), parents if classes is None else classes)


def resolve_through_inheritance(graph: CodeGraph, wanted: DataFrame) -> DataFrame:
    """(class, method, target, dist): for each wanted (class, method) the nearest class up the chain that has the method, itself included."""
    methods = graph.nodes.where("type = 'method'").select(F.col("parent").alias("owner"), F.col("name").alias("method"), F.col("id").alias("target"))
    found = wanted.select("class", "method").distinct().join(_lines(graph, wanted), "class").join(methods, ["owner", "method"])
    return found.groupBy("class", "method").agg(F.min_by("target", F.struct("dist", "owner")).alias("target"), F.min("dist").alias("dist"))


def lineage(graph: CodeGraph, ids: DataFrame, types: tuple[str, ...] = ("EXTENDS",)) -> DataFrame:
    """(src, dst, dist): all that the classes asked for descend from by any of their parents, level by level from them; themselves not included."""
    up = graph.edges.where(F.col("type").isin(*types) & (F.col("from_id") != F.col("to_id"))).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()
    return _walk(up, ids)


def descendants(graph: CodeGraph, ids: DataFrame) -> DataFrame:
    """(id, descendant, dist): all that descend from the classes asked for."""
    down = graph.edges.where("type = 'EXTENDS' AND from_id <> to_id").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")).distinct()
    return _walk(down, ids).select(F.col("src").alias("id"), F.col("dst").alias("descendant"), "dist")


def _walk(edges: DataFrame, ids: DataFrame) -> DataFrame:
    found = bfs_levels(cut(edges), ids.select(F.col("id").alias("batch"), F.col("id").alias("node")))
    return found.where("lvl > 0").select(F.col("batch").alias("src"), F.col("node").alias("dst"), F.col("lvl").alias("dist"))


def route_action_defined(graph: CodeGraph, actions: DataFrame) -> DataFrame:
    """(id, defined): whether the class of each `C::m`, a parent or a trait has the method; ids without `::` count as defined."""
    split = actions.select("id", F.when(F.col("id").contains("::"), F.regexp_extract("id", "^(.*)::([^:]*)$", 1)).alias("class"), F.substring_index("id", "::", -1).alias("method"))
    own = split.where("class IS NOT NULL")
    up = lineage(graph, own.select(F.col("class").alias("id")).distinct(), ("EXTENDS", "USES_TRAIT")).select(F.col("src").alias("class"), F.col("dst").alias("owner"))
    line = own.select("id", "class", "method", F.col("class").alias("owner")).unionByName(own.join(up, "class").select("id", "class", "method", "owner"))
    found = line.withColumn("node", F.concat_ws("::", "owner", "method")).join(graph.nodes.select(F.col("id").alias("node")), "node", "left_semi").select("id").distinct()
    return split.join(found.withColumn("_f", F.lit(True)), "id", "left").select("id", (F.col("class").isNull() | F.coalesce("_f", F.lit(False))).alias("defined"))
