"""Types of properties along inheritance: labels passed from parents to children, a bounded number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.storage import cut

# Fixed value: how often types are passed on.
ROUNDS = 8


def inherited_types(types: DataFrame, parents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(class, property, type) after `rounds` rounds, or as many as change something, over `types` (class, property, type) and `parents` (class, parent, ord).

    In each round every class takes all properties of its parents as they were before it; a parent's type replaces the class's own, and of several parents
    the one recorded last wins. Only what changed in a round is passed on in the next; a class with many children sends each of them its own rows, whoever else does.
    """
    parents = cut(parents.where("class <> parent").groupBy("class", "parent").agg(F.max("ord").alias("ord")))
    own = types.groupBy("class", "property").agg(F.max("type").alias("type"))
    now = cut(own.withColumn("fresh", F.lit(True)))
    for _ in range(rounds):
        # who may change: children of what changed, with all that their parents say about the property
        touched = now.where("fresh").select(F.col("class").alias("parent"), "property").join(parents.select("class", "parent"), "parent").select("class", "property").distinct()
        said = touched.join(parents, "class").join(now.select(F.col("class").alias("parent"), "property", "type"), ["parent", "property"])
        new = said.groupBy("class", "property").agg(F.max_by("type", F.struct("ord", "parent")).alias("new"))
        both = now.select("class", "property", "type").join(new, ["class", "property"], "full_outer")
        now = cut(both.select("class", "property", F.coalesce("new", "type").alias("type"), F.coalesce(~F.col("new").eqNullSafe(F.col("type")) & F.col("new").isNotNull(), F.lit(False)).alias("fresh")))
        if now.where("fresh").isEmpty():
            break
    return now.select("class", "property", "type")
