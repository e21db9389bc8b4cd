"""Whole-graph analyses: traffic, impact, risk, architecture, dead code, similar files."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.predicates import ENTRY_TYPES, LAYERS, feature_file_role, layer_rank, layer_strict, risk, risk_order, usage_edge, visible_call
from weftgraph.functions.text import jaccard, split_terms
from weftgraph.model import CodeGraph
from weftgraph.operators.inheritance import lineage
from weftgraph.sources.storage import cut, stored

# What an edge adds to the impact on its source, and on its target.
WEIGHTS_IN = {"CALLS": 5, "DEPENDS_ON": 4, "EXTENDS": 3, "IMPLEMENTS": 2, "ROUTES_TO": 5, "BLADE_USES_ACTION": 4}
WEIGHTS_OUT = {"CALLS": 2, "DEPENDS_ON": 2, "EXTENDS": 3, "IMPLEMENTS": 2, "ROUTES_TO": 0, "BLADE_USES_ACTION": 0}


def traffic(graph: CodeGraph, include_resolved: bool = False, include_depends_on: bool = False) -> DataFrame:
    """(id, type, file, incoming, outgoing, score) of nodes with any traffic; one pass over the edges, either end counted at once."""
    use, call = usage_edge(include_resolved, include_depends_on), visible_call(include_resolved) | (F.lit(include_depends_on) & (F.col("type") == "DEPENDS_ON"))
    ends = graph.edges.where(use | call).select(F.explode(F.array(F.struct(F.col("to_id").alias("id"), use.cast("int").alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), call.cast("int").alias("o")))).alias("e"))
    sums = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("incoming"), F.sum("e.o").alias("outgoing"))
    scored = sums.withColumn("score", F.col("incoming") + F.col("outgoing")).where("score > 0")
    return graph.nodes.select("id", "type", "file").join(scored, "id")


def hotspots(graph: CodeGraph, limit: int = 10, include_resolved: bool = False, include_depends_on: bool = False) -> DataFrame:
    """(list, id, incoming, outgoing, score): the busiest methods, classes, classes by dependency, and nodes by fan-out."""
    all_ = cut(traffic(graph, include_resolved, include_depends_on))  # a row for each node, read by three lists
    depend = traffic(CodeGraph(graph.nodes, graph.edges.where("type = 'DEPENDS_ON'")), False, True)
    lists = [
        ("method", all_.where("type = 'method'"), F.desc("score")),
        ("class", all_.where("type = 'class'"), F.desc("score")),
        ("dependency", depend.where("type = 'class'"), F.desc("score")),
        ("fan_out", all_.where("outgoing > 0"), F.desc("outgoing")),
    ]
    out = None
    for name, rows, order in lists:
        top = rows.orderBy(order, "id").limit(limit).select(F.lit(name).alias("list"), "id", "incoming", "outgoing", "score")
        out = top if out is None else out.unionByName(top)
    return out


def _weight(table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, value in table.items():
        out = F.when(F.col("type") == name, value).otherwise(out)
    return out


def _impact_kinds(graph: CodeGraph, include_resolved: bool, include_depends_on: bool) -> DataFrame:
    """Edges that carry impact, whatever their ends."""
    kinds = visible_call(include_resolved) | F.col("type").isin("EXTENDS", "IMPLEMENTS", *ENTRY_TYPES) | (F.lit(include_depends_on) & (F.col("type") == "DEPENDS_ON"))
    return graph.edges.where(kinds).select("from_id", "to_id", "type")


def impact_edges(graph: CodeGraph, include_resolved: bool = False, include_depends_on: bool = False) -> DataFrame:
    """Edges that carry impact and whose ends are both nodes."""
    known = graph.nodes.select("id")
    return _impact_kinds(graph, include_resolved, include_depends_on).join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def change_impact(graph: CodeGraph, targets: DataFrame, depth: int = 2, decay: str = "0.6", include_resolved: bool = False, include_depends_on: bool = False) -> DataFrame:
    """(target, id, direction, score, distance): who is affected if a target changes, for many targets at once.

    Each edge into a node that is reached at level l adds its weight times decay ** l to its source, so nodes are
    expanded once and edges counted once. Scores are exact decimals until the end.
    """
    if depth < 1:
        raise ValueError("impact goes one level up at least")
    nodes = graph.nodes.select("id")
    # what an edge comes from is a node; what it leads to is a target, which is one too, or came before it
    e = stored(_impact_kinds(graph, include_resolved, include_depends_on).join(nodes.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select("from_id", "to_id", "type"))
    own = stored(nodes.join(targets.select("id"), "id", "left_semi").distinct())
    found = front = own.select(F.col("id").alias("batch"), F.col("id").alias("to_id"))
    levels = None
    for lvl in range(depth):
        # equal edges of one level and type count together
        up = front.join(e, "to_id").where("from_id <> batch").groupBy("batch", F.col("from_id").alias("id")).agg(F.sum(_weight(WEIGHTS_IN)).alias("n"))
        last = lvl == depth - 1
        up = up if last else stored(up)
        part = up.select("batch", "id", F.lit(lvl).alias("lvl"), "n")
        levels = part if levels is None else levels.unionByName(part)
        if not last:
            front = stored(up.select("batch", F.col("id").alias("to_id")).join(found, ["batch", "to_id"], "left_anti"))
            if front.isEmpty():
                break
            found = found.unionByName(front)
    # whole numbers are added up level by level, and weighed at the end
    at = [F.sum(F.when(F.col("lvl") == lvl, F.col("n"))).alias(f"n{lvl}") for lvl in range(depth)]
    sums = levels.groupBy("batch", "id").agg(*at, (F.min("lvl") + 1).alias("distance"))
    score = sum((F.coalesce(F.col(f"n{lvl}"), F.lit(0)).cast("decimal(20,0)") * F.lit(Decimal(decay) ** lvl).cast("decimal(18,6)") for lvl in range(1, depth)), F.coalesce("n0", F.lit(0)).cast("decimal(38,6)"))
    callers = sums.select(F.col("batch").alias("target"), "id", F.lit("caller").alias("direction"), score.cast("double").alias("score"), "distance")
    known = e.join(own.select(F.col("id").alias("from_id")), "from_id", "left_semi").groupBy(F.col("from_id").alias("target"), F.col("to_id").alias("id")).agg(F.sum(_weight(WEIGHTS_OUT)).cast("double").alias("score"))
    callees = known.join(nodes, "id", "left_semi").select("target", "id", F.lit("callee").alias("direction"), "score", F.lit(1).alias("distance"))
    return callers.unionByName(callees)


def impact_summary(impact: DataFrame) -> DataFrame:
    """(target, score, risk, direct_callers, indirect_callers, callees) of each target."""
    caller, score = F.col("direction") == "caller", F.col("score").cast("decimal(28,6)")
    s = impact.groupBy("target").agg(
        F.sum(score).cast("double").alias("score"),
        F.count_if(caller & (F.col("distance") == 1)).alias("direct_callers"),
        F.count_if(caller & (F.col("distance") > 1)).alias("indirect_callers"),
        F.count_if(~caller).alias("callees"),
    )
    return s.withColumn("risk", risk(F.col("score")))


def risk_ranking(graph: CodeGraph, pool: int = 100, depth: int = 2, include_resolved: bool = False) -> DataFrame:
    """(id, hotspot_score, impact_score, combined, risk, rank): the busiest nodes by impact and traffic."""
    busy = hotspots(graph, pool, include_resolved).where("list IN ('method', 'class', 'fan_out')").groupBy("id").agg(F.max("score").alias("hotspot_score"))
    busy = cut(busy)
    impact = impact_summary(change_impact(graph, busy, depth, include_resolved=include_resolved)).select(F.col("target").alias("id"), F.col("score").alias("impact_score"))
    both = busy.join(impact, "id", "left").withColumn("impact_score", F.coalesce("impact_score", F.lit(0.0)))
    both = both.withColumn("combined", F.col("impact_score") * 3 + F.col("hotspot_score")).withColumn("risk", risk(F.col("impact_score")))
    # at most 3 * pool rows are ranked
    return both.withColumn("rank", F.row_number().over(Window.orderBy(risk_order(F.col("risk")), F.desc("combined"), F.desc("hotspot_score"), "id")))


def architecture(graph: CodeGraph, include_resolved: bool = False, ignore: list[str] | None = None) -> DataFrame:
    """(from_id, to_id, type, from_layer, to_layer, severity, reason, detected): edges from an inner to an outer layer."""
    e = graph.edges.where(visible_call(include_resolved) | (F.col("type") == "DEPENDS_ON")).select("from_id", "to_id", "type")
    e = e.withColumn("from_layer", layer_strict(F.col("from_id"))).withColumn("to_layer", layer_strict(F.col("to_id")))
    bad = e.where(layer_rank(F.col("from_layer")) > layer_rank(F.col("to_layer")))
    # a repository that calls its own query builder, and what the rules leave out, is no violation
    bad = bad.where(~((F.col("from_layer").isin("Repository", "Repositories")) & F.col("to_id").endswith("::query")))
    for pattern in ignore or []:
        bad = bad.where(~(F.col("from_id").rlike(pattern) | F.col("to_id").rlike(pattern)))
    verb = F.when(F.col("type") == "DEPENDS_ON", "depend on").otherwise("call")
    return bad.select(
        "from_id", "to_id", "type", "from_layer", "to_layer",
        F.when(F.col("type") == "DEPENDS_ON", "MEDIUM").otherwise("HIGH").alias("severity"),
        F.concat("from_layer", F.lit(" code should not "), verb, F.lit(" "), "to_layer", F.lit(" code.")).alias("reason"),
        F.concat("from_layer", F.lit(" → "), "to_layer").alias("detected"),
    )


def layer_counts(violations: DataFrame) -> DataFrame:
    """(from_layer, to_layer, severity, n)."""
    return violations.groupBy("from_layer", "to_layer", "severity").agg(F.count("*").alias("n"))


def common_layer(layer: Column) -> Column:
    """The name that synonymous layers share."""
    return F.element_at(F.create_map(*[F.lit(x) for _, key, _, common in LAYERS for x in (key, common)]), layer)


# Methods that a framework calls.
ACTIONS = ("index", "show", "store", "create", "edit", "update", "destroy", "handle")
REQUEST_METHODS = ("rules", "messages", "attributes", "authorize")


def skip_reason(ignore_accessors: bool = False) -> Column:
    """Why a public method is not judged; null if it is. Needs parent_type and overrides_abstract."""
    parent, file = F.coalesce("parent", F.lit("")), F.coalesce("file", F.lit(""))
    low, name, short = F.lower(file), F.lower("name"), F.substring_index(parent, "\\", -1)
    base = short.rlike("^(Base|Abstract)[A-Za-z0-9_]|Base$") | low.rlike(r"/base/|/abstract/|/base[a-z0-9_]*\.php$")
    controller = parent.contains("Controller") | file.contains("/Controllers/") | file.contains("/Controller/")
    handler = parent.rlike("(Command|Job|Listener|Middleware)$") | low.rlike("/(commands|jobs|listeners|middleware)/")
    framework = ((parent.endswith("Request") | low.contains("/requests/")) & name.isin(*REQUEST_METHODS)) | (parent.endswith("ServiceProvider") & name.isin("boot", "register")) | (handler & (name == "handle"))
    accessor = F.lit(ignore_accessors) & F.col("name").rlike("^(get|set|is|has)[A-Z]") & low.rlike("/(entity|entities|dto|dtos|model|models)/")
    return (
        F.when(F.col("name") == "__construct", "constructor")
        .when(base, "base_class")
        .when(name.startswith("__"), "magic_method")
        .when(low.rlike("/tests?/"), "test_file")
        .when(F.col("parent_type") == "interface", "interface_method")
        .when(controller & name.isin(*ACTIONS), "controller_action")
        .when(framework, "framework_method")
        .when(accessor, "entity_accessor")
        .when(F.col("overrides_abstract"), "abstract_implementation")
    )


def dead_code(graph: CodeGraph, ignore_accessors: bool = False) -> DataFrame:
    """(id, skipped, incoming, effective, dead): every public method, judged or skipped. Resolved calls count twice in `effective`; that never changes the verdict."""
    m = graph.nodes.where("type = 'method' AND visibility = 'public'").select("id", "parent", "name", "file")
    parents = graph.nodes.select(F.col("id").alias("parent"), F.col("type").alias("parent_type"))
    abstract = graph.nodes.where("type = 'method' AND is_abstract").select(F.col("parent").alias("owner"), "name")
    some = m.select("id", "parent", "name").join(abstract.select("name").distinct(), "name", "left_semi")  # only these may fill an abstract method in
    up = lineage(graph, some.select(F.col("parent").alias("id")).distinct()).select(F.col("src").alias("parent"), F.col("dst").alias("owner"))
    line = some.select("id", "parent", "name", F.col("parent").alias("owner")).unionByName(some.join(up, "parent").select("id", "parent", "name", "owner"))
    overrides = line.join(abstract, ["owner", "name"], "left_semi").select("id").distinct().withColumn("overrides_abstract", F.lit(True))
    use = F.col("type").isin("CALLS", "ROUTES_TO", "BLADE_USES_ACTION", "BLADE_REFERENCES_SYMBOL", "BLADE_CALLS")
    again = (F.col("type") == "CALLS") & F.coalesce(F.col("call_type").isin("INTERFACE_RESOLVED", "EXTENDS_RESOLVED", "OVERRIDE_RESOLVED"), F.lit(False))
    counts = graph.edges.where(use).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("incoming"), (F.count("*") + F.count_if(again)).alias("effective"))
    rows = m.join(parents, "parent", "left").join(overrides, "id", "left").join(counts, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    judged = rows.select("id", skip_reason(ignore_accessors).alias("skipped"), zero("incoming"), zero("effective"))
    return judged.withColumn("dead", F.col("skipped").isNull() & (F.col("effective") == 0))


def file_profiles(graph: CodeGraph) -> DataFrame:
    """(file, types, terms, role): what each file holds."""
    n = graph.nodes.where("file IS NOT NULL")
    p = n.groupBy("file").agg(F.collect_set("type").alias("types"), F.array_distinct(F.flatten(F.collect_set(split_terms(F.when(F.col("name") != F.col("file"), F.col("name")).otherwise(""))))).alias("terms"))
    return p.withColumn("role", feature_file_role(F.col("file"), F.col("types")))


def _shapes(profiles: DataFrame) -> DataFrame:
    """Adds to `file_profiles`: ext, the directories above each file, and `rests`: the terms of its path after none of them, one, two..."""
    parts = F.split(F.translate("file", "\\", "/"), "/")
    rests = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: split_terms(F.array_join(F.slice(parts, n, F.size(parts)), "/")))
    return profiles.withColumns({"ext": F.regexp_extract("file", r"(\.[^./]*)$", 1), "dirs": F.transform(F.slice(parts, 1, F.size(parts) - 1), F.lower), "rests": rests})


def _likeness() -> Column:
    """How alike a seed (columns s_...) and a shape are, without links."""

    def shared(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b["shared"]))
        union = F.size(a) + b["n"] - both
        return F.when(union == 0, 0.0).otherwise(both / union)

    most = F.least(F.size("s_dirs"), F.size("dirs"))
    apart = F.filter(F.sequence(F.lit(1), most + 1), lambda n: (n > most) | (F.get("s_dirs", n - 1) != F.get("dirs", n - 1)))
    common = apart[0] - 1  # directories that both paths begin with
    return (
        jaccard(F.col("s_types"), F.col("types")) * 10 + shared(F.get("s_rests", common), F.get("rests", common)) * 35 + shared(F.col("s_terms"), F.col("terms")) * 25
        + F.when((F.col("role") == F.col("s_role")) & (F.col("role") != "other"), 8).otherwise(0) + 6 + F.when(F.col("s_ext") == F.col("ext"), 2).otherwise(0)
    )


def similar_files(graph: CodeGraph, seeds: DataFrame, limit: int = 10) -> DataFrame:
    """(seed, file, score): files whose shape, path terms, symbols, role and links resemble those of each seed file.

    A score of 30 needs shared path or symbol terms, or a direct link. Files that differ in nothing but terms which no seed has score alike, so
    each such shape is scored once, and only the files of shapes that reach 30 meet the seeds; linked files are scored one by one.
    """
    # terms cost much for few bytes: files are dealt out by number, not by size
    parts = int(graph.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = cut(_shapes(file_profiles(graph).repartition(parts, "file")))
    own = p.join(seeds.select("file").distinct(), "file", "left_semi")
    held = own.agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.col("rests")[0], "terms")))).alias("held"))
    s = own.select(*[F.col(c).alias("seed" if c == "file" else f"s_{c}") for c in p.columns])
    known = lambda c: F.struct(F.array_sort(F.array_intersect(c, "held")).alias("shared"), F.size(c).alias("n"))
    shaped = p.crossJoin(held).select("file", F.array_sort("types").alias("types"), "role", "ext", "dirs", F.transform("rests", known).alias("rests"), known(F.col("terms")).alias("terms"))
    shape = ["types", "role", "ext", "dirs", "rests", "terms"]
    forms = cut(shaped.groupBy(*shape).agg(F.count("*").alias("files")))
    meet = forms.select(*shape, F.explode(F.array_union(F.col("rests")[0]["shared"], F.col("terms")["shared"])).alias("k")).join(s.select("seed", F.explode(F.array_union(F.col("s_rests")[0], F.col("s_terms"))).alias("k")), "k").select("seed", *shape).distinct()
    near = meet.join(s, "seed").select("seed", *shape, _likeness().alias("score")).where("score >= 30")
    alike = shaped.join(near, shape).select("seed", "file", "score")
    f = graph.nodes.where("file IS NOT NULL").select("id", "file")
    ours = f.join(seeds.select("file").distinct(), "file", "left_semi").select("id", F.col("file").alias("seed"))
    e = graph.edges.select("from_id", "to_id")
    ends = e.join(ours.withColumnRenamed("id", "from_id"), "from_id").select("seed", F.col("to_id").alias("id")).unionByName(e.join(ours.withColumnRenamed("id", "to_id"), "to_id").select("seed", F.col("from_id").alias("id"))).distinct()
    linked = ends.join(f, "id").select("seed", "file").distinct()
    tied = linked.join(shaped, "file").join(s, "seed").select("seed", "file", (_likeness() + 20).alias("score")).where("score >= 30")
    x = alike.unionByName(tied).where("seed <> file").groupBy("seed", "file").agg(F.max("score").alias("score"))
    top = Window.partitionBy("seed").orderBy(F.desc("score"), "file")
    return x.withColumn("n", F.row_number().over(top)).where(F.col("n") <= limit).drop("n")
