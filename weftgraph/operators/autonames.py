"""Components that a framework finds by their files: names from directories, a registry for each application, and what tags mean.

An application has component directories in an order. A file belongs to the first directory that holds it, and to no other, also if
that directory's rules leave it out. Of several files of a directory with one name the first (by path) stays, one for each place
where it runs (`client`, `server`, or `all`, which leaves nothing to the others); between directories the higher priority wins, and the earlier
directory where it doesn't. A name that was given twice with equal rights is a duplicate: its tags are ambiguous.

Files meet directories by equality of a leading path. Each name is settled in two aggregations: by directory (at most three rows
remain) and by application, where a fold over the directories' few rows keeps their order. Tags are resolved once for each
layer and tag; usages only look the answer up, however many there are.

Null files, tags and empty tables give nothing; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions of components, files that are none, and prefixes of tags that load late.
EXTENSIONS = "js jsx mjs ts tsx vue".split()
NO_COMPONENT = r"(?:(?:M|\.m|-m)ixin\.(?:js|ts|jsx|tsx)|\.d\.(?:ts|mts|cts))$|(?:^|/)(?:node_modules|\.nuxt|\.output)/|\.(?:stories|spec|test)\.[cm]?[jt]sx?$|(?:^|/)-[^/]*$"
LAZY = "^Lazy(?:Idle|Visible|Interaction|MediaQuery|If|Never|Time)?(?=[A-Z])"
#: What `dirs` may have besides root, place and path.
DIR_OPTIONS = {"prefix": "string", "path_prefix": "boolean", "priority": "int", "island": "boolean", "extensions": "array<string>", "ignore": "array<string>"}


def split_by_case(value: Column) -> Column:
    """Parts of a name between `-`, `_`, `/`, `.` and where its case changes; an upper-case run ends before the last letter that a lower-case one follows."""
    border = r"(?<=[^\p{Lu}\d\-_/.])(?=\p{Lu})|(?<=[^\-_/.])(?=\p{Lu}[^\p{Lu}\d\-_/.])"
    return F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(value, border, "/"), "[-_/.]"))


def _folder(path: Column) -> Column:
    """With one slash at the end; the top is empty."""
    p = F.regexp_replace(F.regexp_replace(path, "^(?:\\./|/)+", ""), "/+", "/")
    return F.when((p == "") | (p == "."), "").otherwise(F.concat(F.regexp_replace(p, "/$", ""), F.lit("/")))


def folders(file: Column) -> Column:
    """All directories above a file, from the top, each with a slash at the end."""
    parts = F.split(file, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))


def component_names(claimed: DataFrame) -> DataFrame:
    """Rows (file, path, prefix, path_prefix, island, and others) with name and mode; files without a name go."""
    relative = F.expr("substr(file, length(path) + 1)")
    inner = F.regexp_replace(F.when(F.contains("_relative", F.lit("/")), F.regexp_replace("_relative", "/[^/]*$", "")).otherwise(""), "/+$", "")
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"(?<=.)\.[^.]*$", "")
    is_island = F.col("island") | F.col("_stem").rlike(r"\.island(?:\.global)?$")
    runs = F.regexp_extract("_stem", r"(?<=\.)(client|server)(?:\.global|\.island)*$", 1)
    bare = F.regexp_replace(F.regexp_replace("_stem", r"(?:\.(?:client|server))?(?:\.global|\.island)*$", ""), "[\"']", "")
    own_dir = F.when(F.contains("file", F.lit("/")), F.substring_index(F.regexp_replace("file", "/[^/]*$", ""), "/", -1)).otherwise(".")
    c = claimed.withColumn("_relative", relative).withColumn("_stem", stem)
    c = c.withColumn("mode", F.when(is_island, "server").when(runs != "", runs).otherwise("all"))
    c = c.withColumn("_bare", F.when(F.lower(bare) != "index", bare).when(F.col("path_prefix"), "").otherwise(own_dir))
    c = c.withColumn("_before", F.concat(split_by_case(F.coalesce("prefix", F.lit(""))), F.when(F.col("path_prefix"), split_by_case(inner)).otherwise(F.array().cast("array<string>"))))
    c = c.withColumn("_own", split_by_case(F.col("_bare"))).withColumn("_said", F.lower(F.array_join("_own", "/")))
    # the directories' words end where the file's own words begin with all that are left
    again = "lower(element_at(_before, i + 1)) = _said AND i + 2 <= size(_before) AND element_at(_before, i + 1) = element_at(_before, i + 2)"
    cut = f"array_min(filter(sequence(0, size(_before)), i -> i = size(_before) OR startswith(concat(_said, '/'), concat(lower(array_join(slice(_before, i + 1, size(_before)), '/')), '/')) OR ({again})))"
    c = c.withColumn("_words", F.expr(f"concat(slice(_before, 1, {cut}), _own)"))
    named = c.withColumn("name", F.array_join(F.transform("_words", lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), ""))
    return named.where("name <> ''").drop("_stem", "_bare", "_before", "_own", "_said", "_words")


def registry(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(root, name, mode, file, priority, duplicate): the components of each application.

    `dirs`: root, place (their order), path, and any of DIR_OPTIONS; `ignore` has regular expressions on paths in the directory
    (`text.glob_pattern` makes them from globs).
    """
    given = dirs.select("root", "place", _folder(F.col("path")).alias("path"), *[(F.col(c) if c in dirs.columns else F.lit(None)).cast(t).alias(c) for c, t in DIR_OPTIONS.items()])
    given = given.fillna({"path_prefix": True, "priority": 0, "island": False})
    given = given.withColumns({"extensions": F.coalesce(F.transform("extensions", lambda e: F.regexp_replace(e, r"^\.", "")), F.array(*map(F.lit, EXTENSIONS))), "ignore": F.coalesce("ignore", F.array().cast("array<string>"))})
    above = files.select("file").distinct().select("file", F.explode(folders(F.col("file"))).alias("path"))
    options = [c for c in given.columns if c != "root"]
    claimed = above.join(given, "path").groupBy("root", "file").agg(F.min_by(F.struct(*options), "place").alias("d")).select("root", "file", "d.*")
    relative = F.expr("substr(file, length(path) + 1)")
    ignored = F.exists("ignore", lambda p: F.regexp_like(F.col("_in"), p))
    fits = claimed.withColumn("_in", relative).where(F.array_contains("extensions", F.regexp_extract("_in", r"(?<=[^/])\.([^./]*)$", 1)) & ~F.col("_in").rlike(NO_COMPONENT) & ~F.col("file").rlike(NO_COMPONENT) & ~ignored)
    named = component_names(fits.drop("_in"))
    # one directory: the first of each mode, and nothing after the first that runs everywhere
    first = lambda mode: F.min(F.when(F.col("mode") == mode, F.struct(F.col("_relative").alias("at"), "file", "mode", "priority")))
    by_dir = named.groupBy("root", "name", "place").agg(first("all").alias("a"), first("client").alias("c"), first("server").alias("s"), F.count("*").alias("n"))
    kept = F.filter(F.array("a", "c", "s"), lambda x: x.isNotNull() & (F.col("a").isNull() | (x["mode"] == "all") | (x["at"] < F.col("a.at"))))
    by_dir = by_dir.withColumn("kept", kept).select("root", "name", "place", "kept", (F.size("kept") < F.col("n")).alias("twice"))
    entries = F.transform("kept", lambda x: F.struct(F.col("place"), x["at"].alias("at"), x["file"].alias("file"), x["mode"].alias("mode"), x["priority"].alias("priority")))
    all_dirs = by_dir.groupBy("root", "name").agg(F.array_sort(F.flatten(F.collect_list(entries))).alias("e"), F.max("twice").alias("twice"))
    # all directories, in order: who comes first in the list and runs where this one does is in its way
    at = "array_position(transform(s.l, o -> o.mode = 'all' OR o.mode = x.mode), true)"
    step = f"CASE WHEN {at} = 0 THEN named_struct('l', concat(s.l, array(x)), 'd', s.d) WHEN x.priority > element_at(s.l, cast({at} AS int)).priority THEN named_struct('l', transform(s.l, (o, i) -> CASE WHEN i + 1 = {at} THEN x ELSE o END), 'd', s.d) ELSE named_struct('l', s.l, 'd', s.d OR (x.priority > 0 AND x.priority = element_at(s.l, cast({at} AS int)).priority)) END"
    settled = all_dirs.withColumn("r", F.expr(f"aggregate(e, named_struct('l', slice(e, 1, 0), 'd', twice), (s, x) -> {step})"))
    return settled.select("root", "name", F.explode("r.l").alias("x"), F.col("r.d").alias("duplicate")).select("root", "name", "x.mode", "x.file", "x.priority", "duplicate")


def resolve_tags(usages: DataFrame, layers: DataFrame, found: DataFrame) -> DataFrame:
    """(file, tag, kind, target, files, roots) for usages (file, tag): resolved, ambiguous or unresolved.

    `layers`: (root, layer), the directories that make up each application. A file is of the innermost layer that holds it, and asks
    every application that has this layer. A tag that no component has is tried without its prefix for late loading.
    """
    parts = layers.select("root", _folder(F.col("layer")).alias("layer")).distinct()
    used = usages.select("file", "tag").where("file IS NOT NULL AND tag IS NOT NULL").distinct()
    of = used.select("file").distinct().select("file", F.explode(folders(F.col("file"))).alias("layer")).join(parts.select("layer").distinct(), "layer").groupBy("file").agg(F.max_by("layer", F.length("layer")).alias("layer"))
    placed = used.join(of, "file", "left")
    spellings = F.array_distinct(F.array("tag", F.regexp_replace("tag", LAZY, "")))
    asked = placed.select("layer", "tag").distinct().join(parts, "layer").select("layer", "tag", "root", F.posexplode(spellings).alias("way", "name"))
    known = found.groupBy("root", "name").agg(F.collect_set("file").alias("files"), F.max("duplicate").alias("duplicate"))
    best = asked.join(known, ["root", "name"]).groupBy("layer", "tag", "root").agg(F.min_by(F.struct("files", "duplicate"), "way").alias("k"))
    several = F.col("k.duplicate") | (F.size("k.files") > 1)
    none = F.array().cast("array<string>")
    answers = best.groupBy("layer", "tag").agg(F.array_sort(F.collect_set("root")).alias("roots"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("k.duplicate"), none).otherwise(F.col("k.files")))))).alias("files"), F.max(several).alias("several"))
    out = placed.join(answers, ["layer", "tag"], "left")
    kind = F.when(F.col("roots").isNull(), "unresolved").when(F.col("several") | (F.size("files") != 1), "ambiguous").otherwise("resolved")
    return out.select("file", "tag", kind.alias("kind"), F.when(kind == "resolved", F.col("files")[0]).alias("target"), F.coalesce("files", none).alias("files"), F.coalesce("roots", none).alias("roots"))


def rendered_edges(resolved: DataFrame) -> DataFrame:
    """(from_id, to_id, type, via) of resolved tags: which component each file's module renders."""
    return resolved.where("kind = 'resolved' AND target <> file").select(F.concat(F.lit("js:"), F.col("file")).alias("from_id"), F.concat(F.lit("js:"), F.col("target")).alias("to_id"), F.lit("RENDERS_COMPONENT").alias("type"), F.col("tag").alias("via")).distinct()
