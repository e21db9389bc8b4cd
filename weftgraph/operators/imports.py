"""Where imports lead: longest alias, relative paths, and the first of the candidate files, all by equality joins.

Candidates are not made for each import: each file says what it may be imported as, so that an import meets one row at most. What a source
means depends on the directory of the file that imports it alone, and is found once for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions that a module may have, in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".vue", ".mjs", ".cjs")


def normal_path(path: Column) -> Column:
    """Slashes alone and single, without `.` and with `..` applied; what leads above the root keeps its `..`."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    none = F.array().cast("array<string>")
    up = lambda acc: F.when((F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, F.lit("..")))
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", up(F.coalesce(F.when(F.size(acc) > 0, acc), none))).otherwise(F.array_append(acc, s))
    # most paths have nothing to apply
    return F.when(path.rlike(r"(^|/)\.{0,2}(/|$)|\\"), F.array_join(F.aggregate(parts, none, step), "/")).otherwise(path)


def _begins(text: Column, n: Column) -> Column:
    """The first n segments of a path."""
    return F.call_function("substring_index", text, F.lit("/"), n)


def _above(file: Column) -> Column:
    """All directories above a file, the root (empty) among them."""
    return F.transform(F.sequence(F.lit(0), F.regexp_count(file, F.lit("/"))), lambda n: _begins(file, n))


def _heads(source: Column) -> Column:
    """What an alias of a source may be: each of its beginnings that ends where a segment does, with the slash or without."""
    slashes = F.regexp_count(source, F.lit("/"))
    both = lambda n: F.when(n > slashes, F.array(source)).otherwise(F.array(_begins(source, n), F.concat(_begins(source, n), F.lit("/"))))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), slashes + 1), both)))


def _aliased(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """(folder, source, path): sources that an alias stands for. General aliases (directory null) go first, then the innermost directory's, then the longest."""
    known = aliases.select(F.col("directory").isNull().alias("general"), F.coalesce("directory", F.lit("")).alias("directory"), "alias", "target")
    heads = asked.select("folder", "source", F.explode(_heads(F.col("source"))).alias("alias")).join(known.select("alias").distinct(), "alias", "left_semi")
    scope = lambda general, directory: F.struct(F.lit(general).alias("general"), directory.alias("directory"))
    scopes = F.concat(F.array(scope(True, F.lit(""))), F.transform(_above(F.col("folder")), lambda d: scope(False, d)))
    each = heads.select("folder", "source", "alias", F.explode(scopes).alias("s")).select("folder", "source", "alias", "s.general", "s.directory")
    depth = F.when(F.col("general"), 1 << 30).otherwise(F.length("directory"))
    best = each.join(known, ["general", "directory", "alias"]).groupBy("folder", "source").agg(F.max_by(F.struct("alias", "target"), F.struct(depth, F.length("alias"), "target")).alias("b"))
    rest = F.regexp_replace(F.expr("substr(source, length(b.alias) + 1)"), "^/", "")
    target = F.regexp_replace(F.regexp_replace(F.translate("b.target", "\\", "/"), r"^\./", ""), "/$", "")
    return best.select("folder", "source", F.when(rest == "", target).otherwise(F.regexp_replace(F.concat(target, F.lit("/"), rest), "^/", "")).alias("path"))


def _importable(files: DataFrame) -> DataFrame:
    """(base, own, first): whether a file is named as a path is, and which file comes first of those that the path, its extensions and its index mean."""
    endings = ["", *EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS)]
    meant = [F.when(F.col("file").endswith(e), F.struct(F.expr(f"substr(file, 1, length(file) - {len(e)})").alias("base"), F.lit(place).alias("place"))) for place, e in enumerate(endings)]
    each = files.where("file IS NOT NULL").select("file", F.explode(F.array_compact(F.array(*meant))).alias("m")).select("m.*", "file")
    return each.groupBy("base").agg((F.min("place") == 0).alias("own"), F.min_by("file", "place").alias("first"))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file, source, path, how) of each distinct import (file, source): the file that it means, or what it would be named (`how`: found, missing, package).

    `files` (file) are those that exist; `aliases` are (directory, alias, target), the directory null for aliases of everything. A path is tried as it stands,
    then with each extension, then as a directory's index; the first that exists is meant. A path that has an extension is tried alone.
    """
    asked = imports.select("file", F.regexp_replace("source", "^[\"']|[\"']$", "").alias("source")).where("file IS NOT NULL AND source IS NOT NULL").distinct()
    asked = asked.withColumn("folder", F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "/")).otherwise(""))
    ways = asked.select("folder", "source").distinct()
    led = ways.join(_aliased(ways, aliases).select("folder", "source", F.col("path").alias("led"), F.lit(True).alias("aliased")), ["folder", "source"], "left").withColumn("aliased", F.coalesce("aliased", F.lit(False)))
    path = F.when(F.col("aliased"), F.col("led")).when(F.col("source").startswith("."), normal_path(F.concat("folder", "source")))
    local = led.select("folder", "source", "aliased", path.alias("path"))
    based = local.withColumn("base", F.when(F.col("aliased"), normal_path(F.col("path"))).otherwise(F.col("path")))
    extended = lambda c: F.coalesce(c.rlike("(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$"), F.lit(False))
    named = lambda c: F.when(extended(c), c).otherwise(F.concat(c, F.lit(".js")))
    hit = F.when(F.col("own") | ~extended(F.col("path")), F.col("first"))
    package = ~F.col("aliased") & F.col("path").isNull()
    how = F.when(package, "package").when(hit.isNotNull(), "found").otherwise("missing").alias("how")
    found = based.join(_importable(files), "base", "left").select("folder", "source", F.coalesce(hit, named(F.when(package, F.col("source")).otherwise(F.col("path")))).alias("path"), how)
    return asked.join(found, ["folder", "source"]).select("file", "source", "path", "how")
