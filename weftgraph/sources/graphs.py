"""Reading and writing graphs: Parquet tables, JSON documents and source files; merging and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.model import EDGES, NODES, CodeGraph

# Directories that a scan skips, and those of tests.
IGNORED_DIRS = "vendor node_modules cache logs bin bootstrap build docker docs storage artisan composer.json composer.lock package.json package-lock.json boost.json certs".split()
TEST_DIRS = "test tests __tests__ __test__ spec specs e2e cypress playwright k6".split()


def write_parquet(graph: CodeGraph, path: str) -> None:
    """Nodes and edges partitioned by type, so that a query of one type reads that type alone."""
    graph.nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    if graph.meta is not None:
        graph.meta.write.mode("overwrite").parquet(f"{path}/graph_meta")


def read_parquet(spark: SparkSession, path: str) -> CodeGraph:
    """What `write_parquet` wrote, with the metadata if there are any."""
    g = CodeGraph.of(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
    return CodeGraph(g.nodes, g.edges, spark.read.parquet(f"{path}/graph_meta") if _exists(spark, f"{path}/graph_meta") else None)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_json(graph: CodeGraph, path: str) -> None:
    """One JSON line per node, edge and metadata entry, in a folder each."""
    for name, rows in {"nodes": graph.nodes, "edges": graph.edges, "graph_meta": graph.meta}.items():
        if rows is not None:
            rows.write.mode("overwrite").json(f"{path}/{name}")


def read_json(spark: SparkSession, path: str) -> CodeGraph:
    """What `write_json` wrote, or a document `{nodes: [...], edges: [...]}`; one that cannot be read gives an empty graph."""
    if _exists(spark, f"{path}/nodes"):
        g = CodeGraph.of(spark.read.schema(NODES).json(f"{path}/nodes"), spark.read.schema(EDGES).json(f"{path}/edges"))
        return CodeGraph(g.nodes, g.edges, spark.read.json(f"{path}/graph_meta") if _exists(spark, f"{path}/graph_meta") else None)
    raw = spark.read.schema("nodes array<map<string,string>>, edges array<map<string,string>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)

    def of(col: str, schema) -> DataFrame:
        rows = raw.select(F.explode(col).alias("m"))
        names = {"from_id": ("from", "from_id"), "to_id": ("to", "to_id"), "call_type": ("callType", "call_type")}
        cols = [F.coalesce(*[F.col("m")[k] for k in names.get(f.name, (f.name,))]).alias(f.name) for f in schema.fields if f.dataType.simpleString() != "array<string>"]
        return rows.select(*cols)

    return CodeGraph.of(of("nodes", NODES), of("edges", EDGES))


def merge(target: CodeGraph, source: CodeGraph) -> CodeGraph:
    """Both graphs; where an id is in both, the target's row stays."""
    add = lambda a, b: a.unionByName(b.join(a.select("id"), "id", "left_anti").select(*a.columns))
    return CodeGraph(add(target.nodes, source.nodes), add(target.edges, source.edges), target.meta)


def keep_last(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """One row for each key: the last written. Aggregation keeps one candidate per key and task, so hot keys don't meet in one place."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.coalesce(order, F.lit(-1))).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_first_file(nodes: DataFrame) -> DataFrame:
    """One row for each endpoint id: that of the file which sorts first."""
    rest = [c for c in nodes.columns if c != "id"]
    best = nodes.groupBy("id").agg(F.min_by(F.struct(*rest), F.coalesce("file", F.lit("￿"))).alias("_r"))
    return best.select("id", *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*nodes.columns)


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def source_files(spark: SparkSession, root: str, extensions: list[str], exclude_tests: bool = False) -> DataFrame:
    """(file, text) of source files under `root`; ignored and hidden directories are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{root.rstrip('/')}/", "")
    parts = F.split(path, "/")
    skip = [*IGNORED_DIRS, *(TEST_DIRS if exclude_tests else [])]
    kept = raw.withColumn("file", path).where(~F.arrays_overlap(parts, F.array(*map(F.lit, skip))) & ~F.exists(parts, lambda p: p.startswith(".")))
    return kept.select("file", F.decode("content", "UTF-8").alias("text"))


def source_roots(spark: SparkSession, roots: list[str], extensions: list[str], exclude_tests: bool = False) -> DataFrame:
    """`source_files` of one root, or of several with the last part of each root before its files."""
    if len(roots) == 1:
        return source_files(spark, roots[0], extensions, exclude_tests)
    each = [source_files(spark, r, extensions, exclude_tests).withColumn("file", F.concat(F.lit(r.rstrip("/").rsplit("/", 1)[-1] + "/"), "file")) for r in roots]
    return reduce(DataFrame.unionByName, each)


def snippets(files: DataFrame, places: DataFrame, lines: int = 2) -> DataFrame:
    """(id, lines) of places (id, file, start_row): the first lines with text from a row on, numbered from 1, cut at 120 characters.

    A file is also looked for without the first part of its path. Files of more than 2,000,000 characters and places without a row have none.
    """
    text = files.where(F.length("text") <= 2_000_000).select(F.col("file").alias("path"), F.split("text", "\\r?\\n").alias("rows"))
    both = F.array_distinct(F.array("file", F.regexp_replace("file", "^[^/]*/", "")))
    asked = places.where("start_row IS NOT NULL").select("id", "start_row", F.posexplode(both).alias("way", "path"))
    numbered = F.transform("rows", lambda r, n: F.struct((n + 1).alias("n"), F.trim(r, F.lit(" \t")).alias("t")))
    kept = F.slice(F.filter(numbered, lambda x: (x["n"] > F.col("start_row")) & (x["t"] != "")), 1, lines)
    found = asked.join(text, "path").select("id", "way", F.transform(kept, lambda x: F.concat(x["n"], F.lit("| "), F.left(x["t"], F.lit(120)))).alias("lines"))
    return found.where(F.size("lines") > 0).groupBy("id").agg(F.min_by("lines", "way").alias("lines"))


def failures(rows: DataFrame) -> DataFrame:
    """Failed files, each reason once."""
    return rows.dropDuplicates(["file", "reason"])
