"""The property graph: tables of nodes, edges and metadata, read tolerantly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _schema(text: str) -> T.StructType:
    """From `name type, ...`; needs no session."""
    kinds = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in text.split(","))])


NODES = _schema(
    "id string, parent string, type string, name string, file string, is_static boolean, is_abstract boolean, return_type string,"
    " visibility string, scope string, data_type string, start_row int, start_column int, end_row int, end_column int,"
    " keywords strings, description string, workspace string, runtime string, ord bigint"
)
EDGES = _schema("id string, from_id string, to_id string, type string, call_type string, via string, argument_index int, confidence double, reason string, ord bigint")


def tolerant(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema`; those that `df` lacks are null. Abstract marks are also looked for in `raw_json`."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "is_abstract" and "raw_json" in df.columns:
            cols.append(F.get_json_object("raw_json", "$.isAbstract").cast("boolean").alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


@dataclass(frozen=True)
class CodeGraph:
    """Nodes and edges as DataFrames; operators never change them."""

    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame | None = None

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, meta: DataFrame | None = None) -> CodeGraph:
        """From tables that may lack columns; an edge without id is named by its ends and type."""
        e = tolerant(edges, EDGES).withColumn("id", F.coalesce("id", F.concat_ws("-", "from_id", "to_id", "type")))
        return CodeGraph(tolerant(nodes, NODES), e, meta)
