"""Helpers that the operators share: shared storage, chunk counts and batches of texts."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a task works on at once (its arrays then stay in the caches); slim rows that a task takes at most.
SLICE_BYTES, TASK_ROWS = 1 << 17, 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weft-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small table."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return df.select(F.sum(F.octet_length(F.col(f"`{col}`")).cast("long")).alias("n")).first()["n"] or 0


def pieces_for(spark: SparkSession, size: int, each: int) -> int:
    """How many pieces of about `each` bytes: at least as many as Spark shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / each))


def parts_for(spark: SparkSession, rows: int) -> int:
    """How many partitions of at most about TASK_ROWS slim rows: they grow in number with the data, not in size."""
    return pieces_for(spark, rows, TASK_ROWS)


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer text stands alone."""
    ends = np.cumsum(sizes)
    lo, n = 0, len(sizes)
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield lo, hi
        lo = hi


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (the public splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_codes(seed: int) -> np.ndarray:
    """A random unsigned 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a number, modulo 2 to the 64th."""
    had = _POWERS.get(base)
    if had is None or len(had) < n:
        had = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 20), np.uint64(base))]), dtype=np.uint64)
        if n <= 1 << 22:
            _POWERS[base] = had
    return had


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each range of bytes, from prefix sums of a polynomial in `base` (an odd number)."""
    n = len(data)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[data] * powers(base, n)[:n], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * powers(pow(base, -1, 1 << 64), n)[starts])
