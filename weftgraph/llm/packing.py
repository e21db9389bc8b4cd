"""Best-fit packing of tokenised documents into sequences, by a grouping genetic algorithm on islands.

A document's ids are those of a byte-level BPE followed by an end mark. A document that fits a sequence stays whole; a
longer one is cut into full pieces, of which only the first may be shorter. Full pieces are sequences of their
own. The others are dealt by hash into shards of about `SHARD` pieces. On each shard a few islands evolve
populations of packings, whose genes are whole bins: crossover injects well-filled bins of one parent into
the other, dissolves the bins that held the same pieces, and best-fits the displaced pieces; mutation dissolves
the worst-filled bins. After each epoch every island's elite migrates to the next island. Last, badly filled bins of all
shards are pooled and packed again in the same way, so that shards don't each keep an unfilled rest.

Only piece lengths take part in packing; texts and ids never travel. The best fit starts from a best-fit
decreasing packing and never keeps a worse one. Null and empty texts are one end mark long. Repeated rows and ids
are packed as separate documents. An empty table gives an empty result.

The ids come from `tiktoken` with the ranks of the same vocabulary as the `tokenizers` file: the ids are equal (tests
compare them), and encoding takes a fifth of the time.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import written

#: Tokens in a sequence, and the id that ends a document.
CAPACITY, END = 1024, 2
#: Pieces that a shard packs; islands on each shard; packings on an island; generations in an epoch; epochs.
SHARD, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 4096, 2, 6, 12, 2
#: Bins filled less than this are packed again across shards; bins filled at least this well are injected.
POOR, WELL = 0.97, 0.995

PIECE = "row long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def ranks_path() -> str:
    """Where the vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(text: str | None, path: str | None = None) -> np.ndarray:
    """Ids of a document, end mark included."""
    encoder = _encoder(path or ranks_path())
    ids = encoder.encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)
    return np.append(ids, END).astype("<u4")


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece: row (of the document in `docs`), doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = T.StructType([T.StructField("row", T.LongType()), source.schema["doc_id"], *T._parse_datatype_string("piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(2)):
                ids = encode(text.as_py(), path)
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length].tobytes()
                    at.append(i)
                    rows.append((k, start, length, zlib.crc32(part), part))
            take, cols = pa.array(at, pa.int64()), list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays[: len(schema)], names=schema.names)

    return source.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, loads: list[int], bin_of: np.ndarray, order: np.ndarray, capacity: int) -> None:
    """Put the pieces `order` one by one into the bin that they fill best; opens bins as needed. Changes loads and bin_of."""
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for b, load in enumerate(loads):
        if load < capacity:
            by_room.setdefault(capacity - load, []).append(b)
            rooms |= 1 << (capacity - load)
    for i in order.tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        loads[b] += size
        bin_of[i] = b
        if room > size:
            if not by_room.setdefault(room - size, []):
                rooms |= 1 << (room - size)
            by_room[room - size].append(b)


def _compact(bin_of: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins numbered from 0 without gaps, and their loads."""
    _, numbers = np.unique(bin_of, return_inverse=True)
    return numbers.astype(np.int32), np.bincount(numbers, lengths).astype(np.int64)


def fitness(loads: np.ndarray, capacity: int) -> float:
    """Fewer bins first; among equals, those with fuller bins."""
    return -len(loads) + float(np.mean((loads / capacity) ** 2)) if len(loads) else 0.0


def _refit(bin_of: np.ndarray, loads: np.ndarray, displaced: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    room = loads.tolist()
    order = np.flatnonzero(displaced)
    best_fit(lengths, room, bin_of, order[np.argsort(-lengths[order], kind="stable")], capacity)
    return _compact(bin_of, lengths)[0]


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject well-filled bins of b into a; bins of a that held the same pieces are dissolved, their other pieces best-fitted."""
    loads_b = np.bincount(b, lengths)
    good = np.flatnonzero(loads_b >= WELL * capacity)
    if not len(good):
        good = np.argsort(-loads_b)[: max(1, len(loads_b) // 10)]
    chosen = rng.choice(good, max(1, int(len(good) * rng.uniform(0.1, 0.5))), replace=False)
    injected = np.isin(b, chosen)
    displaced = np.isin(a, np.unique(a[injected])) & ~injected
    child = np.where(injected, b + a.max() + 1, a)
    child[displaced] = -1
    kept = child >= 0
    child[kept], loads = _compact(child[kept], lengths[kept])
    return _refit(child, loads, displaced, lengths, capacity)


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the worst-filled bins and some others, and best-fit their pieces."""
    loads = np.bincount(a, lengths)
    worst = np.argsort(loads, kind="stable")[: max(1, len(loads) // 50)]
    displaced = np.isin(a, np.union1d(worst, rng.integers(0, len(loads), max(1, len(loads) // 50))))
    child = a.copy()
    child[displaced] = -1
    if displaced.all():
        loads = np.zeros(0, np.int64)
    else:
        child[~displaced], loads = _compact(child[~displaced], lengths[~displaced])
    return _refit(child, loads, displaced, lengths, capacity)


def evolve(lengths: np.ndarray, start: list[np.ndarray], capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """One island's epoch: the population after GENERATIONS, best first."""
    rank = lambda x: -fitness(np.bincount(x, lengths), capacity)
    least = -(-int(lengths.sum()) // capacity)
    found = list(start)
    while len(found) < POPULATION:
        # the first is best-fit decreasing, each further one less in its order
        noise = lengths * rng.uniform(1 - 0.1 * len(found), 1.0, len(lengths))
        bin_of = np.full(len(lengths), -1, np.int32)
        best_fit(lengths, [], bin_of, np.argsort(-noise, kind="stable"), capacity)
        found.append(bin_of)
    found.sort(key=rank)
    for _ in range(GENERATIONS):
        if found[0].max() + 1 <= least:  # no packing has fewer bins
            break
        young = []
        for _ in range(POPULATION // 2):
            a, b = rng.choice(min(len(found), POPULATION), 2, replace=False)
            young += [crossover(found[a], found[b], lengths, capacity, rng), mutate(found[min(a, b)], lengths, capacity, rng)]
        found = sorted([*found, *young], key=rank)[:POPULATION]
    return found


def _evolved(items: DataFrame, people: DataFrame | None, capacity: int, epoch: int) -> DataFrame:
    """An epoch on all islands: (shard, island, score, bins) of the best two packings of each."""

    def run(key: tuple, own: pd.DataFrame, had: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"shard": [], "island": [], "score": [], "bins": []})
        lengths = own.sort_values("pid")["length"].to_numpy()
        start = [np.frombuffer(x, np.int32) for x in had.sort_values(["score", "bins"])["bins"]] if len(had) else []
        rng = np.random.default_rng([int(key[0]), int(key[1]), epoch])
        best = evolve(lengths, start, capacity, rng)[:2]
        return pd.DataFrame({"shard": key[0], "island": key[1], "score": [fitness(np.bincount(x, lengths), capacity) for x in best], "bins": [x.astype(np.int32).tobytes() for x in best]})

    keys = ["shard", "island"]
    placed = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    schema = "shard long, island int, score double, bins binary"
    if people is None:
        people = items.sparkSession.createDataFrame([], schema)
    return placed.groupBy(keys).cogroup(people.groupBy(keys)).applyInPandas(run, schema)


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    """pid, length, shard, bin, place (in its bin) and load (of its bin), by islands on each shard of (pid, length, shard)."""
    people = None
    for epoch in range(EPOCHS):
        if people is not None:  # each elite also visits the next island
            people = people.unionByName(people.withColumn("island", (F.col("island") + 1) % ISLANDS))
        people = written(_evolved(items, people, capacity, epoch))
    best = people.groupBy("shard").agg(F.max_by("bins", F.struct("score", "bins")).alias("bins"))

    def run(key: tuple, own: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pid").assign(bin=np.frombuffer(chosen["bins"].iloc[0], np.int32) if len(own) else []).sort_values(["bin", "pid"])
        length = own.groupby("bin")["length"]
        return own.assign(place=length.cumsum() - own["length"], load=length.transform("sum"))[["pid", "length", "shard", "bin", "place", "load"]]

    return items.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(run, "pid long, length long, shard long, bin int, place long, load long")


def _sharded(items: DataFrame, salt: int) -> DataFrame:
    """Items dealt by hash into shards of about SHARD each."""
    shards = max(1, round(items.count() / SHARD))
    return items.select("pid", "length", F.pmod(F.xxhash64("pid", F.lit(salt)), F.lit(shards)).alias("shard"))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of `cut` (pieces), with sequence_id and offset: where each piece goes."""
    rows = written(cut.withColumn("pid", F.monotonically_increasing_id()))
    loose = _sharded(rows.where(F.col("length") < capacity).select("pid", "length"), 1)
    first = written(_packed(loose, capacity))
    good = F.col("load") >= POOR * capacity
    place = lambda df, level: df.select("pid", ((F.col("shard") * 2 + level) * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), F.col("place").alias("offset"))
    rest = _sharded(first.where(~good).select("pid", "length"), 2)
    where = place(first.where(good), 0).unionByName(place(_packed(rest, capacity), 1))
    full = rows.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("pid")).withColumn("offset", F.lit(0).cast("long"))
    return rows.where(F.col("length") < capacity).join(where, "pid").unionByName(full).drop("pid")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(pieces(docs).drop("row"))
