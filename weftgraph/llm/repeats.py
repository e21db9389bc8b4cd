"""What substring and suffix-array deduplication share: chunks of documents, segments of windows, and what is removed.

Both judge windows (a fixed number of consecutive words or bytes): every occurrence but the earliest is removed. Windows
are given an anchor that their content alone decides, so equal windows have equal anchors. Consecutive windows
with one anchor form a segment, which goes to the part of its anchor; all equal windows meet there, and
nothing but the text of passages that seem repeated travels.

An anchor that occurs more than `HOT` times, counted over the whole corpus, is hot: its windows go to parts by a finer key, which
nearly their whole content decides, so a phrase in very many contexts is spread over all parts, and equal windows still meet.

Documents are dealt by hash of id, text and place in the input into chunks of bounded size, kept as a bucketed table in the
warehouse so that each pass finds a chunk's documents together without another shuffle; the table is dropped when the result is
written. Within a chunk equal segments are merged before they travel: a passage that very many documents share is
sent once from each chunk.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import SLICE_BYTES, as_bytes, pieces_for, slices, text_bytes, written

#: UTF-8 bytes of text in a chunk; parts that segments are dealt into, for each chunk.
CHUNK, PARTS = 16 << 20, 4
#: Windows in a segment at most: a longer run of one anchor is cut. Occurrences beyond which an anchor is hot.
RUN, HOT = 256, 4096
BLOB = "part int, chunk int, blob binary"


def chunked(docs: DataFrame, keep: list[str]) -> tuple[str, int]:
    """Name of a table bucketed by chunk with `_keep` (a struct of columns `keep`), `_id`, `_text`, `_hash`, `_number` and `chunk`; how many chunks."""
    spark = docs.sparkSession
    n = pieces_for(spark, text_bytes(docs), CHUNK)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), F.monotonically_increasing_id().alias("_number"))
    rows = rows.withColumn("_hash", F.xxhash64("_id", "_text")).withColumn("chunk", F.pmod(F.xxhash64("_hash", "_number"), F.lit(n)).cast("int"))
    name = f"weft_{uuid.uuid4().hex}"
    rows.repartition(n, "chunk").write.bucketBy(n, "chunk").option("compression", "zstd").saveAsTable(name)
    return name, n


def settled(result: DataFrame, name: str) -> DataFrame:
    """`result` written down, and the table that it was made from dropped."""
    out = written(result)
    result.sparkSession.sql(f"DROP TABLE {name}")
    return out


@dataclass
class Chunk:
    """A chunk's documents in their global order: id (null first), then hash of the text, then place in the input."""

    table: pa.Table
    texts: list[bytes]
    keys: np.ndarray  # id, hash, number
    chunk: int

    @staticmethod
    def of(table: pa.Table) -> Chunk:
        ids = table["_id"].to_numpy() if table["_id"].null_count == 0 else table["_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
        keys = np.stack([ids, table["_hash"].to_numpy(), table["_number"].to_numpy()], 1)
        order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
        table = table.take(pa.array(order))
        return Chunk(table, as_bytes(table["_text"]), keys[order], int(table["chunk"][0].as_py()) if len(table) else -1)

    def slices(self) -> Iterator[tuple[int, list[bytes]]]:
        """(first row, texts) of about SLICE_BYTES each."""
        for lo, hi in slices(np.array([len(t) for t in self.texts]), SLICE_BYTES):
            yield lo, self.texts[lo:hi]


def packed(v: np.ndarray) -> bytes:
    """Sorted unsigned 32-bit values as differences: low halves as they are, high halves compressed."""
    d = np.diff(v, prepend=v.dtype.type(0)).astype(np.uint32)
    return len(v).to_bytes(4, "little") + (d & np.uint32(0xFFFF)).astype("<u2").tobytes() + zlib.compress((d >> np.uint32(16)).astype("<u2").tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, bytes]:
    """The values of `packed`, and what follows them."""
    n = int.from_bytes(blob[:4], "little")
    end = zlib.decompressobj()
    high = np.frombuffer(end.decompress(blob[4 + 2 * n :]), "<u2").astype(np.uint32)
    low = np.frombuffer(blob, "<u2", n, 4).astype(np.uint32)
    return np.cumsum((high << np.uint32(16)) | low, dtype=np.uint32), end.unused_data


def split_by_part(f: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) for each part that some of the 64-bit values f belong to."""
    part = (f % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if edges[p] < edges[p + 1]:
            yield p, order[edges[p] : edges[p + 1]]


def code_of(f: np.ndarray, parts: int) -> np.ndarray:
    """Part and high half of 64-bit values as one sortable number."""
    return ((f % np.uint64(parts)) << np.uint64(32)) | (f >> np.uint64(32))


def counted(f: np.ndarray, parts: int, marks: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """(part, blob) for a chunk's 64-bit values f: each once, with how often it occurs (65,535 at most), and whether any of it is marked."""
    for p, places in split_by_part(f, parts):
        v = (f[places] >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(v, kind="stable")
        v = v[order]
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        counts = np.minimum(np.diff(np.append(first, len(v))), 65535).astype("<u2")
        more = counts.tobytes() if marks is None else counts.tobytes() + np.packbits(np.logical_or.reduceat(marks[places][order], first)).tobytes()
        yield p, packed(v[first]) + zlib.compress(more, 1)


def repeated_values(marked: bool = False) -> Callable[[pa.Table], pa.Table]:
    """For a part of `counted` rows: each chunk gets back those of its values that occur more than once in all, with flags (1: marked anywhere, 2: hot)."""
    hot = HOT

    def run(table: pa.Table) -> pa.Table:
        values, counts, marks = [], [], []
        for blob in table["blob"].to_pylist():
            v, rest = unpacked(blob)
            rest = zlib.decompress(rest)
            values.append(v)
            counts.append(np.frombuffer(rest, "<u2", len(v)).astype(np.int64))
            marks.append(np.unpackbits(np.frombuffer(rest, np.uint8, offset=2 * len(v)), count=len(v)).astype(bool) if marked else np.ones(len(v), bool))
        v, count, mark = np.concatenate(values), np.concatenate(counts), np.concatenate(marks)
        order = np.argsort(v, kind="stable")
        first = np.flatnonzero(np.append(True, v[order][1:] != v[order][:-1]))
        sums, sizes = np.add.reduceat(count[order], first), np.diff(np.append(first, len(v)))
        flag = np.logical_or.reduceat(mark[order], first) * np.uint8(1) + (sums > hot) * np.uint8(2)
        again, flags = np.zeros(len(v), bool), np.zeros(len(v), np.uint8)
        again[order], flags[order] = np.repeat(sums > 1, sizes), np.repeat(flag, sizes)
        ends = np.cumsum([len(x) for x in values])
        own = []
        for e, x in zip(ends, values, strict=True):
            good = again[e - len(x) : e]
            own.append(packed(x[good]) + zlib.compress(flags[e - len(x) : e][good].tobytes(), 1))
        return pa.table({"part": table["part"], "chunk": table["chunk"], "blob": pa.array(own, pa.binary())})

    return run


def blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """Rows (part, chunk, blob)."""
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table({"part": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int32()), "blob": pa.array(cols[2], pa.binary())})


@dataclass
class Known:
    """What a chunk got back: sorted codes and their flags."""

    codes: np.ndarray
    flags: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Known:
        codes, flags = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for p, blob in sorted(zip(table["part"].to_pylist(), table["blob"].to_pylist(), strict=True)):
            v, rest = unpacked(blob)
            codes.append((np.uint64(p) << np.uint64(32)) | v.astype(np.uint64))
            flags.append(np.frombuffer(zlib.decompress(rest), np.uint8))
        return Known(np.concatenate(codes), np.concatenate(flags))

    def look_up(self, f: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the 64-bit values f are known, and the flags of those."""
        if not len(self.codes):
            return np.zeros(len(f), bool), np.zeros(len(f), np.uint8)
        codes = code_of(f, parts)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        return known, np.where(known, self.flags[at], np.uint8(0))


def runs_of(key: np.ndarray, at: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows at consecutive places `at` with equal keys, RUN long at most: (first, count), as indexes into `at`; those marked `alone` stay so."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1))
    if alone is not None:
        new |= alone
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(place % RUN == 0)
    return first, np.diff(np.append(first, len(at)))


@dataclass
class Gathered:
    """Segments of one chunk: equal ones are kept once, and later ones are removed at once."""

    chunk: Chunk
    parts: int
    seen: set = field(default_factory=set)
    rows: dict = field(default_factory=dict)  # part -> list of (doc, start, windows, text)
    gone: list = field(default_factory=list)  # (doc, start, windows)

    def add(self, key: int, doc: int, start: int, count: int, text: bytes) -> None:
        if text in self.seen:
            self.gone.append((doc, start, count))
        else:
            self.seen.add(text)
            self.rows.setdefault(key % self.parts, []).append((doc, start, count, text))

    def table(self) -> pa.Table:
        """One row for each part that this chunk has segments for; what is removed already goes along to any part."""
        out = [(p, self.chunk.chunk, _segments_blob(self.chunk.keys, rows)) for p, rows in self.rows.items()]
        if self.gone:
            gone = np.array(self.gone, np.int64)
            keys = self.chunk.keys[gone[:, 0]]
            out.append((self.chunk.chunk % self.parts, self.chunk.chunk, b"G" + _zipped(np.column_stack([keys, gone[:, 1:]]))))
        return blobs(out)


def _zipped(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a.T.astype("<i8")).tobytes(), 1)


def _unzipped(b: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), "<i8").reshape(width, -1).T


def _segments_blob(keys: np.ndarray, rows: list[tuple]) -> bytes:
    doc, start, count, texts = zip(*rows, strict=True)
    meta = _zipped(np.column_stack([keys[list(doc)], start, count, [len(t) for t in texts]]))
    return b"S" + len(meta).to_bytes(4, "little") + meta + b"".join(texts)


def resolved(table: pa.Table, repeated: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """For a part: which windows go, by chunk: rows (id, hash, number, start, windows).

    `repeated` gets the distinct segments in global order, and their windows; it returns (segment, window) of those with an equal one before.
    """
    gone: dict[int, list[np.ndarray]] = {}
    metas, texts, chunks = [], [], []
    for chunk, blob in zip(table["chunk"].to_pylist(), table["blob"].to_pylist(), strict=True):
        if blob[:1] == b"G":
            gone.setdefault(chunk, []).append(_unzipped(blob[1:], 5))
            continue
        size = int.from_bytes(blob[1:5], "little")
        meta = _unzipped(blob[5 : 5 + size], 6)
        ends = 5 + size + np.cumsum(meta[:, 5])
        texts += [blob[a:b] for a, b in zip((ends - meta[:, 5]).tolist(), ends.tolist(), strict=True)]
        metas.append(meta)
        chunks.append(np.full(len(meta), chunk))
    if metas:
        meta, chunk = np.concatenate(metas), np.concatenate(chunks)
        order = np.lexsort((meta[:, 3], meta[:, 2], meta[:, 1], meta[:, 0]))
        meta, chunk, first, seen = meta[order], chunk[order], [], set()
        for i, j in enumerate(order.tolist()):
            if texts[j] not in seen:
                seen.add(texts[j])
                first.append(i)
        again = np.ones(len(meta), bool)
        again[first] = False
        out = [np.column_stack([chunk[again], meta[again][:, :5]])]
        segment, window = repeated([texts[order[i]] for i in first], meta[first, 4])
        if len(segment):  # neighbouring windows of a segment together
            new = np.append(True, (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1))
            at = np.flatnonzero(new)
            i = np.array(first)[segment[at]]
            out.append(np.column_stack([chunk[i], meta[i, :3], meta[i, 3] + window[at], np.diff(np.append(at, len(segment)))]))
        found = np.concatenate(out)
        found = found[np.argsort(found[:, 0], kind="stable")]
        for part in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1):
            if len(part):
                gone.setdefault(int(part[0, 0]), []).append(part[:, 1:])
    return pa.table({"chunk": pa.array(list(gone), pa.int32()), "blob": pa.array([_zipped(np.concatenate(x)) for x in gone.values()], pa.binary())})


def removed(chunk: Chunk, blobs: pa.Table, width: int) -> list[list[tuple[int, int]]]:
    """For each document of a chunk the maximal runs (start, end) of units that go, in order; width: units in a window."""
    out: list[list[tuple[int, int]]] = [[] for _ in chunk.texts]
    rows = [_unzipped(b, 5) for b in blobs["blob"].to_pylist()]
    if not rows:
        return out
    gone = np.concatenate(rows)
    names = {tuple(k): i for i, k in enumerate(chunk.keys.tolist())}
    doc = np.array([names[k] for k in map(tuple, gone[:, :3].tolist())])
    order = np.lexsort((gone[:, 3], doc))
    doc, start, end = doc[order], gone[order, 3], (gone[:, 3] + gone[:, 4] - 1 + width)[order]
    for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
        own = out[d]
        if own and a <= own[-1][1]:
            if b > own[-1][1]:
                own[-1] = (own[-1][0], b)
        else:
            own.append((a, b))
    return out
