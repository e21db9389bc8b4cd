"""Suffix-array deduplication on bytes: passages of `WIDTH` bytes that occur before are removed.

A window of WIDTH bytes takes the smallest hash of the `GRAM`-byte strings in it as its anchor, so that equal windows
have equal anchors. Up to `STEP` consecutive windows with an anchor at one place share a core: the bytes that all of them hold. Only
windows whose anchor occurs more than once, and then only those whose core does too, both counted over the whole corpus, can be
repeated; their segments go to the part of their anchor (of their core, if the anchor is hot). A part is a shard: its
segments are joined in global order, its suffix array comes from induced sorting, and permuted common prefixes of
WIDTH bytes or more group equal windows, of which the earliest stays. Windows are compared as bytes; hashes only decide where they meet.

Texts are their UTF-8 bytes, null is empty; matches never cross documents. Rows with a null id come before all others; equal ids are
ordered by a hash of their text; equal rows are separate documents, of which the first in the input stays. An empty table gives
an empty result. Input columns named like results give way to them. What is kept may not be valid UTF-8, so it is binary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import byte_codes, mixed, range_hashes, written
from weftgraph.llm.repeats import BLOB, PARTS, Chunk, Gathered, Known, blobs, chunked, counted, removed, repeated_values, resolved, runs_of, settled
from weftgraph.llm.suffix_array import common_prefixes, suffix_array

#: Bytes in a window, and in the strings whose hashes are anchors (a power of two).
WIDTH, GRAM = 100, 16
#: Windows that share a core at most: places of the anchor in them are told apart by this.
STEP = 8
_CODES = byte_codes(21)
_BASE = 0x9E3779B97F4A7C15
#: No UTF-8 text has this byte.
_END = b"\xff"
RESULTS = ("n_bytes", "n_removed", "spans", "kept")


@dataclass
class Windows:
    """The windows of joined texts: where they start in the buffer, their anchors, the anchor's place in the buffer and (`within`) in the window, and their documents."""

    data: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    within: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Windows:
        data = np.frombuffer(_END.join(texts) + _END, np.uint8)
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes + 1) - sizes - 1
        some = sizes >= WIDTH
        counts = sizes[some] - WIDTH + 1
        none = np.zeros(0, np.int64)
        if not len(counts):
            return Windows(data, none, np.zeros(0, np.uint64), none, none)
        at = np.repeat(begins[some] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        h, k = _CODES[data], 1
        while k < GRAM:
            h[:-k] += h[k:] * np.uint64(pow(_BASE, k, 1 << 64))
            k *= 2
        h = mixed(h) >> np.uint64(7)
        place = np.arange(len(h), dtype=np.uint64) & np.uint64(127)
        # of equal strings one pass finds the one of the smallest place (modulo 128), the other that of the largest
        least, last = (_smallest((h << np.uint64(7)) | x, at) for x in (place, np.uint64(127) - place))
        within = ((least & np.uint64(127)).astype(np.int64) - at) & 127
        ties = np.flatnonzero((least & np.uint64(127)) + (last & np.uint64(127)) != np.uint64(127))
        for lo in range(0, len(ties), 4096):  # the first of several, wherever the window stands
            some = ties[lo : lo + 4096]
            within[some] = h[at[some][:, None] + np.arange(WIDTH - GRAM + 1)].argmin(1)
        return Windows(data, at, mixed(least >> np.uint64(7)), within, np.repeat(np.flatnonzero(sizes >= WIDTH), counts))

    def anchored(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of windows whose anchor is at one place: (first, count). Each is one occurrence of its anchor."""
        return runs_of(self.at + self.within, self.at)

    def take(self, some: np.ndarray) -> Windows:
        """Some of the windows."""
        return Windows(self.data, self.at[some], self.anchor[some], self.within[some], self.doc[some])

    def cores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows that share a core: (first, count, hash of the core)."""
        first, count = runs_of((self.at + self.within) * 16 + self.within // STEP, self.at)
        start = self.at[first] + self.within[first] % STEP
        return first, count, range_hashes(self.data, start, start + WIDTH - STEP + 1, _CODES, _BASE)


def _smallest(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The smallest hash of each window; changes h."""
    left, span = WIDTH - GRAM + 1, 1
    while span * 2 <= left:
        np.minimum(h[:-span], h[span:], out=h[:-span])
        span *= 2
    return np.minimum(h[at], h[at + left - span])


def _chunk_anchors(parts: int):
    """Each chunk's anchors, with counts of the places where they occur."""

    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk.of(table)
        found = []
        for _, texts in chunk.slices():
            w = Windows.of(texts)
            found.append(w.anchor[w.anchored()[0]])
        return blobs([(p, chunk.chunk, b) for p, b in counted(np.concatenate(found), parts)])

    return run


def _of_known_anchors(w: Windows, known: Known, parts: int) -> tuple[Windows, np.ndarray]:
    """Windows with known anchors, and which of these are hot."""
    first, count = w.anchored()
    good, flags = known.look_up(w.anchor[first], parts)
    some = np.repeat(good, count)
    return w.take(some), np.repeat(flags & 2 > 0, count)[some]


def _chunk_cores(parts: int):
    """The cores of each chunk's windows with repeated anchors, with counts."""

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        chunk = Chunk.of(table)
        known, found = Known.of(back), [np.zeros(0, np.uint64)]
        for _, texts in chunk.slices() if len(known.codes) else ():
            found.append(_of_known_anchors(Windows.of(texts), known, parts)[0].cores()[2])
        return blobs([(p, chunk.chunk, b) for p, b in counted(np.concatenate(found), parts)])

    return run


def _segments(counted_parts: int, parts: int):
    """Each chunk's windows with repeated cores, as segments with one anchor each, those of hot anchors with one core each.

    What came back has anchors in parts below `counted_parts`, and cores in the parts from there on.
    """

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        chunk = Chunk.of(table)
        is_core = pc.greater_equal(back["part"], counted_parts)
        known = Known.of(back.filter(pc.invert(is_core)))
        cores = back.filter(is_core)
        cores = Known.of(cores.set_column(cores.schema.get_field_index("part"), "part", pc.subtract(cores["part"], counted_parts)))
        out = Gathered(chunk, parts)
        for lo, texts in chunk.slices() if len(cores.codes) else ():
            w, hot = _of_known_anchors(Windows.of(texts), known, counted_parts)
            first, count, core = w.cores()
            good, _ = cores.look_up(core, counted_parts)
            some = np.repeat(good, count)
            opens = np.zeros(len(w.at), bool)
            opens[first] = True
            w, hot, key, opens = w.take(some), hot[some], np.repeat(core, count)[some], opens[some]
            first, count = runs_of(w.anchor, w.at, hot & opens)
            key = np.where(hot, key, w.anchor)[first]
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
            raw, own, start = w.data.tobytes(), w.doc[first], w.at[first]
            for a, d, s, c, b in zip(key.tolist(), own.tolist(), (start - begins[own]).tolist(), count.tolist(), start.tolist(), strict=True):
                out.add(a, d + lo, s, c, raw[b : b + c - 1 + WIDTH])
        return out.table()

    return run


def repeated(segments: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of each window of WIDTH bytes that an equal one stands before.

    The segments are distinct by now, so cores are counted again among them; a suffix array of all stretches that are left decides.
    """
    w = Windows.of(segments)
    _, count, core = w.cores()
    _, which, times = np.unique(core, return_inverse=True, return_counts=True)
    w = w.take(np.repeat(times[which] > 1, count))
    first, count = runs_of(w.doc, w.at)
    if not len(first):
        return first, first
    begins = np.cumsum([0, *(len(s) + 1 for s in segments)])
    raw, at, own = w.data.tobytes(), w.at[first], w.doc[first]
    stretch, window = _repeated([raw[b : b + c - 1 + WIDTH] for b, c in zip(at.tolist(), count.tolist(), strict=True)], count)
    return own[stretch], (at - begins[own])[stretch] + window


def _repeated(stretches: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = np.frombuffer(_END.join(stretches) + _END, np.uint8)
    begins = np.cumsum([0, *(len(s) + 1 for s in stretches)])
    whole = np.zeros(len(text), bool)
    whole[np.repeat(begins[:-1] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())] = True
    sa = suffix_array(text)
    equal = common_prefixes(text, sa)[sa] >= WIDTH
    first = np.flatnonzero(~equal)
    earliest = np.repeat(np.minimum.reduceat(sa, first), np.diff(np.append(first, len(sa))))
    later = np.sort(sa[(sa != earliest) & whole[sa]])
    stretch = np.searchsorted(begins, later, "right") - 1
    return stretch, later - begins[stretch]


def dedup(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `docs` (all but text, if not given), with n_bytes, n_removed, spans (runs of removed bytes: at, end) and kept."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*RESULTS, "text")]
    name, result = _dedup(docs, keep)
    return settled(result, name)


def _dedup(docs: DataFrame, keep: list[str]) -> tuple[str, DataFrame]:
    """The result of `dedup`, and the table that it is read from."""
    name, chunks = chunked(docs, keep)
    table, parts = docs.sparkSession.table(name), chunks * PARTS
    answered = lambda df: df.repartition(chunks, "part").groupBy("part").applyInArrow(repeated_values(), BLOB)
    anchors = written(answered(table.groupBy("chunk").applyInArrow(_chunk_anchors(chunks), BLOB)))  # read twice
    cores = answered(table.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(_chunk_cores(chunks), BLOB))
    back = anchors.unionByName(cores.withColumn("part", F.col("part") + chunks))
    segments = table.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_segments(chunks, parts), BLOB)
    gone = segments.repartition(chunks, "part").groupBy("part").applyInArrow(lambda t: resolved(t, repeated), "chunk int, blob binary")
    more = T._parse_datatype_string("n_bytes long, n_removed long, spans array<struct<at:long,end:long>>, kept binary").fields
    schema = T.StructType([*table.schema["_keep"].dataType.fields, *more])

    def finish(own: pa.Table, blobs: pa.Table) -> pa.Table:
        chunk = Chunk.of(own)
        spans = removed(chunk, blobs, WIDTH)
        kept = []
        for text, some in zip(chunk.texts, spans, strict=True):
            edges = [0, *(x for span in some for x in span), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        lost = [sum(b - a for a, b in some) for some in spans]
        of = pa.list_(pa.struct([("at", pa.int64()), ("end", pa.int64())]))
        cols = dict(zip(keep, chunk.table["_keep"].combine_chunks().flatten(), strict=True))
        return pa.table(cols | {"n_bytes": pa.array([len(t) for t in chunk.texts], pa.int64()), "n_removed": pa.array(lost, pa.int64()), "spans": pa.array([[{"at": a, "end": b} for a, b in some] for some in spans], of), "kept": pa.array(kept, pa.binary())})

    return name, table.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(finish, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    name, result = _dedup(docs, ["doc_id"])
    return settled(result.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), name)
