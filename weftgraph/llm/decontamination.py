"""Benchmark decontamination: find passages of test items in training documents.

Texts are normalised to lower-cased words; every `N` consecutive words of a test item are a window (an item
of fewer words, but not none, is one window). The distinct windows are a broadcast set, keyed by a 64-bit hash. Where documents
are read, the hash of each of their own windows is looked up in it, and each hit is compared as text at once, so the
result is exact. All of it is column expressions; documents' windows never travel, only hits and slim rows do.

The set is broadcast only up to `SET_BYTES`, which is checked by adding up what it holds. A larger one is dealt by hash into as many
sets of that size as it takes, and the documents are read once for each; the method is the same at every size.

A null text has no words. An empty benchmark leaves every document clean. Repeated rows and repeated ids are
judged one by one. Items with a null id have windows, which hit words like any other, but no entry in the list of
items; items with equal ids count once. Input columns named like results give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import written

#: Words in a window.
N = 10
#: Bytes of windows (text, hash, ids and their share of a hash table) that are broadcast at once.
SET_BYTES = 64 << 20
#: Bytes that a window takes in a hash table beside its text and ids.
ROW_BYTES = 96
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("n_words", "hits", "items")


def words_of(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Every window once: gram, its number of words (len), its hash (h) and the ids of the items that have it; written down."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w"))
    grams = items.where(F.size("w") > 0).select(
        "item_id",
        F.least(F.size("w"), F.lit(n)).alias("len"),
        F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {n} + 1, 1)), i -> slice(w, i, {n}))")).alias("words"),
    )
    each = grams.select("item_id", "len", F.concat_ws(" ", "words").alias("gram"), F.xxhash64("words").alias("h"))
    return written(each.groupBy("gram", "len", "h").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")))


def hits(docs: DataFrame, table: DataFrame, keep: list[str], set_bytes: int = SET_BYTES, on_hits: bool = False) -> DataFrame:
    """(_row, _keep, n_words, at, len, item_ids): a row for each document (its `at` is null), with columns `keep` as `_keep`, and one for each hit.

    `_row` tells which rows are of one document; hits have `_keep` too if asked for. Documents are read once for each `set_bytes` of windows.
    """
    bytes_of = F.octet_length("gram") + F.lit(ROW_BYTES) + F.expr("aggregate(item_ids, 0L, (a, x) -> a + octet_length(x) + 16)")
    size = table.agg(F.sum(bytes_of).alias("bytes"), F.array_sort(F.collect_set("len")).alias("lens")).first()
    lens, blocks = size["lens"] or [N], max(1, -(-(size["bytes"] or 0) // set_bytes))  # N lengths at most
    if blocks > 1:  # every reading numbers the rows alike
        docs = written(docs.select(*map(_named, dict.fromkeys([*keep, "text"]))))
    keep = F.struct(*map(_named, keep))
    read = docs.select(F.monotonically_increasing_id().alias("_row"), keep.alias("_keep"), words_of(F.col("text")).alias("w"))
    # a place for each word and length of windows, and one more, 0, which stands for the document
    spread = read.select("_row", "_keep", "w", F.explode_outer(F.expr(f"sequence(0, size(w) * {len(lens)})")).alias("i"))
    sizes = F.array(*[F.lit(x) for x in lens])
    at, length = F.expr(f"cast((i - 1) div {len(lens)} + 1 AS int)"), F.element_at(sizes, F.expr(f"cast((i - 1) % {len(lens)} + 1 AS int)"))
    placed = spread.select("_row", "_keep", "w", "i", F.when(F.col("i") > 0, at).alias("at"), F.when(F.col("i") > 0, length).alias("len"))
    window = F.slice("w", F.col("at"), F.col("len"))
    hashed = placed.withColumn("own", F.when(F.col("at") + F.col("len") - 1 <= F.size("w"), F.xxhash64(window)))
    found = []
    for b in range(blocks):
        some = table.where(F.pmod("h", F.lit(blocks)) == b).select("h", F.col("gram"), "item_ids")  # set_bytes at most
        joined = hashed.join(F.broadcast(some), F.col("own") == F.col("h"), "left")
        hit = F.col("h").isNotNull() & (F.concat_ws(" ", window) == F.col("gram"))  # texts are made of what the hash finds only
        wanted = hit | (F.col("i") == 0) if b == 0 else hit
        own = F.col("_keep") if on_hits else F.when(F.col("i") == 0, F.col("_keep"))
        of = joined.where(wanted).select("_row", own.alias("_keep"), F.when(F.col("i") == 0, F.size("w").cast("long")).alias("n_words"), F.when(F.col("i") > 0, F.col("at")).alias("at"), "len", "item_ids")
        # one set after the other, so that one at a time is in memory
        found.append(of if blocks == 1 else written(of))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, n: int = N, set_bytes: int = SET_BYTES) -> DataFrame:
    """Columns `keep` of `docs` (all, if not given), with n_words, hits (array of word position from 1, and length) and items (sorted)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    rows = hits(docs, windows(benchmark, n), keep, set_bytes)
    one = rows.groupBy("_row").agg(
        F.first("_keep", ignorenulls=True).alias("_keep"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "len")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"),
    )
    return one.select("_keep.*", "n_words", "hits", "items")


def _named(c: str) -> Column:
    return F.col(f"`{c}`")


def words_hit(hits: Column) -> Column:
    """How many words lie inside a hit."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["len"] - 1))))).cast("long")


def clean(docs: DataFrame, benchmark: DataFrame, set_bytes: int = SET_BYTES) -> DataFrame:
    """Only the documents that hold no window of any test item, unchanged."""
    own = F.xxhash64("text")
    slim = docs.select(F.col("doc_id").alias("_weft_id"), own.alias("_weft_hash"), "text")
    found = hits(slim, windows(benchmark), ["_weft_id", "_weft_hash"], set_bytes, on_hits=True)
    gone = found.where("at IS NOT NULL").select("_keep.*").distinct()
    # told apart by id and hash of the text; Spark broadcasts those that go if they are few, and shuffles if they are many
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_weft_id")) & (own == F.col("_weft_hash")), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = find(docs, benchmark, ["doc_id"])
    hit = words_hit(F.col("hits"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
