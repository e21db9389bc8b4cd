import hashlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import brute_removed, edge_docs, empty_docs, random_docs, words
from weftgraph.llm import near_copies, repeats, simhash, substring_dedup, suffix_dedup
from weftgraph.llm.suffix_array import common_prefixes, suffix_array


@pytest.mark.parametrize("seed", range(120))
def test_suffix_array_and_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 220))
    data = rng.integers(0, int(rng.integers(1, 6)), n).astype(np.uint8) + (250 if seed % 3 == 0 else 60)
    text = data.tobytes()
    want = sorted(range(n), key=lambda i: text[i:])
    found = suffix_array(data)
    assert found.tolist() == want
    p = common_prefixes(data, found)
    for a, b in zip(want, want[1:]):
        k = 0
        while k < n - max(a, b) and text[a + k] == text[b + k]:
            k += 1
        assert p[b] == k


def test_suffix_array_of_runs():
    data = np.frombuffer(b"a" * 3000 + b"ab" * 1500, np.uint8)
    text = data.tobytes()
    assert suffix_array(data).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_substring_dedup_is_exact(spark):
    rows = random_docs(1) + [(100, "r " * 90), (101, "a b " * 40)]
    got = {r.doc_id: r for r in substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    units = [words(t) for _, t in rows]
    for (i, _), w, gone in zip(rows, units, brute_removed(units, 20)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert sum(r.n_removed for r in got.values()) > 100


def test_suffix_dedup_is_exact(spark):
    rows = random_docs(2, n=40) + [(100, "r " * 120), (101, "äöü" * 60), (102, "äöü" * 60), (103, "x" * 99), (104, "x" * 99)]
    got = {r.doc_id: r for r in suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    units = [t.encode() for _, t in rows]
    for (i, _), u, gone in zip(rows, units, brute_removed(units, 100)):
        kept = bytes(x for x, g in zip(u, gone) if not g)
        spans = sum(1 for a, b in zip([False, *gone], gone) if b and not a)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_of_periods(spark):
    """A block that only follows itself, also where its period is the number of strings in a window."""
    rng = np.random.default_rng(85)
    rows = []
    for period in (84, 85, 86, 100):
        for copies in (2, 3, 4):
            block = bytes(rng.integers(97, 123, period).astype(np.uint8)).decode()
            rows.append((len(rows), block * copies))
    got = {r.doc_id: r for r in suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    units = [t.encode() for _, t in rows]
    for (i, _), u, gone in zip(rows, units, brute_removed(units, 100)):
        kept = bytes(x for x, g in zip(u, gone) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest())


def _largest_group(monkeypatch, tmp_path):
    """Bytes of the largest group that `resolved` gets, as a file that tasks write to."""
    plain, log = repeats.resolved, tmp_path / "groups"

    def watched(table, repeated):
        with open(log, "a") as f:
            f.write(f"{sum(len(b) for b in table['blob'].to_pylist())}\n")
        return plain(table, repeated)

    for module in (substring_dedup, suffix_dedup):
        monkeypatch.setattr(module, "resolved", watched)
    return lambda: [int(x) for x in log.read_text().split()]


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_a_phrase_in_very_many_contexts(spark, op, monkeypatch, tmp_path):
    """One phrase in 100,000 different contexts, each of which occurs twice: no task gets them all, and the result is exact."""
    sizes = _largest_group(monkeypatch, tmp_path)
    phrase = "this phrase of a licence stands in very many texts amid ever other words"
    n, word = 100_000, lambda k: f"concat('w', hex(xxhash64(i, {k})))"
    text = F.expr(f"concat_ws(' ', {', '.join(map(word, range(5)))}, '{phrase}', {', '.join(map(word, range(5, 10)))})")
    docs = spark.range(n * 2).selectExpr("id AS doc_id", f"id % {n} AS i").select("doc_id", text.alias("text"))
    got = op.report(docs)
    size = F.size(F.split("text", " ")) if op is substring_dedup else F.length("text")
    want = docs.agg(F.sum(F.when(F.col("doc_id") >= n, size))).first()[0]
    total = got.agg(F.sum("n_removed").alias("n"), F.sum(F.when(F.col("doc_id") < n, F.col("n_removed"))).alias("early")).first()
    assert (total["n"], total["early"]) == (want, 0)
    found = sizes()
    assert max(found) < sum(found) // 4


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
@pytest.mark.parametrize("hot", [2, 6])
def test_hot_anchors_are_exact(spark, op, hot, monkeypatch):
    """The finer keys of hot anchors change nothing, with every anchor hot and with some."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = np.random.default_rng(hot)
    phrase = " ".join(f"p{i}" for i in range(40))
    rows = random_docs(hot, n=40)
    rows += [(100 + i, f"{' '.join(f'a{rng.integers(3)}' for _ in range(8))} {phrase} {' '.join(f'b{rng.integers(3)}' for _ in range(8))}") for i in range(60)]
    rows += [(300, "r " * 90), (301, "a b " * 60), (302, "x" * 400), (303, ("q" * 84 + "z") * 4)]
    got = {r.doc_id: r for r in op.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    units = [words(t) if op is substring_dedup else t.encode() for _, t in rows]
    for (i, _), u, gone in zip(rows, units, brute_removed(units, op.WIDTH)):
        kept = [x for x, g in zip(u, gone) if not g]
        want = " ".join(kept).encode() if op is substring_dedup else bytes(kept)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(want).hexdigest())


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_dedup_of_equal_rows_in_many_chunks(spark, op, monkeypatch):
    """Rows of one id and text are dealt to many chunks; all but the first go. The tables are dropped."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(400).selectExpr("7L AS doc_id", f"'{text}' AS text").repartition(16)
    before = {t.name for t in spark.catalog.listTables()}
    got = sorted(r.n_removed for r in op.report(docs).collect())
    assert got == [0] + [len(text.split()) if op is substring_dedup else len(text)] * 399
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_dedup_edge_cases(spark, op):
    docs = edge_docs(spark)
    out = op.dedup(docs)
    rows = out.collect()
    assert len(rows) == docs.count()
    assert "lang" in out.columns and "text" not in out.columns
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    # without an id comes first; null and empty texts have nothing to remove
    assert [r.n_removed for r in by[3]] == [0] and [r.n_removed for r in by[4]] == [0]
    # document 7 is a copy of 6, and of the equal rows of document 2 one stays
    assert by[7][0].n_removed > 50_000 and by[6][0].n_removed < by[7][0].n_removed
    assert op.dedup(empty_docs(spark)).collect() == []


def _brute_fingerprint(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in words(text)]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_components(ids, fps, distance=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in simhash.report(docs).collect()}
    fps = [_brute_fingerprint(r.text) for r in rows]
    for r, f, c in zip(rows, fps, _brute_components([r.doc_id for r in rows], fps)):
        assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{f:016x}", c)


@pytest.mark.parametrize("hot", [1024, 3])
def test_links_of_close_fingerprints(spark, hot, monkeypatch):
    """Clusters around a few values, with the way for hot segments and without."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(hot)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(40):
            x = b
            for _ in range(int(rng.integers(1, 5))):
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    roots = {r.node: r.root for r in simhash.connected(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    want = _brute_components(signed, fps)
    groups = {}
    for x, w in zip(signed, want):
        groups.setdefault(w, set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_every_pair_of_bits_links():
    """Fingerprints that differ in any two bits, the sign bit included, are linked; in three bits they are not."""
    rng = np.random.default_rng(64)
    base = int(rng.integers(0, 2**63, dtype=np.uint64)) | 1 << 63
    signed = lambda x: np.int64(x - 2**64 if x >= 2**63 else x)
    for a in range(64):
        for b in range(a):
            two = np.array([signed(base), signed(base ^ 1 << a ^ 1 << b)])
            assert len(simhash._linked(np.zeros(2, np.int64), two, 2)[0]) == 1, (a, b)
            three = np.array([signed(base), signed(base ^ 1 << a ^ 1 << b ^ 1 << ((a + 1) % 64 if (a + 1) % 64 != b else (a + 2) % 64))])
            assert len(simhash._linked(np.zeros(2, np.int64), three, 2)[0]) == 0, (a, b)
    many = np.array([signed(base ^ 1 << 63 ^ 1 << b) for b in range(60)] + [signed(base)])  # a group that is compared at once
    left, right = simhash._linked(np.zeros(61, np.int64), many, 2)
    assert len(set(right.tolist())) == 60


def test_connected_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.connected(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_simhash_edge_cases(spark):
    docs = edge_docs(spark)
    out = simhash.report(docs).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[3] == by[4] == by[5] == {("0" * 16, 3)}
    assert by[1] == {(next(iter(by[1]))[0], 1)} and next(iter(by[1])) in by[2]
    assert next(iter(by[6])) == next(iter(by[7]))
    assert simhash.report(empty_docs(spark)).collect() == []


def test_near_copies(spark):
    base = [f"word{i}" for i in range(400)]
    near = base.copy()
    near[200] = "changed"
    far = [w if i % 4 else f"other{i}" for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base)), (5, "short"), (6, "short"), (7, "other"), (8, None), (9, "")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8]
    docs = edge_docs(spark)
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 6, 8, 9] and ids.count(None) == 1
    assert near_copies.keep_one(empty_docs(spark)).collect() == []


def _brute_kept(rows):
    """The smallest id of each component of texts whose exact sets of shingles have a Jaccard similarity of 0.8 or more."""
    sets = [set(near_copies.shingles((t or "").encode()).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= near_copies.SIMILARITY * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def _edited(rng, text, edits):
    """`text` with words changed at places at least a shingle apart."""
    out = text.copy()
    for i in rng.choice(len(text) // 6, edits, replace=False).tolist():
        out[i * 6] = f"edit{rng.integers(10**9)}"
    return out


def test_near_copies_of_a_common_original(spark):
    """Groups of many more than 8 whose members are near their original and too far from each other, with chains of two behind them."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(600)]
        group = [base] + [_edited(rng, base, 9) for _ in range(150)]
        group += [_edited(rng, x, 9) for x in group[1:6]]
        rows += [" ".join(group[k]) for k in rng.permutation(len(group)).tolist()]
    rows = list(enumerate(rows))
    want = _brute_kept(rows)
    assert len(want) < len(rows) // 4
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == want


def test_near_copies_at_the_limit(spark):
    """Pairs with one link only, at a similarity of exactly 0.8."""
    rng = np.random.default_rng(6)
    rows = []
    for g in range(150):
        base = [f"g{g}w{i}" for i in range(274)]
        rows += [" ".join(base), " ".join(_edited(rng, base[1:-1], 6)) if g % 3 == 2 else " ".join(_inner(rng, base, 6))]
    rows = list(enumerate(rows))
    want = _brute_kept(rows)
    assert 150 <= len(want) <= 200
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == want


def _inner(rng, text, edits):
    """`_edited`, but each changed word is in five shingles."""
    return text[:4] + _edited(rng, text[4:-4], edits) + text[-4:]


def test_sketches_bound_how_many_hashes_differ():
    rng = np.random.default_rng(11)
    for n, m, both in ((0, 0, 0), (0, 3, 0), (1, 1, 0), (100, 130, 90), (128, 129, 120), (1000, 1030, 990), (5000, 4000, 100), (70_000, 60_000, 59_000)):
        pool = np.unique(rng.integers(0, 2**64, n + m, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = pool[:n], np.concatenate([pool[:both], pool[n : n + m - both]])
        got = near_copies.apart(near_copies.sketch(a), near_copies.sketch(b))
        assert got == near_copies.apart(near_copies.sketch(b), near_copies.sketch(a)) <= n + m - 2 * both
        if n > 64:  # about as many as parities of random places differ in
            differ, bits = n + m - 2 * both, 8 * min(len(near_copies.sketch(a)), len(near_copies.sketch(b)))
            assert got > 0.75 * bits / 2 * (1 - np.exp(-2 * differ / bits))


def test_groups_of_a_shared_token_lose_no_link(spark, monkeypatch):
    """Small groups give pairs, larger ones members whose blocks are compared on sketches: together at least all links, and no pair within a component."""
    rng = np.random.default_rng(12)
    base = rng.integers(1, 2**63, 900).astype(np.uint64)
    sets = []
    for k in range(60):
        n = int(rng.integers(40, 900))
        own = np.unique(np.concatenate([base[: n - n // rng.integers(4, 12)], rng.integers(1, 2**63, n // 8).astype(np.uint64)]))
        sets.append(own)
    sets += [np.unique(np.append(sets[k], rng.integers(1, 2**63, 3).astype(np.uint64))) for k in range(0, 60, 2)]
    root = [k if k < 85 else 85 for k in range(len(sets))]
    link = lambda a, b: len(np.intersect1d(a, b)) >= near_copies.SIMILARITY * len(np.union1d(a, b))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if root[i] != root[j] and link(sets[i], sets[j])}
    sketches = [near_copies.sketch(s) for s in sets]
    blocks = pa.table({"size": pa.array([len(s) for s in sets], pa.int32()), "same": pa.array(range(len(sets)), pa.int64()), "root": pa.array(root, pa.int64()), "sketch": sketches})
    got = set(zip(*(c.to_pylist() for c in near_copies._block(blocks).columns)))
    assert want and want <= got and all(root[i] != root[j] for i, j in got) and len(got) < 200  # of 4005
    assert near_copies._block(blocks.slice(0, 0)).num_rows == 0
    # the same through Spark, in blocks of seven
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    members = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(g - 1, len(sets))], "`group` long, same long")
    prints = spark.createDataFrame([(i, len(s), bytearray(k)) for i, (s, k) in enumerate(zip(sets, sketches))], "same long, size int, sketch binary")
    roots = spark.createDataFrame(list(enumerate(root)), "same long, root long")
    assert {(r.a, r.b) for r in near_copies._large(members, prints, roots, 8).collect()} == got
