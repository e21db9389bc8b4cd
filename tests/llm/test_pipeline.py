import re

import corpus_pipeline
import numpy as np

from tests.llm.test_dedup import _brute_kept, _edited
from tests.llm.test_texts import _check_packing
from weftgraph.llm import packing

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _grams(text, n=10):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set(), w


def test_pipeline_stages(spark, sf_dir, tmp_path, monkeypatch):
    """run() over a small fixture; what each stage makes of its input, against brute force (of the learned stage only that rows go whole)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(600)]
    group = [" ".join(x) for x in [base, *(_edited(rng, base, 9) for _ in range(100))]]
    near = [(10**9 + i, t, "en", "a", len(t)) for i, t in enumerate(group[k] for k in rng.permutation(len(group)).tolist())]
    docs.unionByName(spark.createDataFrame(near, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    seen = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            out = corpus_pipeline.written(stage(spark, docs, sf_dir))
            seen[name] = docs.collect(), out.collect()
            return out

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(n, s)) for n, s in corpus_pipeline.STAGES])
    corpus_pipeline.run(spark, str(tmp_path))

    before, after = seen["toxicity"]
    assert set(after) <= set(before) and 0 < len(after) < len(before)
    before, after = seen["simhash near-dedup"]
    assert sum(r.doc_id >= 10**9 for r in before) > 50
    assert sorted(r.doc_id for r in after) == _brute_kept([(r.doc_id, r.text) for r in sorted(before, key=lambda r: r.doc_id)])
    before, after = seen["decontamination"]
    whole, short = set(), []
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        grams, w = _grams(r.text)
        whole |= grams if len(w) >= 10 else set()
        short += [f" {' '.join(w)} "] if 0 < len(w) < 10 else []

    def leaks(text):
        grams, w = _grams(text)
        return bool(grams & whole) or any(s in f" {' '.join(w)} " for s in short)

    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not leaks(r.text))
    before, after = seen["pii"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before) and all(r.n_chars == len(r.text) for r in after if r.text is not None)
    mails = {m for r in before for m in MAIL.findall(r.text or "")}
    assert not mails & {m for r in after for m in MAIL.findall(r.text or "")}
    before, after = seen["packing"]
    for d in before:
        own = sorted((r for r in after if r.doc_id == d.doc_id), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.cuts(len(packing.encode(d.text)))
    _check_packing(after, [(r.doc_id, r.text) for r in before])
