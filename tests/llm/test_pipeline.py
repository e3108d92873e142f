"""The pipeline over the smallest tables: what is left satisfies every stage's rule."""

import re

import corpus_pipeline
from inkspark.llm import decontaminate

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF).persist()
        seen.append((name, out.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            kept = out
    assert [n for n, _ in seen] == ["quality rules", "line dedup", "n-gram join", "decontamination", "sentencepiece"]
    sizes = [n for _, n in seen]
    assert docs.count() > sizes[0] == sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert decontaminate.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            assert not sets[a] or 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows.keys() == texts.keys() and all(r["round_trip"] for r in rows.values())
