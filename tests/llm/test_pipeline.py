"""The corpus pipeline stage by stage on a small corpus with planted copies and passages."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tests.llm.test_queries import make_docs  # noqa: E402


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_stages(spark, tmp_path):
    rows = make_docs() + [(None, "a row without an id keeps its place", "en", "src0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'z' AS kept", "2 AS score")
    names, kept, texts = docs.columns, {}, {r[0]: r[1] for r in rows}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        kept[name] = docs.collect()
    first = {r.doc_id for r in kept["language_id"]}
    assert first == set(texts) - {116, 117, 118, 119}
    second = {r.doc_id for r in kept["near_duplicates"]}
    assert not second & set(range(100, 112)) and {4, 120, 121, None} <= second
    for a in second - {None}:  # no exact copies stay
        assert not any(a != b and texts[a] == texts[b] for b in second - {None})
    third = {r.doc_id: r.text for r in kept["repeated_passages"]}
    passage = " ".join(texts[90].split()[15:60])
    assert sum(passage in t for t in third.values()) == 1
    assert third[122] == texts[122]
    last = kept["encode"]
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
    assert len(last) == len(kept["mixture"])


def test_run(spark, tmp_path):
    spark.createDataFrame(make_docs(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and out.count() > 0
