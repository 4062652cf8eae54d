"""The mixture stage with rows that share an id, or have none."""

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from voxarbor.llm import mixing  # noqa: E402


def test_rows_of_one_id_keep_their_counts(spark):
    rows = [(None, " ".join([f"n{i}"] * (i % 9 + 1)), f"s{i % 3}") for i in range(60)]
    rows += [(i // 3, " ".join([f"d{i}"] * (i % 7 + 1)), f"s{i % 3}") for i in range(90)]
    rows += [(99, "equal row", "s1")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.mixture(spark, docs, "").collect()
    words = Counter()
    for r in got:
        words[r.source] += len(r.text.split())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    assert words == want and {tuple(r) for r in got} <= set(rows)
