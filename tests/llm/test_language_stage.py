"""The language ID stage of the pipeline: what it keeps with and without a network."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from voxarbor.llm import langid  # noqa: E402


def test_letters_stay_without_labels(spark):
    rows = [(1, "some words", None), (2, "12345 !!! _", None), (3, None, None), (4, "\u65e5\u672c", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {1, 4}


def test_documents_go_where_the_network_tells_no_language(spark, monkeypatch):
    """A network whose softmax sees one byte only: texts without it are at chance."""
    size = len(langid.WIDTHS) * langid.FILTERS
    embed = np.zeros((256, langid.EMBED))
    embed[ord("q"), 0] = 1.0
    filters = [np.zeros((w * langid.EMBED, langid.FILTERS)) for w in langid.WIDTHS]
    filters[0][0, 0] = 1.0
    out = np.zeros((size, 3))
    out[0, 1] = 4.0
    net = langid.Network(["a", "b", "c"], embed, filters, np.zeros(size), out, np.zeros(3))
    monkeypatch.setattr(corpus_pipeline.langid, "fit", lambda docs: net)
    rows = [(1, "an even chance"), (2, "a q in it"), (3, None), (4, ""), (5, "12 ?"), (6, "x" * 300 + "q" * 400), (None, "quiet"), (2, "a q in it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = corpus_pipeline.language_id(spark, docs, "").collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 2, 2, 6] and {r.score for r in got} == {"mine"}


def test_one_language_is_certain(spark):
    docs = spark.createDataFrame([(i, f"words of text {i}", "en") for i in range(12)] + [(99, "...", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == set(range(12))
