"""A training-data pipeline over `documents`: language ID, near-duplicate removal, removal
of repeated passages, mixing and encoding.  Each stage gets what its predecessor kept, as
Parquet; all but the last return the columns of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxarbor.llm import langid, mixing, sentencepiece_fst, substring
from voxarbor.llm import near_duplicates as near
from voxarbor.llm.common import materialise, maybe_among, table, tune


#: How far from chance toward certainty the network's score must be for a document to be of a
#: language: with n languages, 1/n + LEAST_MARGIN * (1 - 1/n); with four, 0.2875.  The smallest
#: score measured is 0.436 among the documents of sf0.1, 0.341 and 0.333 among the different
#: texts of up to 3,000 characters of check_s and check_h: it keeps them all.
LEAST_MARGIN = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a language.  Those without text or without a letter go, and those
    whose score says that the network tells no language from another."""
    tune(spark)
    net = langid.fit(docs)
    if net is None:  # no labelled row: no language is known, but a letter still is
        return docs.where(F.col("text").rlike(r"[\p{L}\p{Nl}\p{No}]"))
    labelled = langid.identify(docs.withColumnsRenamed({"lang_pred": "lang_pred_", "score": "score_"}), net)
    chance = 1 / len(net.labels)
    told = F.col("score") >= chance + LEAST_MARGIN * (1 - chance) - 1e-9
    kept = labelled.where((F.col("lang_pred") != langid.UNDETERMINED) & told).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"lang_pred_": "lang_pred", "score_": "score"})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact or near copies (five-word shingles, Jaccard 0.8) the document
    of the smallest id stays, equal rows of one id once; rows without id all stay."""
    tune(spark)
    groups = materialise(near.near_duplicates(docs, k=5, similarity=0.8))
    gone = materialise(groups.where("doc_id <> group").select(F.col("doc_id").alias("_gone")))
    marked = maybe_among(docs, gone, "doc_id", "_gone")
    checked = marked.where("_maybe").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    kept = marked.where("NOT _maybe").unionByName(checked).select(*docs.columns)
    again = groups.where("doc_id = group AND rows > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return kept
    marked = maybe_among(kept, again, "doc_id", "_again")
    once = marked.where("_maybe").join(again, F.col("doc_id") == F.col("_again"), "left")
    once = once.where("_again IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(once.where("_again IS NULL"))
    return marked.where("NOT _maybe").unionByName(once.drop("_again")).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that started earlier go; a document that lost none keeps its
    text as it is, one that lost all goes."""
    tune(spark)
    names = docs.columns
    cleaned = substring.remove_repeats(docs.select("doc_id", "text", F.struct("*").alias("_row")), 20)
    changed = F.col("n_removed") > 0
    cleaned = cleaned.where((F.col("n_removed") < F.col("n_words")) | ~changed)
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    cols = {c: F.col(f"_row.{c}") for c in names}
    cols["text"] = text
    if "n_chars" in cols:
        cols["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return cleaned.select(*(c.alias(n) for n, c in cols.items()))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times)."""
    tune(spark)
    # Rows that share an id keep a count each; equal rows are one with the sum of theirs.
    row = F.xxhash64(*docs.columns)
    copies = mixing.mix(docs.withColumn("_row", row), carry=["_row"])
    copies = copies.groupBy(F.col("doc_id").alias("_id"), "_row").agg(F.sum("copies").cast("int").alias("_copies"))
    copies = copies.where("_copies > 0").withColumnRenamed("_row", "_of")
    rows = docs.withColumn("_row", row).join(copies, docs.doc_id.eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_of")))
    first = F.row_number().over(Window.partitionBy("_id", "_of").orderBy(F.lit(1)))
    rows = rows.withColumn("_nth", first).where("_nth = 1")
    return rows.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_k")).drop("_k")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, decoded again for a digest."""
    tune(spark)
    return sentencepiece_fst.encode_decode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("encode", encode),
]

#: No stage but the first filter can be said in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
