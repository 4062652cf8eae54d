"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxarbor.functions.storage import materialise, release, shared_dir  # noqa: F401

#: Rows handed to a Python worker at once; long texts make bigger batches costly.
ARROW_ROWS = "500"


def tune(spark: SparkSession) -> SparkSession:
    """Bound what batches of long texts hold in memory: Arrow batches on both sides of the
    pipe, column batches of the Parquet reader, row groups of the Parquet writer."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    spark.conf.set("parquet.block.size", str(32 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch, column: str, most: int = 2_000_000):
    """Slices of a batch whose texts in `column` hold about `most` bytes (a longer
    single text makes a slice of its own)."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


#: Words (longs) of the bitmaps below: 16 bits an id, 1 MB at least and 8 MB at most.
BITMAP_WORDS = (1 << 17, 1 << 20)


def _bit(key: Column, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    one = F.expr("shiftleft(1L, 0)")
    bit = F.call_function("shiftleft", one, h.bitwiseAND(63).cast("int"))
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(words)), bit


def maybe_among(docs: DataFrame, ids: DataFrame, key: str, id_: str) -> DataFrame:
    """docs with _maybe: false where docs[key] is surely not among ids[id_].

    Long texts should not cross the network to meet a few ids.  The ids are folded into a
    bitmap, which is broadcast; only rows that pass it need an exact join.  Its size follows
    the number of ids up to a bound; beyond some 10**7 ids more rows pass, which changes no
    result."""
    words, most = BITMAP_WORDS
    n = ids.count()
    while words < most and words * 4 < n:
        words *= 2
    word, bit = _bit(F.col(id_), words)
    bitmap = ids.where(F.col(id_).isNotNull()).select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    mine, own = _bit(F.col(key).cast(ids.schema[id_].dataType), words)
    joined = docs.withColumn("_word", mine).join(F.broadcast(bitmap), "_word", "left")
    return joined.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(own) != 0, F.lit(False))).drop("_word", "_bits")


class Memo:
    """What was asked lately: two generations of at most `size` entries each.  What is asked
    again moves to the young one; the old one is forgotten when the young one is full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


_STATE: dict = {}


def worker_state(name: str, shared=None, build=None):
    """What a worker process keeps from task to task, built from a broadcast value.

    Tasks of one operator that follow each other in a process go on with it; the first task
    of another operator drops it, so a process holds one operator's memory at a time."""
    key = (name, id(shared.value) if shared is not None else None)
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = build(shared.value) if build is not None else None
    return _STATE[key]
