"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments that are read as words of the perfect
binary Golay code [23, 12, 7] (shorter ones padded with zeros).  The codewords nearest to
a word and to its one-bit neighbours (1 or 6 of them) give it 12-bit indices; words at
distance 2 or less always share one, as the word between them decodes to it.  Errors are
pigeonholed over the segments:

* up to 2 bits: one segment is free of errors and another has 2 at most, so a key is one
  exact segment with one index of another;
* up to 5 bits: two segments have 2 errors at most, so a key is one index of each.

Distinct fingerprints that share a key are compared exactly.  A key shared by more than
GROUP_ROWS fingerprints is compared in pairs of blocks, by separate tasks, so no group
grows with the data and no link is lost.  Within a block only a spanning forest of the
links is emitted, which keeps components and avoids all pairs.

Cases: texts without a word have fingerprint zero and link like any other; rows without
id are fingerprinted but link nothing; copies share one fingerprint and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces, worker_state
from .components import components

SEED = 42
#: Low bit and width of each segment of a 64-bit fingerprint.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
GROUP_ROWS = 20_000
#: Coarse buckets in which keys are counted first.
COARSE = 1 << 16
#: Generator of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bit = [_remainder(1 << i) for i in range(23)]
    low, high = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 11, dtype=np.int64)
    for i in range(12):
        low[np.arange(1 << 12) >> i & 1 == 1] ^= bit[i]
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= bit[12 + i]
    error = np.zeros(1 << 11, dtype=np.int64)
    for a in range(23):
        error[bit[a]] = 1 << a
        for b in range(a):
            error[bit[a] ^ bit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[bit[a] ^ bit[b] ^ bit[c]] = 1 << a | 1 << b | 1 << c
    return low, high, error


_LOW, _HIGH, _ERROR = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the codeword nearest to each 23-bit word."""
    syndrome = _LOW[words & 0xFFF] ^ _HIGH[words >> 12]
    return (words ^ _ERROR[syndrome]) >> 11


def indices(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of words (n x 1+width, ascending) and a mask of those that aren't repeats."""
    flips = np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])
    found = np.sort(decode(words[:, None] ^ flips[None]), axis=1)
    fresh = np.ones_like(found, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, fresh


def keys_of(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of the fingerprints (uint64), for links of up to `bits`."""
    if bits > 5:
        bits = 5
    segment = [((prints >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in SEGMENTS]
    found = [indices(s, w) for s, (_, w) in zip(segment, SEGMENTS, strict=True)]
    rows, keys = [], []
    if bits <= 2:
        for kind, (exact, fuzzy) in enumerate(((0, 1), (1, 0), (2, 0))):
            k, fresh = found[fuzzy]
            r, c = np.nonzero(fresh)
            rows.append(r)
            keys.append(kind << 40 | segment[exact][r] << 12 | k[r, c])
    else:
        for kind, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            both = found[a][1][:, :, None] & found[b][1][:, None, :]
            r, i, j = np.nonzero(both)
            rows.append(r)
            keys.append(kind << 40 | found[a][0][r, i] << 12 | found[b][0][r, j])
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(raw: bytes, k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every k-word shingle (repeats included) of the lower-cased bytes."""
    words = raw.lower().split()  # lower() and split() of bytes know ASCII only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = memoryview(b" ".join(words))
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-k]]).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=len(stops))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it set; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    sums = np.zeros(64, dtype=np.int64)
    for s in range(0, n, 255):
        sums += np.add.reduce(bits[s : s + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def remix(h: np.ndarray) -> np.ndarray:
    """A second hash of each shingle, made of the first (splitmix64's finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, k: int, prints: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and fp0, fp1, ...: 64-bit fingerprints (as signed longs) of each whole text."""
    schema = docs.select(key).schema
    for i in range(prints):
        schema = schema.add(f"fp{i}", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        for batch in batches:
            for part in pieces(batch, text):
                out = []
                for t in part.column(text).to_pylist():
                    h = shingle_hashes((t or "").encode("utf-8", "surrogatepass"), k)
                    row = [fingerprint(h)]
                    for _ in range(1, prints):
                        h = remix(h)
                        row.append(fingerprint(h))
                    out.append(row)
                cols = np.array(out, dtype=np.uint64).reshape(-1, prints).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(cols[:, i]) for i in range(prints))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def _forest(p: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among one run, from its first on."""
    left, out = np.arange(len(p)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(p[left] ^ p[x]) <= bits
            if near.any():
                hit = left[near]
                out.append((np.full(len(hit), x), hit))
                queue.extend(hit.tolist())
                left = left[~near]
    return out


def _run_edges(keys, ids, p, bits: int):
    """A spanning forest of the links inside each run of equal keys (arrays sorted by key),
    as arrays of ids."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
    size = stop - start
    two = start[size == 2]
    two = two[np.bitwise_count(p[two] ^ p[two + 1]) <= bits]
    us, vs = [ids[two]], [ids[two + 1]]
    for a, b in zip(start[size > 2].tolist(), stop[size > 2].tolist(), strict=True):
        for x, y in _forest(p[a:b], bits):
            us.append(ids[a + x])
            vs.append(ids[a + y])
    return np.concatenate(us), np.concatenate(vs)


def links(nodes: DataFrame, bits: int) -> DataFrame:
    """Edges (u, v) among nodes (id long, fp long), distinct fingerprints of which differ in
    `bits` bits or fewer: a spanning forest of the links, complete up to 5 bits."""
    columns = ["key", "id", "fp"]
    schema = ", ".join(f"{c} long" for c in columns)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns[1:]]
            for s in range(0, batch.num_rows, 256):
                r, k = keys_of(cols[1][s : s + 256].view(np.uint64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(k), *(pa.array(c[s : s + 256][r]) for c in cols)], names=columns)

    keyed = nodes.where(F.col("id").isNotNull()).select(*columns[1:]).mapInArrow(expand, schema)
    # A key with many rows lies in a coarse bucket with many rows: count these first (few
    # counts a task), and keys only where a bucket leaves room for a large one.
    coarse = F.pmod(F.xxhash64("key"), F.lit(COARSE)).alias("_c")
    full = keyed.groupBy(coarse).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_ROWS).select("_c")
    sizes = keyed.withColumn("_c", coarse).join(F.broadcast(full), "_c", "left_semi")
    sizes = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS)
    hot = sizes.select("key", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("m"))
    mine = F.pmod(F.xxhash64("id"), F.col("m")).cast("int")
    block = F.expr("explode(CASE WHEN m IS NULL THEN array(-1) ELSE sequence(0, m - 1) END)")
    rows = keyed.join(hot, "key", "left").withColumn("mine", mine).withColumn("other", block)
    rows = rows.select(
        F.when(F.col("m").isNull(), F.col("key"))
        .otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("key"), *columns[1:])
    ordered = rows.repartition("key").sortWithinPartitions("key", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def emit(cols) -> pa.RecordBatch:
            u, v = _run_edges(cols[0], cols[1], cols[2].view(np.uint64), bits)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last == 0 and held and held[-1][0][-1] == cols[0][0]:
                held.append(cols)  # the run goes on through the whole batch
                continue
            held.append([c[:last] for c in cols])
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            if len(whole[0]):
                yield emit(whole)
            held = [[c[last:] for c in cols]]
        if held:
            yield emit([np.concatenate(c) for c in zip(*held, strict=True)])

    return ordered.mapInArrow(compare, "u long, v long")


def simhash_components(docs: DataFrame, k: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest linked doc_id)."""
    prints = materialise(fingerprints(docs, k).withColumnRenamed("fp0", "fp"))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("id"))
    found = components(links(nodes, bits))
    named = nodes.join(found, nodes.id == found.node, "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
