"""Groups of near duplicates: SimHash candidates through Golay keys, verified exactly.

1.  Copies of a text are found by digest; one id stands for them from then on.
2.  A text that shares hardly any of its shingles with another text has no near duplicate.
    A sketch of the shingles (those whose hash is 0 modulo SKETCH) tells: a text whose shared
    part of the sketch lies four standard deviations below the similarity wanted goes no
    further.  Texts with less than SKETCH_LEAST shingles in the sketch always do.
3.  Each remaining text gets PRINTS independent 64-bit fingerprints; their Golay keys for 5
    bits (see simhash.py) say who is compared with whom.
4.  Rounds: every text proposes its nearest neighbour (differing bits over all prints, then
    id) that is not in its group yet and not refused before; proposed pairs are verified on
    whole shingle sets; groups that a verified pair joins become one.  A round holds one
    proposal a text, never the pairs of a family.  A text without a proposal is closed.
5.  After two rounds each open text carries the number of its shingles that occur in another
    group's open text.  No pair can share more than the smaller of its two numbers, so pairs
    that this bound excludes are never proposed again.  The bound is exact.
6.  What still has proposals is joined to families, again by nearest proposals alone, until no
    text proposes one of another family.  A family's texts meet in pairs of blocks of
    BLOCK_TEXTS, which compare the texts of different groups exactly; links leave the task,
    pairs do not.  Most families are one group by then and take no part.

A key with more than GROUP_ROWS texts is cut into blocks.  The first round compares inside
blocks only and joins most of them; later rounds compare all pairs of blocks of the keys whose
texts are not yet all of one group.

Recall: a pair is found if it shares a key in one of the prints and differs in PRINT_BITS bits
a print at most.  Two prints that differ in 5 bits or fewer always share a key; beyond that it
is likely, not certain.  tests/llm measures it against brute force.

Cases: the document id is a document's identity, so rows that share an id are one document and
link all their texts; null text is a text of its own, equal to other nulls; texts without a
word have only exact copies; rows without id are in no group; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, maybe_among, pieces, release, worker_state
from .components import components
from .simhash import SEGMENTS, fingerprint, indices, keys_of, remix, shingle_hashes

#: Independent fingerprints of a text, bits of each that a pair may differ in on average.
PRINTS, PRINT_BITS = 3, 16
#: One shingle in SKETCH is in the sketch; texts with fewer than SKETCH_LEAST there pass.
SKETCH, SKETCH_LEAST = 8, 6
#: Rows of whole runs that are compared together, at least.
HELD_ROWS = 1 << 14
#: Texts of one key that one task compares.
GROUP_ROWS = 20_000
#: Coarse buckets in which keys are counted first.
COARSE = 1 << 16
#: Runs up to this length are compared side by side in one array operation.
SHORT_RUN = 48
#: Cells of a distance matrix held at once.
CELLS = 1 << 21
#: A distance beyond any of two texts.
FAR = 1 << 14
#: Rounds in which proposals are verified one by one; what is open then meets in families.
VERIFIED_ROUNDS = 2
#: Texts of a family in one block.
BLOCK_TEXTS = 256


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, digest of the text, number of distinct shingles, sketch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near_duplicates")
        for batch in batches:
            for part in pieces(batch, "text"):
                d, n, s = [], [], []
                for t in part.column("text").to_pylist():
                    h = np.unique(shingle_hashes(_encode(t), k))
                    d.append(b"" if t is None else hashlib.sha256(_encode(t)).digest()[:16])
                    n.append(len(h))
                    s.append(h[h % np.uint64(SKETCH) == 0].tobytes())
                cols = [part.column("doc_id"), pa.array(d, pa.binary()), pa.array(n, pa.int64()), pa.array(s, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "d", "size", "sketch"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, d binary, size long, sketch binary")


def _explode(rows: DataFrame, hashes: str, *keep: str) -> DataFrame:
    """One row (keep..., h) for each 64-bit hash in a binary column; keep are longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(b, dtype=np.int64) for b in batch.column(hashes).to_pylist()]
            for a in range(0, len(held), 32):
                some = held[a : a + 32]
                n = [len(x) for x in some]
                cols = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False)[a : a + 32], n) for c in keep]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.concatenate(some))], names=[*keep, "h"])

    return rows.select(*keep, hashes).mapInArrow(run, ", ".join(f"{c} long" for c in (*keep, "h")))


def _sharing(texts: DataFrame, similarity: float) -> DataFrame:
    """The ids of texts (id, size, sketch) that may have a near duplicate."""
    parts = _explode(texts, "sketch", "id")
    shared = parts.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("h")
    counts = parts.join(shared, "h", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    n = (F.octet_length("sketch") / 8).cast("double")
    least = similarity * n - 4 * F.sqrt(n * similarity * (1 - similarity))
    rows = texts.where("size > 0").join(counts, "id", "left")
    return rows.where((n < SKETCH_LEAST) | (F.coalesce("c", F.lit(0)) > least)).select("id")


def _prints(docs: DataFrame, k: int) -> DataFrame:
    """id, size, its fingerprints f0, f1, ... and its sorted distinct shingles s."""
    names = ["id", "size", *(f"f{i}" for i in range(PRINTS)), "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near_duplicates")
        for batch in batches:
            for part in pieces(batch, "text"):
                out, sets = [], []
                for t in part.column("text").to_pylist():
                    h = np.unique(shingle_hashes(_encode(t), k))
                    sets.append(h.tobytes())
                    row = []
                    for i in range(PRINTS):
                        h = remix(h) if i else h
                        row.append(fingerprint(h))
                    out.append(row)
                cols = np.array(out, dtype=np.uint64).reshape(-1, PRINTS).view(np.int64)
                size = np.array([len(s) // 8 for s in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size), *(pa.array(cols[:, i]) for i in range(PRINTS)), pa.array(sets, pa.binary())], names=names)

    schema = ", ".join([*(f"{c} long" for c in names[:-1]), "s binary"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def smallest_common_key(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The first key, in (print, kind, key) order, that each row's two texts share; their
    fingerprints come as one array (uint64) per print.  -1: they share none."""
    out = np.full(len(x[0]), -1, dtype=np.int64)
    for p, (a, b) in enumerate(zip(x, y, strict=True)):
        common = []
        for at, w in SEGMENTS:
            i, j = [indices((v >> np.uint64(at) & np.uint64((1 << w) - 1)).astype(np.int64), w)[0] for v in (a, b)]
            both = (i[:, :, None] == j[:, None, :]).any(axis=2)
            common.append(np.where(both.any(axis=1), i[np.arange(len(i)), both.argmax(axis=1)], -1))
        for kind, (s, t) in enumerate(((0, 1), (0, 2), (1, 2))):
            new = (out < 0) & (common[s] >= 0) & (common[t] >= 0)
            out[new] = (p << 44 | kind << 40) | common[s][new] << 12 | common[t][new]
    return out


class _Rows:
    """The rows of whole runs, sorted by key and id, as arrays."""

    def __init__(self, cols: dict[str, np.ndarray], similarity: float):
        self.key, self.id, self.size, self.shared, self.root, self.cd, self.cv = (
            cols[c] for c in ("key", "id", "size", "shared", "root", "cd", "cv"))
        self.f = [cols[f"f{i}"].view(np.uint64) for i in range(PRINTS)]
        self.similarity = similarity

    def distance(self, x, y) -> np.ndarray:
        return sum(np.bitwise_count(f[x] ^ f[y]).astype(np.int16) for f in self.f)

    def possible(self, x, y, d) -> np.ndarray:
        """Near, of different groups, and neither sizes nor shared shingles rule it out."""
        need = self.similarity / (1 + self.similarity) * (self.size[x] + self.size[y])
        return (d <= PRINTS * PRINT_BITS) & (self.root[x] != self.root[y]) & (np.minimum(self.shared[x], self.shared[y]) >= need - 1e-6)

    def fresh(self, x, y, d) -> np.ndarray:
        """y comes after the last neighbour that x proposed."""
        return (d > self.cd[x]) | ((d == self.cd[x]) & (self.id[y] > self.cv[x]))


def _short(r: _Rows, run: np.ndarray) -> list[tuple]:
    """(x, y, distance) of all proposals in short runs; run: number of each row's run, -1 for
    rows that are in none."""
    out = []
    for o in range(1, SHORT_RUN):
        x = np.flatnonzero((run[:-o] == run[o:]) & (run[o:] >= 0)) if o < len(run) else np.zeros(0, int)
        if not len(x):
            break
        y = x + o
        d = r.distance(x, y)
        ok = r.possible(x, y, d)
        x, y, d = x[ok], y[ok], d[ok]
        for a, b in ((x, y), (y, x)):
            new = r.fresh(a, b, d)
            out.append((a[new], b[new], d[new]))
    return out


def _long(r: _Rows, a: int, b: int) -> Iterator[tuple]:
    """The nearest proposal of each row of one long run."""
    all_ = np.arange(a, b)
    step = max(1, CELLS // (b - a))
    for s in range(a, b, step):
        x = np.arange(s, min(s + step, b))
        d = r.distance(x[:, None], all_[None])
        ok = r.possible(x[:, None], all_[None], d) & r.fresh(x[:, None], all_[None], d)
        d = np.where(ok, d, FAR)
        near = d.argmin(axis=1)  # rows are in id order: the first is the smallest id
        d = d[np.arange(len(x)), near]
        some = d < FAR
        yield x[some], a + near[some], d[some]


def _nearest(r: _Rows, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest proposal (u, v, d) of each id, from the first key its pair shares; a
    proposal that is dropped here is made where that key is."""
    x, y, d = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    order = np.lexsort((r.id[y], d, x))  # one for each row first: its run holds no nearer one
    x, y, d = x[order], y[order], d[order]
    if len(x):
        first = np.concatenate([[True], x[1:] != x[:-1]])
        x, y, d = x[first], y[first], d[first]
    keep = [np.zeros(0, bool)]
    for s in range(0, len(x), 4096):
        i, j = x[s : s + 4096], y[s : s + 4096]
        keep.append(smallest_common_key([f[i] for f in r.f], [f[j] for f in r.f]) == r.key[i])
    keep = np.concatenate(keep)
    u, v, d = r.id[x[keep]], r.id[y[keep]], d[keep]
    order = np.lexsort((v, d, u))
    u, v, d = u[order], v[order], d[order]
    if len(u):
        first = np.concatenate([[True], u[1:] != u[:-1]])
        u, v, d = u[first], v[first], d[first]
    return u, v, d.astype(np.int64)


def _propose(nodes: DataFrame, similarity: float, across: bool) -> tuple[DataFrame, bool]:
    """((u, v, d): the nearest proposal of each node, whether any key is too large for one
    task).  Nodes have id, size, f0.., shared, root and cd, cv, the last proposal.  Without
    `across` the blocks of a large key are not compared with each other."""
    names = ["id", "size", *(f"f{i}" for i in range(PRINTS)), "shared", "root", "cd", "cv"]
    prints = range(names.index("f0"), names.index("f0") + PRINTS)
    columns = ["key", *names]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            for s in range(0, batch.num_rows, 256):
                for p, at in enumerate(prints):
                    r, k = keys_of(cols[at][s : s + 256].view(np.uint64), 5)
                    yield pa.RecordBatch.from_arrays([pa.array(k | p << 44), *(pa.array(c[s : s + 256][r]) for c in cols)], names=columns)

    keyed = nodes.select(*names).mapInArrow(expand, ", ".join(f"{c} long" for c in columns))
    # A key with many rows lies in a coarse bucket with many rows: count these first (few
    # counts a task), and keys only where a bucket leaves room for a large one.
    coarse = F.pmod(F.xxhash64("key"), F.lit(COARSE)).alias("_c")
    full = keyed.groupBy(coarse).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_ROWS).select("_c")
    full = [r._c for r in full.collect()]  # COARSE numbers at most
    rows = keyed.withColumns({"block": F.lit(0), "other": F.lit(0)})
    hot = None
    if full:
        in_full = F.pmod(F.xxhash64("key"), F.lit(COARSE)).isin(full)
        sizes = keyed.where(in_full).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b"))
        hot = materialise(sizes.where(F.col("n") > GROUP_ROWS).select("key", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("m"), (F.col("a") != F.col("b")).alias("mixed")))
        rows = keyed.join(hot, "key", "left").where("m IS NULL OR mixed")
        mine = F.pmod(F.xxhash64("id"), F.col("m")).cast("int")
        others = F.expr("CASE WHEN m IS NULL THEN array(0) ELSE sequence(0, m - 1) END") if across else F.array(F.coalesce(mine, F.lit(0)))
        rows = rows.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("with", F.explode(others))
        rows = rows.withColumns({"block": F.least("mine", "with"), "other": F.greatest("mine", "with")})
    by = ["key", "block", "other"]
    ordered = rows.select(*by, *names).repartition(*by).sortWithinPartitions(*by, "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        worker_state("near_duplicates")

        def emit() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            r = _Rows(dict(zip([*by, *names], cols, strict=True)), similarity)
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)])
            start = np.flatnonzero(new)
            stop = np.concatenate([start[1:], [len(new)]])
            mixed = np.minimum.reduceat(r.root, start) != np.maximum.reduceat(r.root, start)
            short = mixed & (stop - start <= SHORT_RUN)
            run = np.where(np.repeat(short, stop - start), np.repeat(np.arange(len(start)), stop - start), -1)
            found = _short(r, run)
            for a, b in zip(start[mixed & ~short].tolist(), stop[mixed & ~short].tolist(), strict=True):
                found += _long(r, a, b)
            u, v, d = _nearest(r, found)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.int64())], names=["u", "v", "d"])

        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in [*by, *names]])
            if sum(len(h[0]) for h in held) < HELD_ROWS:
                continue
            held = [[np.concatenate(c) for c in zip(*held, strict=True)]]
            end = np.any([c != c[-1] for c in held[0][:3]], axis=0)
            if end.any():  # the last run may go on in the next batch
                at = len(end) - int(np.argmax(end[::-1]))
                rest = [c[at:] for c in held[0]]
                held = [[c[:at] for c in held[0]]]
                yield emit()
                held = [rest]
        if held and sum(len(h[0]) for h in held):
            yield emit()

    found = ordered.mapInArrow(compare, "u long, v long, d long")
    found = materialise(found.groupBy("u").agg(F.min(F.struct("d", "v")).alias("b")).select("u", "b.v", "b.d"))
    if hot is not None:
        release(hot)
    return found, hot is not None


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y) - both
                ok.append(bool(total) and both / total >= similarity)
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u")
    both = both.join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v").select("u", "v", "a", "b")
    return both.mapInArrow(keep, "u long, v long")


def _shared(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, shared): how many shingles of each open text (id, root) occur in an open text of
    another group."""
    parts = materialise(_explode(sets.join(open_, "id"), "s", "id", "root"))
    mixed = parts.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
    out = materialise(parts.join(mixed, "h", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("shared")))
    release(parts)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, group, rows): group is the smallest id among documents linked by exact copy or
    by k-word shingle sets of that Jaccard similarity or more; rows: how often a text of the
    document occurs under its id."""
    rows = materialise(_scan(docs, k))
    texts = rows.groupBy("d").agg(F.min("doc_id").alias("id"), F.max("size").alias("size"), F.max("sketch").alias("sketch"))
    texts = materialise(texts)  # a plain side: Spark can split a hot text's rows in the next join
    copies = rows.groupBy("doc_id", "d").agg(F.count(F.lit(1)).alias("rows"))
    copies = materialise(copies.join(texts.select("d", "id"), "d").select("doc_id", "id", "rows"))
    # a document of several texts links the texts it has
    several = copies.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("doc_id")
    same_id = copies.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    sharing = materialise(_sharing(texts, similarity))
    release(rows, texts)
    some = maybe_among(docs.select("doc_id", "text"), sharing, "doc_id", "id").where("_maybe")
    sets = materialise(_prints(some, k))
    nodes = sets.join(sharing, "id", "left_semi").where("size > 0").drop("s").distinct()
    nodes = materialise(nodes.withColumn("shared", F.col("size")))
    group = materialise(components(same_id))
    release(sharing)

    none = F.lit(-1).cast("long")
    open_, across = nodes.select(F.col("id").alias("u"), none.alias("cd"), none.alias("cv")), False
    for _ in range(VERIFIED_ROUNDS):
        now = materialise(_standing(nodes, group).join(open_.withColumnRenamed("u", "id").distinct(), "id"))
        found, large = _propose(now, similarity, across)
        release(now)
        pairs = found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        new = materialise(_verified(pairs, sets, similarity))
        group = _merged(group, new)
        release(new, open_)
        # blocks of large keys have not met in the first round: then every text stays open
        open_ = found.select("u", F.col("d").alias("cd"), F.col("v").alias("cv")) if across or not large else open_
        open_.written_at, across = found.written_at, True
        if open_.isEmpty():
            break
    else:
        bounds = _shared(_standing(nodes, group).join(open_.select(F.col("u").alias("id")).distinct(), "id").select("id", "root").distinct(), sets)
        rest = _standing(nodes, group).drop("shared").join(bounds, "id").where(F.col("shared") >= similarity * F.col("size"))
        rest = materialise(rest.withColumns({"cd": none, "cv": none, "family": F.col("root")}))
        release(bounds, open_)
        families = _families(rest, similarity)
        new = materialise(_in_families(families, sets, similarity))
        group = _merged(group, new)
        release(new, rest, families)
    release(nodes, sets)
    named = copies.join(group, copies.id == group.node, "left").select("doc_id", F.coalesce("root", "id").alias("group"), "rows")
    return named.groupBy("doc_id").agg(F.min("group").alias("group"), F.max("rows").alias("rows"))


def _standing(nodes: DataFrame, group: DataFrame) -> DataFrame:
    return nodes.join(group.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _families(rest: DataFrame, similarity: float) -> DataFrame:
    """(id, root, family): texts that proposals connect, verified or not, are one family.
    Each round joins every family to the nearest one it may have a link to."""
    named = materialise(rest.select("id", "root", F.col("root").alias("family")).distinct())
    while True:
        now = rest.drop("root", "family").join(named.select("id", F.col("family").alias("root")), "id")
        now = materialise(now)
        found, _ = _propose(now, similarity, True)
        release(now)
        if found.isEmpty():
            release(found)
            break
        ends = found.select("u", "v")
        for c in ("u", "v"):
            ends = ends.join(named.select(F.col("id").alias(c), F.col("family").alias(f"f{c}")).distinct(), c)
        joined = materialise(components(ends.select(F.col("fu").alias("u"), F.col("fv").alias("v"))))
        moved = named.join(joined.select(F.col("node").alias("family"), F.col("root").alias("to")), "family", "left")
        moved = materialise(moved.select("id", "root", F.coalesce("to", "family").alias("family")))
        release(found, joined, named)
        named = moved
    return named


def _in_families(families: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between the groups of each family (id, root, family), exactly: the texts
    of a family meet in pairs of blocks, and only a spanning forest of links leaves a task."""
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b"))
    sizes = sizes.where("a <> b").select("family", F.ceil(F.col("n") / BLOCK_TEXTS).cast("int").alias("m"))
    rows = families.join(sizes, "family").join(sets.select("id", "s"), "id")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("m")).cast("int")).withColumn("with", F.explode(F.expr("sequence(0, m - 1)")))
    rows = rows.select("family", F.least("mine", "with").alias("x"), F.greatest("mine", "with").alias("y"), (F.col("mine") > F.col("with")).alias("second"), "id", "root", "s")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near_duplicates")
        at, held = None, []
        for batch in batches:
            for *key, second, id_, root, s in zip(*(batch.column(c).to_pylist() for c in ("family", "x", "y", "second", "id", "root", "s")), strict=True):
                if key != at and held:
                    yield _links_in(held, similarity)
                    held = []
                at = key
                held.append((second, id_, root, np.frombuffer(s, dtype=np.uint64)))
        if held:
            yield _links_in(held, similarity)

    by = ["family", "x", "y"]
    return rows.repartition(*by).sortWithinPartitions(*by, "id").mapInArrow(compare, "u long, v long")


def _links_in(held: list[tuple], similarity: float) -> pa.RecordBatch:
    """Links among the texts (of the second block, id, root, shingles) of two blocks: one for
    each time a link joins two groups.  Shared shingles are counted through an inverted list."""
    second, ids, roots, sets = zip(*held, strict=True)
    two, size = any(second) and not all(second), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    start = np.cumsum(count) - count
    of = np.split(inverse, np.cumsum(size)[:-1])
    part: dict[int, int] = {}

    def find(r: int) -> int:
        while part.get(r, r) != r:
            part[r] = part.get(part[r], part[r])
            r = part[r]
        return r

    us, vs = [], []
    for x in range(len(sets)):
        lists = [order[start[h] : start[h] + count[h]] for h in of[x] if count[h] > 1]
        if not lists:
            continue
        both = np.bincount(owner[np.concatenate(lists)], minlength=len(sets))
        near = np.flatnonzero(both / np.maximum(1, size[x] + size - both) >= similarity)
        for y in near[near < x].tolist():
            if two and second[x] == second[y]:
                continue  # one block's own pairs meet elsewhere
            a, b = find(roots[x]), find(roots[y])
            if a != b:
                part[max(a, b)] = min(a, b)
                us.append(ids[x])
                vs.append(ids[y])
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _merged(group: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, root) after verified pairs have joined groups."""
    ends = linked.select("u", "v")
    for c in ("u", "v"):
        ends = ends.join(group.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    ends = ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    joined = materialise(components(ends))
    moved = group.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    moved = moved.select("node", F.coalesce("to", "root").alias("root"))
    fresh = joined.join(group.select("node"), "node", "left_anti")
    out = materialise(moved.unionByName(fresh))
    release(group, joined)
    return out
