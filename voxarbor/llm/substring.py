"""Removal of repeated word sequences with suffix automata of reference shards.

A word goes when some window of `window` words that covers it also starts earlier in the
corpus (smaller doc_id, or earlier in the same document).  Broadcasting automata of the
whole corpus has no size bound, so documents travel to the shards instead:

1. Every window has an anchor: the smallest hash among its K-word grams, which equal
   windows share.  Anchors seen once are dropped; the others name a reference shard, the
   home of the first text that has them (a frequent anchor is a shard of its own, a very
   frequent one several: its windows are dealt by their own hash).
2. A document's runs of windows with the same home go to that shard, where all equal
   windows meet.
3. A shard streams its runs in corpus order through a suffix automaton of what came
   before.  Matching statistics of `window` words or more mark repeats; only runs with
   new windows are added, so an automaton grows with distinct text, not with copies.

Exact copies of a text are settled by digest before all this, and equal runs in a frequent
shard are reduced to their first by a grouped minimum.

Cases: null or empty text has no words; documents of fewer words than a window keep all;
rows without id keep all and repeat nothing; rows equal in id and text count as one
document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, maybe_among, pieces, worker_state

GRAM = 6
#: Texts that share an anchor beyond this number make it a shard of its own.
FREQUENT = 1000
#: Texts beyond this number make an anchor several shards, by the hash of each window.
SPLIT = 4096
#: Digests of texts that a task remembers; bytes of text laid end to end.
SEEN, PIECE = 300_000, 1_000_000
_BASE = 0x9E3779B97F4A7C15


#: Bytes that end a word.
_BLANK = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            self.up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, self.base, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, pow(self.base, -1, 1 << 64), np.uint64))])
        return self.up, self.down


_BYTES = _Powers(0xD6E8FEB86659FD93)


class _Texts:
    """Words of several texts laid end to end, with the anchor of every window."""

    def __init__(self, texts: list[str | None], window: int):
        self.raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join([*self.raw, b""]), dtype=np.uint8)
        blank = np.concatenate([[True], _BLANK[data]])
        begins, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
        self.begins, self.ends = begins, ends
        offset = np.cumsum([0, *(len(r) + 1 for r in self.raw)])
        self.offset = offset
        self.first = np.searchsorted(begins, offset)
        sizes, n = np.diff(self.first), len(begins)
        if n < window:
            self.windows = np.zeros(0, dtype=np.int64)
            self.doc = self.at = self.windows
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        # the hash of a word is a polynomial in its bytes, from prefix sums over all of them
        up, down = _BYTES.to(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[begins]) * down[begins]
        del sums
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        gram = h[: n - GRAM + 1].copy()
        for t in range(1, GRAM):
            gram += h[t : n - GRAM + 1 + t] * np.uint64(pow(_BASE, t, 1 << 64))
        gram ^= gram >> np.uint64(29)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
        gram ^= gram >> np.uint64(32)
        # leftmost minimum over window-GRAM+1 grams, by doubling
        span, low, at, cover = window - GRAM + 1, gram, np.arange(len(gram)), 1
        while cover < span:
            step = min(cover, span - cover)
            a, b = low[:-step], low[step:]
            take = b < a
            low, at = np.where(take, b, a), np.where(take, at[step:], at[:-step])
            cover += step
        doc = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.arange(n - window + 1)
        inside = doc[starts] == doc[starts + window - 1]
        self.windows, self.doc = starts[inside], doc[starts[inside]]
        self.at, self.hash = at[starts[inside]], low[starts[inside]]

    def words(self, doc: int, start: int, stop: int) -> bytes:
        """Words start to stop (not included) of a text, joined by one space."""
        a, b, at = self.first[doc] + start, self.first[doc] + stop - 1, self.offset[doc]
        return b" ".join(self.raw[doc][self.begins[a] - at : self.ends[b] - at].split())


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(h, t): anchors of each text t (a hash); an anchor at two places of a text also has
    a row with another t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("substring")
        seen = set()
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                t = part.column("t").to_pylist()
                fresh = []
                for i, x in enumerate(t):
                    if x not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(x)
                        fresh.append(i)
                text = part.column("text")
                laid = _Texts([text[i].as_py() for i in fresh], window)
                if not len(laid.windows):
                    continue
                keep = np.concatenate([[True], (laid.at[1:] != laid.at[:-1]) | (laid.doc[1:] != laid.doc[:-1])])
                d, h = laid.doc[keep], laid.hash[keep]
                order = np.lexsort((h, d))
                d, h = d[order], h[order]
                new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
                again = np.flatnonzero(~new)
                again = again[new[again - 1]]  # one is enough
                names = np.array([t[i] for i in fresh], dtype=np.int64)
                rows_h = np.concatenate([h[new], h[again]]).view(np.int64)
                rows_t = np.concatenate([names[d[new]], names[d[again]] ^ 1])
                yield pa.RecordBatch.from_arrays([pa.array(rows_h), pa.array(rows_t)], names=["h", "t"])

    return docs.select("text", "t").mapInArrow(run, "h long, t long")


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """Runs of windows bound for one shard, of documents that carry their repeated anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                laid = _Texts(part.column("text").to_pylist(), window)
                ids, ts = part.column("doc_id").to_pylist(), part.column("t").to_pylist()
                anchors = part.column("anchors")
                out = []
                bounds = np.searchsorted(laid.doc, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    known = anchors[i].values
                    if a == b or not len(known):
                        continue
                    h = known.field("h").to_numpy(zero_copy_only=False)
                    order = np.argsort(h)
                    h, key, shards = h[order], known.field("key").to_numpy(zero_copy_only=False)[order], known.field("shards").to_numpy(zero_copy_only=False)[order]
                    mine = laid.hash[a:b].view(np.int64)
                    where = np.minimum(np.searchsorted(h, mine), len(h) - 1)
                    hit = h[where] == mine
                    k = key[where]
                    cut = np.flatnonzero((k[1:] != k[:-1]) | (hit[1:] != hit[:-1])) + 1
                    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), b - a], strict=True):
                        if not hit[s]:
                            continue
                        start = int(laid.windows[a + s] - laid.first[i])
                        stop = int(laid.windows[a + e - 1] - laid.first[i]) + window
                        words, parts = laid.words(i, start, stop), int(shards[where[s]])
                        if parts <= 1:
                            out.append((int(k[s]), parts > 0, ids[i], ts[i], start, words))
                            continue
                        words = words.split(b" ")
                        for at in range(len(words) - window + 1):
                            one = b" ".join(words[at : at + window])
                            mixed = xxhash.xxh64_intdigest(f"{k[s]} {xxhash.xxh64_intdigest(one) % parts}")
                            out.append((mixed - (1 << 63), True, ids[i], ts[i], start + at, one))
                if out:
                    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    cols = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "hot", "doc_id", "t", "start", "words"])

    return docs.mapInArrow(run, "key long, hot boolean, doc_id long, t long, start int, words binary")


class SuffixAutomaton:
    """Of the sequences added so far; knows how long a suffix occurred before."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, last: int, word) -> int:
        """State after `last` and `word`; new unless that sequence is there already."""
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(word)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[cur] = q if length[p] + 1 == length[q] else self._split(p, word, q)
        return cur

    def _split(self, p: int, word, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(length)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        link[q] = clone
        return clone

    def statistics(self, words: list) -> list[int]:
        """For each position the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        s = n = 0
        out = []
        for w in words:
            t = nxt[s].get(w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nxt[s].get(w)
            if t is not None:
                s, n = t, n + 1
            out.append(n)
        return out

    def add(self, words: list, window: int) -> list[int]:
        """Append a sequence; ends of its windows that were there before (or came earlier in it)."""
        last, ends = 0, []
        for e, w in enumerate(words):
            states = len(self.length)
            last = self.extend(last, w)
            if e + 1 >= window:
                # a state that was there already has occurred in full, a new one down to its link
                known = self.length[last] if last < states else self.length[self.link[last]]
                if known >= window:
                    ends.append(e)
        return ends


class Shard:
    """Reference shard: runs come in corpus order, ranges of repeated words go out."""

    def __init__(self, window: int):
        self.window, self.automaton, self.seen = window, SuffixAutomaton(), set()

    def repeated(self, raw: bytes) -> list[tuple[int, int]]:
        """Word ranges [a, b) of this run that windows seen before cover."""
        words, k = raw.split(b" "), self.window
        if raw in self.seen:
            return [(0, len(words))]
        self.seen.add(raw)
        found = self.automaton.statistics(words)
        ends = [e for e in range(k - 1, len(words)) if found[e] >= k]
        fresh = [e for e in range(k - 1, len(words)) if found[e] < k]
        for i, e in enumerate(fresh):  # maximal stretches of new windows are added
            if i and fresh[i - 1] == e - 1:
                continue
            stop = i
            while stop + 1 < len(fresh) and fresh[stop + 1] == fresh[stop] + 1:
                stop += 1
            a = e - k + 1
            ends += [a + x for x in self.automaton.add(words[a : fresh[stop] + 1], k)]
        out: list[tuple[int, int]] = []
        for e in sorted(ends):
            a, b = e - k + 1, e + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out


def _judge(runs: DataFrame, window: int) -> DataFrame:
    """Ranges (doc_id, t, a, b) of repeated words, from runs sorted within their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, last = None, None, None
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("key", "doc_id", "t", "start", "words")]
            for k, d, t, s, raw in zip(*cols, strict=True):
                if k != key or shard is None:
                    key, shard, last = k, Shard(window), None
                if (d, t, s) == last:
                    continue  # the same document again
                last = (d, t, s)
                out += [(d, t, s + a, s + b) for a, b in shard.repeated(raw)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "t", "a", "b"])

    placed = runs.repartition("key").sortWithinPartitions("key", "doc_id", "t", "start")
    return placed.mapInArrow(run, "doc_id long, t long, a int, b int")


def repeated_ranges(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, t, ranges, copy): of each document that loses words, the repeated word ranges,
    or copy = true where the whole text came earlier.  t is xxhash64(text)."""
    base = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    base = base.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    ids = materialise(base.select("doc_id", "t", F.unhex(F.sha2("text", 256)).alias("d")))
    firsts = materialise(ids.groupBy("d").agg(F.min("doc_id").alias("id")))  # as below
    copies = ids.join(firsts, "d").where("doc_id > id").select("doc_id", "t").distinct()
    anchors = _anchors(base, window)
    shared = anchors.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    hot = F.col("n") > FREQUENT
    # Written out, so that the join below is one of two plain exchanges and Spark can split
    # the rows of a frequent anchor among tasks.
    # 0: a shard shared with other anchors, 1: one of its own, more: SPLIT windows or so in each
    many = F.when(F.col("n") > SPLIT, F.ceil(F.col("n") * (window - GRAM + 1) / SPLIT)).otherwise(1)
    shards = F.when(hot, many).otherwise(0).cast("int")
    shared = materialise(shared.select("h", F.when(hot, F.col("h")).otherwise(F.col("lo")).alias("key"), shards.alias("shards")))
    by_text = anchors.join(shared, "h").groupBy("t").agg(F.collect_set(F.struct("h", "key", "shards")).alias("anchors"))
    reps = ids.groupBy("t").agg(F.min("doc_id").alias("doc_id"))
    wanted = materialise(by_text.join(reps, "t"))
    near = maybe_among(base, wanted, "doc_id", "doc_id").where("_maybe")
    runs = materialise(_runs(near.join(wanted, ["doc_id", "t"]).select("doc_id", "t", "text", "anchors"), window))
    place = F.struct("doc_id", "t", "start")
    frequent = runs.where("hot").groupBy("key", "words").agg(F.min(place).alias("f"))
    first = frequent.select("key", "f.*", "words")
    ranges = _judge(runs.where("NOT hot").select("key", "doc_id", "t", "start", "words").unionByName(first), window)
    where = frequent.select(F.col("key"), F.xxhash64("words").alias("w"), F.octet_length("words").alias("l"), "f")
    n_words = F.size(F.split(F.col("words").cast("string"), " "))
    others = runs.where("hot").select("key", F.xxhash64("words").alias("w"), F.octet_length("words").alias("l"), place.alias("p"), n_words.alias("n"))
    others = others.join(where, ["key", "w", "l"]).where("p <> f").select("p.doc_id", "p.t", F.col("p.start").alias("a"), (F.col("p.start") + F.col("n")).alias("b"))
    ranges = ranges.unionByName(others).groupBy("doc_id", "t").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    return ranges.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "t"], "full").select(
        "doc_id", "t", "ranges", F.coalesce("copy", F.lit(False)).alias("copy"))


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs with n_words, n_removed, kept (the remaining words joined by one space) and
    kept_sha256 added; a clashing column of that name is replaced."""
    added = ["n_words", "n_removed", "kept", "kept_sha256"]
    docs = docs.drop(*added)
    found = materialise(repeated_ranges(docs, window)).withColumnsRenamed({"doc_id": "_id", "t": "_t", "ranges": "_ranges", "copy": "_copy"})
    names = docs.columns
    on = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_t"))
    marked = maybe_among(docs, found, "doc_id", "_id")
    same = marked.where("NOT _maybe").withColumns({"_ranges": F.lit(None).cast(found.schema["_ranges"].dataType), "_copy": F.lit(None).cast("boolean")})
    joined = marked.where("_maybe").join(found, on, "left").drop("_id", "_t").unionByName(same)
    schema = docs.select("*").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                out = []
                for text, ranges, copy in zip(part.column("text").to_pylist(), part.column("_ranges").to_pylist(), part.column("_copy").to_pylist(), strict=True):
                    words = [] if text is None else text.encode("utf-8", "surrogatepass").split()
                    keep = words
                    if copy and len(words) >= window:
                        keep = []
                    elif ranges:
                        gone, at, keep = sorted((r["a"], r["b"]) for r in ranges), 0, []
                        for a, b in gone:
                            if a > at:
                                keep += words[at:a]
                            at = max(at, b)
                        keep += words[at:]
                    kept = b" ".join(keep)
                    out.append((len(words), len(words) - len(keep), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*names, *added])

    return joined.select(*names, "_ranges", "_copy").mapInArrow(run, schema)
