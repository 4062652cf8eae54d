"""Near-duplicate groups against brute force over all pairs."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from voxarbor.llm import near_duplicates as near  # noqa: E402
from voxarbor.llm.simhash import shingle_hashes  # noqa: E402


def brute_groups(rows, k=5, similarity=0.8):
    """{doc_id: smallest id linked} by all pairs of texts."""
    sets, group = [set(shingle_hashes((t or "").encode(), k).tolist()) for _, t in rows], list(range(len(rows)))

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] == rows[j][1] or rows[i][0] == rows[j][0]
            x, y = sets[i], sets[j]
            if same or (x and min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) / len(x | y) >= similarity):
                a, b = sorted((root(i), root(j)), key=lambda n: rows[n][0])
                group[b] = a
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def family(rng, size, words, edits, first):
    """Versions of one text, each with some words of its own, as planted near copies are."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(size):
        b = list(base)
        for p in rng.sample(range(words), rng.randint(0, edits)):
            b[p] = f"x{rng.randrange(10**9)}"
        out.append((first + i, " ".join(b)))
    return out


def test_recall_against_all_pairs(spark):
    """300 texts in families around the threshold, and 800 of one template (versions 0.78 from
    each other, a copy of each at 0.82): groups are never coarser than those of all pairs, and
    at least 0.99 of the documents that should go do."""
    rng, rows = random.Random(11), []
    for f in range(20):
        rows += family(rng, 15, rng.choice((40, 90, 200, 400)), rng.choice((1, 3, 6)), 1000 * f)
    base = [f"w{rng.randrange(10**6)}" for _ in range(84)]
    for i in range(400):
        b = list(base)
        b[5 + i % 60] = f"x{i}"
        rows.append((50_000 + i, " ".join(b)))
        b[73], b[76] = f"y{i}", f"z{i}"
        rows.append((60_000 + i, " ".join(b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group for r in near.near_duplicates(docs).collect()}
    want = brute_groups(rows)
    assert all(want[i] == want[g] for i, g in got.items())
    for few, many in ((0, 50_000), (50_000, 70_000)):
        gone = [i for i, g in want.items() if i != g and few <= i < many]
        assert len(gone) > 100
        assert sum(got[i] != i for i in gone) >= 0.99 * len(gone)


def test_blocks_of_a_large_key(spark, monkeypatch):
    """Keys cut into blocks of a few texts lose no group."""
    rng, rows = random.Random(3), []
    for f in range(2):
        rows += family(rng, 60, 120, 4, 1000 * f)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near, "GROUP_ROWS", 16)
    monkeypatch.setattr(near, "SHORT_RUN", 4)
    cut = {r.doc_id: r.group for r in near.near_duplicates(docs).collect()}
    want = brute_groups(rows)
    assert all(want[i] == want[g] for i, g in cut.items())
    gone = [i for i, g in want.items() if i != g]
    assert len(gone) > 50 and sum(cut[i] != i for i in gone) >= 0.99 * len(gone)


def test_awkward_rows(spark):
    rng = random.Random(7)
    long_ = " ".join(f"l{rng.randrange(10**6)}" for _ in range(30_000))
    rows = [
        (1, "same text here"), (2, "same text here"), (2, "same text here"), (3, None), (4, None), (5, ""), (6, " \n"),
        (7, long_), (8, long_ + " tail"), (None, "same text here"), (9, "another thing"), (9, "same text here"), (10, "another thing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS root", "'x' AS d")
    got = {r.doc_id: (r.group, r.rows) for r in near.near_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (3, 1), 4: (3, 1), 5: (5, 1), 6: (6, 1), 7: (7, 1), 8: (7, 1), 9: (1, 1), 10: (1, 1)}
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_smallest_common_key():
    rng = np.random.default_rng(1)
    x = [rng.integers(0, 1 << 63, 50, dtype=np.uint64) for _ in range(near.PRINTS)]
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (8, 50)).astype(np.uint64), axis=0) for _ in range(near.PRINTS)]
    y = [a ^ f for a, f in zip(x, flips, strict=True)]
    keys = []
    for side in (x, y):
        own = [set() for _ in range(50)]
        for p, f in enumerate(side):
            for r, k in zip(*near.keys_of(f, 5), strict=True):
                own[r].add(int(k) | p << 44)
        keys.append(own)
    want = [min(a & b, default=-1) for a, b in zip(*keys, strict=True)]
    assert near.smallest_common_key(x, y).tolist() == want and max(want) >= 0
