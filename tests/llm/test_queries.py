"""op* queries over a small folder of awkward tables, each against a brute-force version."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from voxarbor.llm import media, mixing, queries  # noqa: E402

WORDS = {
    "en": "the of and to in is that was with over from this have they which house garden water people little".split(),
    "de": "der die und zu nicht mit auf für über größer straße häuser schön wird werden können müssen zurück wäre ich".split(),
    "fr": "le la les des est une dans été français où déjà très garçon forêt être avec pour leçon plus même".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def make_docs():
    rng = random.Random(11)
    rows = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        rows.append([i, prose(rng, lang, rng.randint(3, 120)), lang, f"src{i % 5}" if i % 7 else None, 0])
    passage = prose(rng, "en", 45)
    for i in range(90, 100):
        rows.append([i, f"{prose(rng, 'en', 15)} {passage} {prose(rng, 'en', 15)}", "en", "src0", 0])
    for i in range(100, 112):  # exact copies, one source holding a third
        rows.append([i, rows[4][1], "de", "src0", 0])
    near = rows[5][1].split() or ["x"]
    for i in range(112, 116):
        w = list(near)
        w[i % len(w)] = "CHANGED"
        rows.append([i, " ".join(w), "fr", "src1", 0])
    rows += [
        [116, None, "en", "src1", 0], [117, "", None, "src1", 0], [118, "  \t\n ", "en", "src2", 0], [119, "12345 !!! ...", "en", None, 0],
        [120, "and " * 70, "en", "src2", 0], [121, prose(rng, "en", 4000), "en", "src2", 0], [122, "tab\tand\x0bother\x0cblanks\r\nnot this one ▁ 日本 \U0001F600", "en", "src3", 0],
    ]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(make_docs(), "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'x' AS size", "1 AS score", "'y' AS kept")  # clashing names
    docs.unionByName(docs.where("doc_id = 3")).write.parquet(f"file://{at}/documents.parquet")
    rng = random.Random(2)
    vecs = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(160)] + [(160, None, 0), (161, [None] + [0.1] * 7, 0), (162, [math.nan] + [0.1] * 7, 0), (163, [0.25] * 8, 0), (164, [0.25] * 8, 0)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{at}/embeddings.parquet")
    pages = [
        (1, "http://a.org/x/1", "<html><nav>Menu</nav><article><h1>T &amp; U</h1><p>One  two<br>three</p><p><b>Open<p>Next</p></article><footer>F</footer></html>"),
        (2, "http://a.org/x/2", "<body><div>Site line</div><div>Own &lt;text&gt; here</div><div>Bottom</div><form>F <input></form></body>"),
        (3, "http://a.org/x/3", "<body><div>Site line</div><div>Other body</div><div>Bottom</div><script>if (a<b) x('</p>')</script></body>"),
        (4, "http://b.org/", None), (5, None, ""), (6, "http://c.org/a", "<p>Same</p>"), (7, "http://c.org/b", "<p>Same</p>"),
        (8, "http://d.org/", "<div class='cookie-notice'>We use</div><main><p>Body</p><aside>Side</aside><section class=\"comments\"><p>Nice!</p></section></main>"),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"file://{at}/pages.parquet")
    return f"file://{at}"


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def split(text):
    return (text or "").encode().split()


def test_op1(spark, folder, docs):
    got = {r.doc_id: r for r in run(spark, folder, "op1_language_id")}
    assert len(got) == len({d[0] for d in docs})
    for i, text, lang, _ in docs:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert got[i].lang_pred == "und"
    long = [(got[i].lang_pred, lang) for i, t, lang, _ in docs if got[i].held_out and lang and len(split(t)) > 15]
    assert sum(a == b for a, b in long) >= 0.85 * len(long)


def test_op2(spark, folder, docs):
    got = {r.doc_id: r for r in run(spark, folder, "op2_substring_dedup")}
    seen = set()
    for i, text, *_ in sorted(set(docs), key=lambda d: d[0]):
        w = split(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest()), i


def test_op3(spark, folder, docs):
    rows = run(spark, folder, "op3_sharding")
    assert len(rows) == len(docs) and {r.law for r in rows} == {"bytes"}
    size = {i: len((t or "").encode()) + 16 for i, t, *_ in docs}
    assert all(r["size"] == size[r.doc_id] for r in rows)
    assert all(r.text_crc32 == zlib.crc32((t or "").encode()) for i, t, *_ in docs for r in rows if r.doc_id == i)
    slots, total = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        total[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    mean = sum(size[d[0]] for d in docs) / 40
    assert max(total.values()) <= mean + max(size.values())


def test_op3_keeps_copies_together(spark):
    """Copies of a text share a shard, but for a text too large for one."""
    from voxarbor.llm import sharding

    rng = random.Random(4)
    texts = [prose(rng, "en", rng.randint(5, 200)) for _ in range(400)]
    rows = [(i, texts[i // 5]) for i in range(2000)] + [(5000 + i, "the same text " * 20) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.histogram_shards(docs, 8).collect()
    at, total, text = defaultdict(set), Counter(), dict(rows)
    for r in got:
        at[text[r.doc_id]].add(r.shard)
        total[r.shard] += r["size"]
    assert len(got) == len(rows) and len(at["the same text " * 20]) > 1
    assert all(len(s) == 1 for t, s in at.items() if t != "the same text " * 20)
    mean = sum(total.values()) / 8
    assert all(abs(n - mean) <= 0.25 * mean for n in total.values())


def test_op4_and_op7(spark, folder, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.sentencepiece_fst.vocabulary.DEFAULT_MODEL)
    ids = {r.doc_id: r for r in run(spark, folder, "op4_sentencepiece")}
    counts = {r.doc_id: r.n_tokens for r in run(spark, folder, "op7_token_counts")}
    for i, text, *_ in docs:
        if text is None:
            assert ids[i].ids is None and counts[i] is None
            continue
        assert list(ids[i].ids) == model.encode(text) and counts[i] == len(ids[i].ids) and ids[i].round_trip


def test_op5(spark, folder):
    got = {r.page_id: r.text for r in run(spark, folder, "op5_html_text")}
    assert got[1] == "T & U\n\nOne two three\n\nOpen\n\nNext"
    assert got[4] == got[5] == ""
    assert got[6] == got[7] == "Same"
    assert got[8] == "Body"
    assert "Own <text> here" in got[2] and "Other body" in got[3]


def test_op5_deletes_shared_lines(spark):
    from voxarbor.llm import html_text

    html = lambda own: f"<div>Site line</div><div>{own}</div><div>Bottom</div>"
    pages = spark.createDataFrame([(i, f"http://a.org/p/{i}", html(f"own {i}")) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: f"own {i}" for i in range(6)}


def test_common_lines_is_an_lcs():
    from voxarbor.llm.html_text import common_lines

    rng = random.Random(4)
    for _ in range(60):
        a, b = [rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert len(common_lines(a, b)) == t[-1][-1]


def test_op6(spark, folder, docs):
    rows = run(spark, folder, "op6_mixing")
    assert len(rows) == len(docs)
    size, by = {i: len(split(t)) for i, t, *_ in docs}, Counter()
    for i, _, _, s in docs:
        by[s] += size[i]
    want = mixing.targets(dict(by))
    taken = Counter()
    for r in rows:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] and abs(r.target - want[r.source]) < 1e-6 and r.source_size == by[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(2, 0.02 * want[s]) for s in by)
    again = run(spark, folder, "op6_mixing")
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_targets_reshare_the_excess():
    t = mixing.targets({"a": 10, "b": 1000, "c": 1000, None: 0})
    assert t["a"] == 20 and t[None] == 0 and abs(sum(t.values()) - 1.5 * 2010) < 1e-6


def test_fit_hits_reachable_sums():
    import numpy as np

    rng = random.Random(9)
    for _ in range(40):
        lengths = np.array(sorted(rng.sample(range(1, 30), 4)))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_fit_on_the_way_back(monkeypatch):
    import numpy as np

    lengths, counts = np.arange(2, 400, 2), np.full(199, 30)
    want = mixing.fit(lengths, counts, 200_001)
    monkeypatch.setattr(mixing, "STEPS_KEPT", 3)
    assert (mixing.fit(lengths, counts, 200_001) == want).all() and (want * lengths).sum() == 200_000


def test_op8(spark, folder):
    vecs = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    good = {i: [math.floor(256 * x) for x in v] for i, v in vecs.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in good:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]
            want |= {(q, k + 1, i, -n) for k, (n, i) in enumerate(s)}
    assert {tuple(r) for r in run(spark, folder, "op8_top_k")} == want


def test_blocks_are_skipped():
    """On vectors in clusters bounds skip most blocks; results are those of a full scan."""
    import numpy as np
    from voxarbor.llm import topk

    rng = np.random.default_rng(0)
    m = np.floor(256 * (np.repeat(rng.normal(size=(20, 16)), 200, 0) + 0.05 * rng.normal(size=(4000, 16))))
    m = m[rng.permutation(4000)]
    ids, at = np.arange(4000), np.arange(0, 4000, 50)
    s = (m[at] @ m.T).astype(int)
    s[np.arange(80), at] = -(10**15)
    want = {(q, int(i), int(s[q, i])) for q in range(80) for i in np.lexsort((ids, -s[q]))[:5]}
    floor = np.sort(s, axis=1)[:, -5]
    for given in (None, floor):
        q, i, score, scored = topk.best_in(ids, m, at, m[at], 5, given)
        assert {(int(a), int(b), int(c)) for a, b, c in zip(q, i, score, strict=True)} == want
        assert scored < 0.5 * 80 * 4000 / topk.BLOCK_ROWS


def test_op9(spark, folder, docs):
    def mark(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: mark(t) for i, t, *_ in docs}
    group = {i: i for i in prints}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                group[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r for r in run(spark, folder, "op9_simhash")}
    assert all(got[i].fingerprint == f"{p:016x}" and got[i].component_id == find(i) for i, p in prints.items())


def test_golay_keys_meet(spark):
    import numpy as np
    from voxarbor.llm import simhash

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for bits in (2, 5):
        other = base.copy()
        for i in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1 << int(b))
        a, b = (set(zip(*map(list, simhash.keys_of(x, bits)))) for x in (base, other))
        hit = {r for r, _ in a & b}
        assert len(hit) == len(base)


def test_hot_keys_lose_no_link(spark, monkeypatch):
    from voxarbor.llm import simhash
    from voxarbor.llm.components import components

    monkeypatch.setattr(simhash, "GROUP_ROWS", 7)
    prints = [(i, (i * 3) ^ (1 << 40)) for i in range(60)]
    nodes = spark.createDataFrame(prints, "id long, fp long")
    got = {r.node: r.root for r in components(simhash.links(nodes, 2)).collect()}
    group = {i: i for i, _ in prints}
    for _ in prints:
        for i, p in prints:
            for j, q in prints:
                if (p ^ q).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    assert all(got.get(i, i) == group[i] for i in group)


def test_op10(spark, folder, docs):
    got = {r.doc_id: r for r in run(spark, folder, "op10_media")}
    for i, t, *_ in docs:
        raw = (t or "").encode()
        p = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.png_encode(p)).hexdigest() and (r.width, r.height, r.depth) == (64, len(p) // 64, 8)


def test_png_is_lossless():
    for n in (1, 2, 7):
        p = bytes(random.Random(n).randrange(256) for _ in range(64 * n))
        assert media.png_decode(media.png_encode(p)) == p


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    assert queries.QUERIES[name](spark, f"file://{tmp_path}").count() == 0


def test_unigram_models_take_the_shortest_path():
    from voxarbor.llm.sentencepiece_fst import BYTE_PENALTY, Transducer
    from voxarbor.llm.token_counts import CountTrie
    from voxarbor.llm.vocabulary import Pieces

    rng = random.Random(3)
    for _ in range(200):
        names = {"".join(rng.choice("ab▁") if i == 0 else rng.choice("ab") for i in range(rng.randint(1, 3))) for _ in range(6)}
        ids = {p: i + 300 for i, p in enumerate(sorted(names))}
        cost = {p: rng.uniform(0.5, 5) for p in ids}
        model = Pieces("unigram", ids, {p: -w for p, w in cost.items()}, list(range(256)), 0, True, [""] * 400, 3)
        weight = {i: cost[p] for p, i in ids.items()} | {b: BYTE_PENALTY + max(cost.values()) for b in range(256)}
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 7)))
        line = "▁" + text.replace(" ", "▁")
        best = [0.0] + [math.inf] * len(line)
        for i in range(len(line)):
            for j in range(i + 1, len(line) + 1):
                if line[i:j] in ids:
                    best[j] = min(best[j], best[i] + cost[line[i:j]])
            if line[i] not in ids:
                best[i + 1] = min(best[i + 1], best[i] + weight[0] * len(line[i].encode()))
        got = Transducer(model).encode([text])[0]
        assert abs(sum(weight[k] for k in got.tolist()) - best[-1]) < 1e-9
        assert CountTrie(model).counts([text])[0] == len(got)


def test_op2_with_split_shards(spark, folder, monkeypatch):
    """Frequent and very frequent anchors give what others give."""
    from voxarbor.llm import substring

    want = {tuple(r) for r in run(spark, folder, "op2_substring_dedup")}
    monkeypatch.setattr(substring, "FREQUENT", 2)
    monkeypatch.setattr(substring, "SPLIT", 3)
    assert {tuple(r) for r in run(spark, folder, "op2_substring_dedup")} == want
