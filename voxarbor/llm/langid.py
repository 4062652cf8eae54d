"""Language identification with a byte convolutional network.

Bytes are embedded; filters of several widths slide over fixed-length windows of the
text; each filter's outputs are max-pooled over the window; a softmax layer names the
language.  The network is trained in numpy on a bounded sample of labelled rows and
then applied to every window of every whole text in batches.  For application the
filters are folded into lookup tables over byte pairs, which gives the same sums.

Cases: null text, and text without a letter, is `und` with score 0; with no labelled
row to learn from every document is; equal texts get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, worker_state

WIDTHS, FILTERS, EMBED = (2, 3, 4), 24, 8
WINDOW = 256
#: Labelled rows the network is fitted on, at most (chosen by id hash), and the bytes
#: of each that serve as examples.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 1024
EPOCHS, BATCH = 6, 64
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray  # 256 x EMBED; byte 0 pads
    filters: list[np.ndarray]  # per width: width*EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width, tables over byte pairs (and a last single byte) whose rows add up
        to the filter outputs."""
        all_ = []
        for width, w in zip(WIDTHS, self.filters, strict=True):
            one = [self.embed @ w[j * EMBED : (j + 1) * EMBED] for j in range(width)]
            pairs = [(one[j][:, None] + one[j + 1][None]).reshape(65536, -1) for j in range(0, width - 1, 2)]
            all_.append([t.astype(np.float32) for t in pairs + one[width - width % 2 :]])
        return all_


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Network | None:
    """Adam on cross-entropy over windows; some windows are cut short so that short
    texts are known too."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    if not labels:
        return None
    rows, ys = [], []
    for t, lang in zip(texts, langs, strict=True):
        b = t.encode("utf-8", "surrogatepass")
        for s in range(0, max(1, len(b)), WINDOW):
            piece = b[s : s + WINDOW]
            if piece.strip():
                rows.append(piece)
                ys.append(labels.index(lang))
    net = Network(
        labels, rng.normal(0, 0.3, (256, EMBED)), [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), np.zeros(len(labels)))
    if not rows:
        return net
    x, y = np.zeros((len(rows), WINDOW), dtype=np.uint8), np.array(ys)
    for i, piece in enumerate(rows):
        x[i, : len(piece)] = np.frombuffer(piece, dtype=np.uint8)
    weight = len(y) / (len(labels) * np.maximum(np.bincount(y, minlength=len(labels)), 1)) ** 1.0
    params = [net.embed, *net.filters, net.bias, net.out, net.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for s in range(0, len(order), BATCH):
            pick = order[s : s + BATCH]
            xb, yb = x[pick].copy(), y[pick]
            for i in np.flatnonzero(rng.random(len(pick)) < 0.4):
                xb[i, int(rng.integers(6, 80)) :] = 0
            grads = _gradients(net, xb, yb, weight[yb])
            step += 1
            rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p -= rate * m[k] / (np.sqrt(v[k]) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    n, e = len(x), net.embed[x]
    pooled, where, patches = [], [], []
    for width, f in zip(WIDTHS, net.filters, strict=True):
        p = np.concatenate([e[:, j : WINDOW - width + 1 + j] for j in range(width)], axis=2)
        z = p @ f
        at = z.argmax(1)
        pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        where.append(at)
        patches.append(np.take_along_axis(p, at.reshape(n, -1, 1), 1))  # n x FILTERS x width*EMBED
    pre = np.concatenate(pooled, 1) + net.bias
    h = np.maximum(pre, 0)
    d = _softmax(h @ net.out + net.out_bias)
    d[np.arange(n), y] -= 1
    d *= (w / n)[:, None]
    dh = (d @ net.out.T) * (pre > 0)
    ge, gf = np.zeros_like(net.embed), []
    for k, width in enumerate(WIDTHS):
        g = dh[:, k * FILTERS : (k + 1) * FILTERS]
        gf.append(np.einsum("nf,nfp->pf", g, patches[k]))
        gp = (g[:, :, None] * net.filters[k].T[None]).reshape(n, FILTERS, width, EMBED)
        rows = np.arange(n)[:, None]
        for j in range(width):
            np.add.at(ge, x[rows, where[k] + j], gp[:, :, j])
    return [ge, *gf, dh.sum(0), h.T @ d, d.sum(0)]


def _pool(x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Max over positions of the filter outputs, for each window (row of bytes)."""
    wide = x.astype(np.uint16)
    pair = (wide[:, :-1] << 8) | wide[:, 1:]
    out = []
    for width, ts in zip(WIDTHS, tables, strict=True):
        last = WINDOW - width + 1
        z = ts[0][pair[:, :last]]
        for k, t in enumerate(ts[1:], 1):
            at = 2 * k
            z += t[pair[:, at : at + last]] if len(t) == 65536 else t[x[:, at : at + last]]
        out.append(z.max(1))
    return np.concatenate(out, 1)


def predict(net: Network, texts: list[str | None], tables=None, step: int = 64) -> tuple[list[str], list[float]]:
    """Label and score (mean probability over the text's windows) of each whole text."""
    tables = tables or net.tables()
    known = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not known:
        return names, scores
    raw = [texts[i].encode("utf-8", "surrogatepass") for i in known]
    per = [-(-len(b) // WINDOW) for b in raw]
    x = np.frombuffer(b"".join(b.ljust(n * WINDOW, b"\0") for b, n in zip(raw, per, strict=True)), dtype=np.uint8).reshape(-1, WINDOW)
    h = np.concatenate([_pool(x[s : s + step], tables) for s in range(0, len(x), step)])
    p = _softmax(np.maximum(h + net.bias, 0) @ net.out + net.out_bias)
    sums = np.add.reduceat(p, np.concatenate([[0], np.cumsum(per)[:-1]]), axis=0) / np.array(per)[:, None]
    best = sums.argmax(1)
    for i, b, s in zip(known, best, sums[np.arange(len(known)), best], strict=True):
        names[i], scores[i] = net.labels[b], float(min(1.0, max(0.0, s)))
    return names, scores


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text is a multiple of 5 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Network | None:
    """Train on at most SAMPLE_ROWS labelled rows that are not held out."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    h = F.xxhash64(doc_id)
    # Thin out by hash first, so that what each task sends stays small on any input.
    total = max(1, rows.count())
    share = min(1 << 30, int((2.0 * SAMPLE_ROWS + 1000) / total * (1 << 30)))
    rows = rows.where(F.pmod(F.xxhash64(doc_id, F.lit(1)), F.lit(1 << 30)) < share)
    start = F.pmod(h, F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    picked = (
        rows.select(h.alias("h"), F.col(text).substr(start, F.lit(SAMPLE_CHARS)).alias("t"), F.col(lang).alias("l"))
        .orderBy("h", "t").limit(SAMPLE_ROWS).collect()
    )
    return train([r.t for r in picked], [r.l for r in picked])


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs with columns lang_pred and score added; only `text` is looked at."""
    schema = docs.drop("lang_pred", "score").schema.add("lang_pred", "string").add("score", "double")
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = worker_state("langid", shared, lambda net: net.tables() if net else None)
        for batch in batches:
            for part in pieces(batch, text):
                texts = part.column(text).to_pylist()
                p, s = predict(net, texts, tables) if net else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
                cols = [part.column(n) for n in names[:-2]] + [pa.array(p, pa.string()), pa.array(s, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.drop("lang_pred", "score").mapInArrow(label, schema)
