"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model is compiled into three machines over the tropical semiring: a normaliser (space
to U+2581, a dummy prefix), a piece machine (a trie of pieces whose final arcs put out ids)
and a byte-fallback machine (a character without a piece puts out the ids of its bytes).
An input is composed with them into a lattice whose states are (position, last piece), and
the shortest path is the encoding.  Arc weights come from `Pieces`: scores for unigram
models, neighbour consistency (0 or infinity) for merge models.  The lattice is cut at
pre-tokens that no piece crosses; repeated pre-tokens are looked up in a bounded memo.

Cases: null text gives null ids; empty text no ids; any text decodes to itself, except
that U+2581 in a text is a space to the model.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from . import vocabulary
from .common import Memo, worker_state
from .common import pieces as slices
from .vocabulary import Pieces

#: Pre-tokens in each generation that a worker remembers.
MEMO = 250_000
#: Longer pre-tokens are not remembered.
KEEP_CHARS = 64
#: Weight of a byte arc in unigram models, below the smallest score.
BYTE_PENALTY = 10.0


class Transducer:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.cut = vocabulary.cutter(pieces)
        self.root: dict = {}
        for piece, i in pieces.ids.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (piece, i)
        self.merges = pieces.kind == "bpe"
        self.start = ("", 0.0, None, ()), []
        self.start[1].append((self.root, self.start[0], {}))
        self.byte_weight = BYTE_PENALTY - min(pieces.scores.values(), default=0.0)
        self.memo = Memo(MEMO)
        self.following = vocabulary.Followers(pieces)

    def _step(self, at: tuple, c: str) -> tuple:
        """One more input character: from (state, open) to the next (state, open).

        A state is the shortest path to a position: last piece, weight, state before, ids put
        out; None where no path ends.  `open` holds, for each state from which a piece is
        still under way, the place in the piece trie, that state and its known followers.
        In merge models a prefix has one consistent segmentation at most, so one state of
        finite weight is left at each position; in unigram models weights do not depend on
        the last piece, so the states of a position fall together."""
        merges, following, scores = self.merges, self.following, self.pieces.scores
        under_way, state, single = [], None, False
        for place, start, known in at[1]:
            place = place.get(c)
            if place is None:
                continue
            under_way.append((place, start, known))
            final = place.get("")
            if final is None:
                continue
            piece, k = final
            if len(piece) == 1:
                single = True
            if merges:
                if state is None:
                    last = start[0]
                    if last:
                        ok = known.get(piece)
                        if ok is None:
                            ok = following.ask(known, last, piece)
                        if not ok:
                            continue
                    state = (piece, 0.0, start, (k,))
            else:
                w = start[1] - scores[piece]
                if state is None or w < state[1]:
                    state = (piece, w, start, (k,))
        if not single and at[0] is not None and (state is None or not merges):
            ids = tuple(self.pieces.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))
            w = at[0][1] + self.byte_weight * len(ids)
            if state is None or w < state[1]:
                state = ("", w, at[0], ids)
        if state is not None:
            under_way.append((self.root, state, following.of(state[0]) if merges and state[0] else {}))
        return state, under_way

    def shortest(self, tokens) -> dict[str, bytes]:
        """Ids (as int32 bytes) along the shortest path of each pre-token.  The pre-tokens are
        composed with the machines as one prefix tree, visited depth first: what they share
        is computed once."""
        path, before, step, out = [self.start], "", self._step, {}
        for token in sorted(tokens):
            shared = 0
            for a, b in zip(before, token, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            at = path[-1]
            for c in token[shared:]:
                at = step(at, c)
                path.append(at)
            before, state, put = token, at[0], []
            while state[2] is not None:
                put.append(state[3])
                state = state[2]
            put.reverse()
            out[token] = array("i", [k for ids in put for k in ids]).tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cuts = [None if t is None else self.cut.findall(vocabulary.normalise(t, self.pieces)) for t in texts]
        asked = set()
        for tokens in cuts:
            if tokens:
                asked.update(tokens)
        memo, known = self.memo, {}
        for token in asked:
            ids = memo.get(token)
            if ids is not None:
                known[token] = ids
        new = self.shortest(asked.difference(known))
        for token, ids in new.items():
            if len(token) <= KEEP_CHARS:
                memo.put(token, ids)
        known |= new
        return [None if tokens is None else np.frombuffer(b"".join(map(known.__getitem__, tokens)), dtype=np.int32) for tokens in cuts]

    def decoder(self) -> list[bytes]:
        """What each id puts out, as bytes; the inverse of the piece and byte machines."""
        out = [name.replace(vocabulary.SPACE, " ").encode() for name in self.pieces.names]
        for b, i in enumerate(self.pieces.byte_ids):
            if i != self.pieces.unknown:
                out[i] = bytes([b])
        return out

    def decode(self, ids: np.ndarray, table: list[bytes]) -> str:
        raw = b"".join(map(table.__getitem__, ids.tolist()))
        if self.pieces.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "surrogatepass")


def encode_decode(docs: DataFrame, path: str = vocabulary.DEFAULT_MODEL, text: str = "text") -> DataFrame:
    """docs with ids, n_tokens, decoded_sha256 (of the text decoded from the ids, UTF-8) and
    round_trip (the decoded text is the text) in place of the text."""
    known = docs.drop("ids", "n_tokens", "decoded_sha256", "round_trip")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.load(path))
    keep = [c for c in known.columns if c != text]
    schema = known.select(*keep).schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("decoded_sha256", "string").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = worker_state("encode", shared, Transducer)
        table = machine.decoder()
        for batch in batches:
            for part in slices(batch, text):
                rows, sizes, digests, same = [], [], [], []
                texts = part.column(text).to_pylist()
                for t, ids in zip(texts, machine.encode(texts), strict=True):
                    if ids is None:
                        rows.append(np.zeros(0, dtype=np.int32))
                        sizes.append(None)
                        digests.append(None)
                        same.append(None)
                        continue
                    back = machine.decode(ids, table)
                    rows.append(ids)
                    sizes.append(len(ids))
                    digests.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    same.append(back == t.replace(vocabulary.SPACE, " "))
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                offsets = pa.array(ends, pa.int32(), mask=np.array([n is None for n in sizes] + [False]))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                    names=schema.names)

    return known.mapInArrow(run, schema)
