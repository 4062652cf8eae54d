"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Distinct pre-tokens of a slice of texts form a trie, which is visited depth first: sorted
pre-tokens are its paths, and the nodes of the current path lie on a stack.  A node holds
the forward score of its prefix (best weight, token count and last piece), computed once
from the node above and shared by all pre-tokens below.  The counts at terminal nodes are
stored and a text's count is their sum.  Weights are those of
`vocabulary.Pieces`: scores in unigram models (ties: fewer tokens), neighbour consistency
in merge models; a character without a piece counts its UTF-8 bytes.

A worker remembers the terminal counts asked lately; forgetting changes no result.

Cases: null text has null tokens; empty text has 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import vocabulary
from .common import Memo, worker_state
from .common import pieces as slices
from .vocabulary import Pieces

TERMINALS = 250_000
#: Counts of longer pre-tokens are kept for the slice only; others in two generations.
KEEP_CHARS = 64


class CountTrie:
    """Nodes are (score, tokens, last piece, open): `open` holds, for each start from which a
    piece may still be under way, the place in the piece trie and the forward state of the
    start.  A new node only moves its parent's open starts by one character."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.cut = pieces, vocabulary.cutter(pieces)
        self.merges = pieces.kind == "bpe"
        self.byte_weight = min(pieces.scores.values(), default=0.0) - 10.0
        self.starts: dict = {}
        for piece in pieces.ids:
            node = self.starts
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        self.following = vocabulary.Followers(pieces)
        self.root = (0.0, 0, "", [(self.starts, 0.0, 0, "", {})])
        self.terminal = Memo(TERMINALS)

    def _node(self, parent: tuple, c: str) -> tuple:
        """Forward state of the parent's prefix and one more character."""
        merges, scores, following = self.merges, self.pieces.scores, self.following
        under_way, found, single = [], None, False
        for place, score, count, last, known in parent[3]:
            nxt = place.get(c)
            if nxt is None:
                continue
            under_way.append((nxt, score, count, last, known))
            piece = nxt.get("")
            if piece is None:
                continue
            single = single or len(piece) == 1
            if merges:
                if found is None:
                    ok = True
                    if last:
                        ok = known.get(piece)
                        if ok is None:
                            ok = following.ask(known, last, piece)
                    if ok:
                        found = (0.0, count + 1, piece)
            else:
                score += scores[piece]
                if found is None or (score, -count - 1) > (found[0], -found[1]):
                    found = (score, count + 1, piece)
        if not single and parent[1] >= 0 and (found is None or not merges):
            n = len(c.encode("utf-8", "surrogatepass"))
            score = parent[0] + n * self.byte_weight
            if found is None or score > found[0]:
                found = (score, parent[1] + n, "")
        if found is None:
            return 0.0, -1, "", under_way  # no segmentation ends here
        under_way.append((self.starts, *found, following.of(found[2]) if merges and found[2] else {}))
        return *found, under_way

    def visit(self, tokens: Iterable[str]) -> dict[str, int]:
        """Counts of pre-tokens, visiting their trie depth first."""
        path, before, step, out = [self.root], "", self._node, {}
        for token in sorted(tokens):
            shared = 0
            for a, b in zip(before, token, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            node = path[-1]
            for c in token[shared:]:
                node = step(node, c)
                path.append(node)
            out[token] = node[1]
            before = token
        return out

    def counts(self, texts: list[str | None]) -> list[int | None]:
        cuts = [None if t is None else self.cut.findall(vocabulary.normalise(t, self.pieces)) for t in texts]
        asked = set()
        for tokens in cuts:
            if tokens:
                asked.update(tokens)
        memo, terminal = self.terminal, {}
        for token in asked:
            n = memo.get(token)
            if n is not None:
                terminal[token] = n
        new = self.visit(asked.difference(terminal))
        for token, n in new.items():
            if len(token) <= KEEP_CHARS:
                memo.put(token, n)
        terminal |= new
        return [None if tokens is None else sum(map(terminal.__getitem__, tokens)) for tokens in cuts]


def count_tokens(docs: DataFrame, path: str = vocabulary.DEFAULT_MODEL, text: str = "text") -> DataFrame:
    """docs with n_tokens, the model's token count of the whole text, in place of the text."""
    known = docs.drop("n_tokens")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.load(path))
    keep = [c for c in known.columns if c != text]
    schema = known.select(*keep).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = worker_state("count", shared, CountTrie)
        for batch in batches:
            for part in slices(batch, text):
                n = trie.counts(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n, pa.int64())], names=schema.names)

    return known.mapInArrow(run, schema)
