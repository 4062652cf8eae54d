"""A SentencePiece model's pieces, and which of them may stand side by side.

Models of kind "unigram" weigh a piece by its score.  In models of kind "bpe" a
segmentation is the model's own exactly when every two neighbours are: joined and merged
anew, the pair must fall apart into the same two pieces.  Weight 0 for such neighbours and
infinity for others turns the merge rules into a shortest path.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs remembered by a worker, at most.
PAIRS = 600_000


@dataclass
class Pieces:
    kind: str  # "bpe" or "unigram"
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]  # id of each byte's piece
    unknown: int
    dummy_prefix: bool = True
    names: list[str] = field(default_factory=list)
    longest: int = 0

    def merge(self, text: str) -> list[str]:
        """Pieces after merging characters by falling score, leftmost first."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(parts) and (whole := parts[i] + parts[j]) in self.ids:
                heapq.heappush(heap, (-self.scores[whole], i, whole))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            if parts[i] is None or (j := right[i]) >= len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in parts if p is not None]

    def fits(self, a: str, b: str) -> bool:
        """Whether b may follow a."""
        return self.kind != "bpe" or self.merge(a + b) == [a, b]


class Followers(dict):
    """Which pieces may follow a piece, as far as asked: last piece -> {piece: answer}.
    Forgets everything beyond PAIRS answers."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.asked = pieces, 0

    def of(self, last: str) -> dict[str, bool]:
        if self.asked >= PAIRS:
            self.clear()
            self.asked = 0
        found = self.get(last)
        if found is None:
            found = self[last] = {}
        return found

    def ask(self, known: dict[str, bool], last: str, piece: str) -> bool:
        self.asked += 1
        ok = known[piece] = self.pieces.fits(last, piece)
        return ok


def load(path: str = DEFAULT_MODEL) -> Pieces:
    """Read a model file on the driver; the pieces are sent to the executors (tens of
    thousands of short strings)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    try:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(open(path, "rb").read())
        kind, dummy = {1: "unigram", 2: "bpe"}[spec.trainer_spec.model_type], spec.normalizer_spec.add_dummy_prefix
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only identity normalisers are compiled")
    except ImportError as e:
        raise ValueError(f"the kind of the model {path} cannot be told without the protobuf package") from e
    ids, scores, byte_ids = {}, {}, [sp.unk_id()] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ids[sp.id_to_piece(i)], scores[sp.id_to_piece(i)] = i, sp.get_score(i)
    if kind == "bpe":
        whole = Pieces(kind, ids, scores, byte_ids, sp.unk_id())
        dead = [p for p in ids if whole.merge(p) != [p]]  # never made by merging
        for p in dead:
            del ids[p]
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return Pieces(kind, ids, scores, byte_ids, sp.unk_id(), dummy, names, max(map(len, ids), default=0))


def cutter(pieces: Pieces) -> re.Pattern:
    """Pattern of pre-tokens no piece reaches across: runs of spaces with what follows, and
    line feeds on their own if no piece has one."""
    if any(SPACE in p.lstrip(SPACE) for p in pieces.ids):
        return re.compile(".+", re.S)
    if any("\n" in p for p in pieces.ids):
        return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
    return re.compile(f"\n+|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def normalise(text: str, pieces: Pieces) -> str:
    out = text.replace(" ", SPACE)
    return SPACE + out if pieces.dummy_prefix and out else out
