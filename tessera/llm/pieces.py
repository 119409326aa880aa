"""Piece vocabularies: the pieces and scores of a SentencePiece model file, taken as a unigram model, and bounded memos.

A text is segmented so that the sum of its pieces' scores is largest. Of equal sums, the segmentation with the longer
last piece wins, from the end backwards. A space is written as U+2581; a character that no piece covers becomes the
byte pieces of its UTF-8 form, at the score of the worst piece less a penalty each.
"""

from __future__ import annotations

from functools import lru_cache

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str | None = None) -> bytes:
    """The model file's bytes, read by the driver and sent with the tasks (about half a megabyte)."""
    with open(path or default_model(), "rb") as f:
        return f.read()


class Pieces:
    """``score`` and ``id`` by piece; ``bytes_of`` by id; ``byte_ids`` by byte value; ``longest`` in characters."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], special: set[int]):
        self.byte_ids = byte_ids
        no_text = special | set(byte_ids)
        self.id = {p: i for i, (p, _) in enumerate(pieces) if i not in no_text and p}
        self.score = {p: pieces[i][1] for p, i in self.id.items()}
        self.longest = max(map(len, self.id), default=1)
        usual = [s for s in self.score.values() if s > -1e8]  # pieces that are never to be chosen have -1e9
        self.unknown = min(usual, default=0.0) - UNKNOWN_PENALTY
        self.bytes_of = [b"" if i in special else p.replace(SPACE, " ").encode("utf-8", "surrogatepass")
                         for i, (p, _) in enumerate(pieces)]
        for value, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([value])
        #: Every start of a piece: with the piece's score and id, or with None where it is only a start.
        self.table = {p[:n]: None for p in self.id for n in range(1, len(p) + 1)}
        self.table.update({p: (self.score[p], i) for p, i in self.id.items()})
        self.ends = {p[-n:] for p in self.id for n in range(1, len(p) + 1)}
        #: No piece holds a space after anything else, nor a line break: so such places always part the lattice.
        self.parts_at_space = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.parts_at_line = not any("\n" in p for p in self.id)

    @classmethod
    def load(cls, model: bytes) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        byte_at = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)],
                   [byte_at[f"<0x{b:02X}>"] for b in range(256)], special)

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=2)
def pieces_of(model: bytes) -> Pieces:
    """One vocabulary for each Python worker."""
    return Pieces.load(model)


class Memo(dict):
    """A bounded memo: what it misses, ``make`` computes; when it is full, the older half is kept apart and goes
    unless it is used again. Bounds memory only; results don't depend on it."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
