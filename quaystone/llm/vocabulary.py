"""Piece vocabularies of SentencePiece model files, and cutting texts where no piece can cross.

Texts are normalised as the files here ask: a space before the text, and every
space written as U+2581.  No piece has U+2581 after another character, nor a
line break, so the tokens of a text are those of its chunks: runs of U+2581
with the characters that follow, and runs of line breaks.  The loader checks
that this holds for the file.  Chunks repeat a great deal, so a bounded cache
keeps what was worked out for them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Most chunks a cache holds before its later half goes; this bounds memory and changes no result.
CACHE = 150_000

_CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")


def normalise(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def chunks(text: str | None) -> list[str]:
    return _CHUNK.findall(normalise(text))


@dataclass
class Vocabulary:
    """``pieces``: (text, score) of the ordinary pieces by id; ``bytes_from``: id of byte 0, or None."""

    pieces: list[tuple[str, float] | None]
    unknown: int
    bytes_from: int | None

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p[0]: i for i, p in enumerate(self.pieces) if p}

    @cached_property
    def scores(self) -> dict[str, float]:
        return {p[0]: p[1] for p in self.pieces if p}

    @cached_property
    def surface(self) -> list[bytes]:
        """What each id stands for in a decoded text, with U+2581 for spaces."""
        out = [p[0].encode() if p else b"" for p in self.pieces]
        if self.bytes_from is not None:
            for b in range(256):
                out[self.bytes_from + b] = bytes([b])
        return out

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece has."""
        return [self.unknown] if self.bytes_from is None else [self.bytes_from + b for b in char.encode()]


def load(path: str = MODEL) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n = model.normalizer_spec
    if n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces:
        raise ValueError(f"{path}: this normalisation is not supported")
    pieces = [(p.piece, p.score) if p.type == p.NORMAL else None for p in model.pieces]
    if any(p and ("\n" in p[0] or SPACE in p[0].lstrip(SPACE)) for p in pieces):
        raise ValueError(f"{path}: pieces cross chunks")
    first = next((i for i, p in enumerate(model.pieces) if p.type == p.BYTE), None)
    return Vocabulary(pieces, model.trainer_spec.unk_id, first)


def trim(cache: dict) -> None:
    """Keep a full cache's earlier half: frequent chunks are met first."""
    if len(cache) > CACHE:
        for key in list(cache)[CACHE // 2 :]:
            del cache[key]
