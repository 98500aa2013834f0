"""Reads a SentencePiece model file: the protobuf wire format, as far as pieces, trainer and normaliser settings go."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Fixed values of the public protobuf: kinds of piece and of model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    charsmap: bytes = b""


def _fields(data: bytes):
    """The (number, value) of each field: int, float or bytes by its wire type."""

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    at = 0
    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif tag & 7 == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif tag & 7 == 1:
            yield tag >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        else:
            raise ValueError(f"wire type {tag & 7}")


def parse(data: bytes) -> PieceModel:
    """Field numbers: model 1 pieces, 2 trainer, 3 normaliser; piece 1 text, 2 score, 3 kind; trainer 3 kind of model, 35 byte
    fallback; normaliser 2 character map, 3 dummy prefix, 4 extra white space, 5 escaping."""
    out = PieceModel()
    for n, value in _fields(data):
        if n == 1:
            piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
            out.pieces.append((piece[1].decode(), piece[2], piece[3]))
        elif n == 2:
            trainer = dict(_fields(value))
            out.kind, out.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif n == 3:
            norm = dict(_fields(value))
            out.charsmap = norm.get(2, b"")
            out.add_dummy_prefix, out.remove_extra_whitespaces, out.escape_whitespaces = (bool(norm.get(k, 1)) for k in (3, 4, 5))
    return out


def load(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return parse(f.read())
