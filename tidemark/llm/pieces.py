"""Vocabularies of sentence-piece model files: pieces, scores and kinds, and what both kinds of model share."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick

#: Fixed values of the file format: kinds of pieces, kinds of models, the mark that stands for a space.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message in protocol-buffer wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = number()
        field, kind = key >> 3, key & 7
        if kind == 0:
            yield field, number()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else number()
            yield field, data[at : at + size]
            at += size


def read_model(data: bytes) -> dict:
    """Pieces and rules of a model file: plain values, fit to be broadcast.

    Only models that leave the text as it is are read: no character map, no dropping of spaces, a space put in front.
    """
    model = {"pieces": [], "kind": UNIGRAM, "bytes": False, "unknown": " ⁇ "}
    rules = {3: True, 4: True, 5: True}
    for field, value in _fields(data):
        if field == 1:
            piece, score, kind = "", 0.0, NORMAL
            for part, inner in _fields(value):
                if part == 1:
                    piece = inner.decode("utf-8")
                elif part == 2:
                    score = struct.unpack("<f", inner)[0]
                elif part == 3:
                    kind = inner
            model["pieces"].append((piece, score, kind))
        elif field == 2:
            for part, inner in _fields(value):
                if part == 3:
                    model["kind"] = inner
                elif part == 35:
                    model["bytes"] = bool(inner)
                elif part == 44:
                    model["unknown"] = inner.decode("utf-8")
        elif field == 3:
            for part, inner in _fields(value):
                if part == 2 and inner:
                    raise ValueError("models with a character map are not read")
                if part in rules:
                    rules[part] = bool(inner)
    if rules != {3: True, 4: False, 5: True}:
        raise ValueError("models that drop or do not mark spaces are not read")
    if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in model["pieces"]):
        raise ValueError("models with user-defined or unused pieces are not read")
    return model


class Vocabulary:
    """What encoding needs of a model, whatever its kind."""

    def __init__(self, model: dict):
        self.pieces = model["pieces"]
        self.normal = {piece: k for k, (piece, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.unknown = next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.unknown_text = model["unknown"]
        self.byte_ids = [0] * 256
        for k, (piece, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = k
        self.falls_back = model["bytes"]
        several = {piece for piece in self.normal if len(piece) > 1}
        #: Pieces never reach over these borders, so each part is encoded on its own.
        self.part = None
        if not any(SPACE in piece.lstrip(SPACE) for piece in several):
            inner = sorted({c for piece in several for c in piece} - {SPACE})
            self.part = re.compile(f"{SPACE}*[{''.join(map(re.escape, inner))}]+|{SPACE}+|.", re.DOTALL)

    def parts(self, text: str | None) -> list[str]:
        """``text`` with spaces marked, cut where no piece can reach over."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return self.part.findall(marked) if self.part else [marked]

    def ids_of_unknown(self, character: str) -> list[int]:
        if self.falls_back:
            return [self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def surface(self, ids: list[int]) -> str:
        """Text of ids with the spaces still in front."""
        out: list[str] = []
        held = bytearray()
        for k in [*ids, -1]:
            kind = self.pieces[k][2] if k >= 0 else None
            if kind == BYTE:
                held.append(int(self.pieces[k][0][1:-1], 16))
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if kind == NORMAL:
                out.append(self.pieces[k][0].replace(SPACE, " "))
            elif kind == UNKNOWN:
                out.append(self.unknown_text)
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids without the space that encoding puts in front."""
        first = next((self.pieces[k] for k in ids if self.pieces[k][2] != CONTROL), None)
        text = self.surface(ids)
        return text[1:] if first and first[2] == NORMAL and first[0].startswith(SPACE) else text


def _utf8(data: bytes) -> str:
    """Characters of ``data``; each byte that begins none becomes a replacement character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


def matcher(words: dict[str, object]) -> ahocorasick.Automaton:
    """An automaton that yields (last position, value) of every word that ends there, the longest first."""
    automaton = ahocorasick.Automaton()
    for word, value in words.items():
        automaton.add_word(word, value)
    automaton.make_automaton()
    return automaton
