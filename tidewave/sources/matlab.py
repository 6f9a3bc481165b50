"""Numeric variables of MATLAB 5 files: tagged elements, packed or compressed, real and complex."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Fixed values of the format: number types of elements, numeric classes of matrices, the tags of a matrix and of a compressed element.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
MATRIX, COMPRESSED, COMPLEX = 14, 15, 0x0800


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, content) one after the other; a cut-off element is an error."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # packed into the tag
            kind, size, begin, after = kind & 0xFFFF, kind >> 16, at + 4, at + 8
        else:
            begin = at + 8
            after = begin + size + (-size % 8 if kind != COMPRESSED else 0)
        if begin + size > len(data):
            raise ValueError("the file ends within an element")
        yield kind, data[begin : begin + size]
        at = after


def _numbers(kind: int, content: bytes, order: str) -> np.ndarray:
    if kind not in NUMBERS:
        raise ValueError(f"elements of type {kind} are no numbers")
    return np.frombuffer(content, np.dtype(NUMBERS[kind]).newbyteorder(order))


def _matrix(content: bytes, order: str) -> tuple[str, np.ndarray] | None:
    """(name, values) of a numeric matrix, None for other classes (cells, structures, characters, sparse)."""
    parts = _elements(content, order)
    flags = int(_numbers(*next(parts), order)[0])
    shape = tuple(_numbers(*next(parts), order).astype(int))
    name = next(parts)[1].decode("latin-1")
    if flags & 0xFF not in CLASSES:
        return None
    values = _numbers(*next(parts), order)
    if flags & COMPLEX:
        values = values + 1j * _numbers(*next(parts), order)
    else:
        values = values.astype(CLASSES[flags & 0xFF])  # small values may be stored in fewer bytes
    return name, values.reshape(shape, order="F")


def variables(data: bytes) -> dict[str, np.ndarray]:
    """Numeric variables by name, in the file's order; a ValueError if it is no such file or is damaged."""
    mark = data[126:128]
    if mark not in (b"IM", b"MI"):
        raise ValueError("not a MATLAB 5 file")
    order, out = "<" if mark == b"IM" else ">", {}
    try:
        for kind, content in _elements(data[128:], order):
            if kind == COMPRESSED:
                kind, content = next(_elements(zlib.decompress(content), order))
            if kind == MATRIX and content and (found := _matrix(content, order)):
                out[found[0]] = found[1]
    except (struct.error, zlib.error, StopIteration, RuntimeError) as e:
        raise ValueError("a damaged MATLAB 5 file") from e
    return out
