"""Texts as arrays of code points: the common ground of the vectorised operators."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

#: Characters that one pass holds as arrays at a time; a single longer text is still taken whole.
CHUNK_CHARS = 1_000_000


def chunks(texts: Sequence[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive slices (first index, texts with null as '') of at most ``limit`` characters or one text."""
    at, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > limit:
            yield at, part
            at, size, part = i, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield at, part


def joined(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(string, code points, first position of each text, position after each text).

    One separator stands after every text, so neighbours never touch.
    """
    whole = "\n".join(texts) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    firsts = np.concatenate(([0], ends[:-1] + 1)) if len(texts) else np.zeros(0, np.int64)
    return whole, points, firsts, ends


@cache
def category_flags(prefixes: str) -> np.ndarray:
    """Per code point: whether its general category starts with one of the letters, e.g. 'L' or 'LN'."""
    flags = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        flags[c] = unicodedata.category(chr(c))[0] in prefixes
    return flags


def ranges(*pairs: tuple[int, int]) -> np.ndarray:
    """Flags of inclusive code point ranges."""
    flags = np.zeros(sys.maxunicode + 1, bool)
    for a, b in pairs:
        flags[a : b + 1] = True
    return flags


@cache
def white_space() -> np.ndarray:
    """The Unicode property White_Space (fixed values)."""
    return ranges((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


@cache
def han() -> np.ndarray:
    """Han ideographs: the unified blocks, compatibility forms, and the iteration and number marks (fixed values)."""
    return ranges((0x2E80, 0x2FD5), (0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAD9), (0x20000, 0x323AF))


@cache
def alphanumeric() -> np.ndarray:
    """Letters and digits as Python's ``str.isalnum`` has them."""
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
