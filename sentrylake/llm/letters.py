"""Texts as streams of letters: lower case, every run of other characters one blank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bits of a symbol: 0 is the blank, lower-case letters of ASCII and Latin-1 are themselves, any other letter is one
#: of the 96 symbols below them, by its code point (so neighbours in an alphabet differ).
BITS = 8
#: Characters that are turned at once; a memory bound, texts are taken whole.
SLICE = 1 << 20
_symbols: np.ndarray | None = None


def symbol_table() -> np.ndarray:
    global _symbols
    if _symbols is None:
        points = np.arange(0x110000, dtype=np.int32)
        made = np.where((points > 0x60) & (points < 1 << BITS), points, 1 + points % 96).astype(np.uint8)
        for i in range(0x110000):
            if not chr(i).isalpha():
                made[i] = 0
        _symbols = made
    return _symbols


def streams(text: str, before: int, overlap: int) -> Iterator[np.ndarray]:
    """Symbols of a text with ``before`` blanks ahead and one behind, in slices that repeat the last ``overlap`` symbols."""
    table, tail = symbol_table(), np.zeros(before, np.int64)
    fresh = True
    for at in range(0, max(1, len(text)), SLICE):
        part = text[at : at + SLICE].lower()
        if at + SLICE >= len(text):
            part += " "
        s = table[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        last = 0 if fresh else tail[-1]
        s = s[(s != 0) | (np.concatenate([[last], s[:-1]]) != 0)]
        s = np.concatenate([tail, s])
        if len(s) > len(tail) or fresh:
            yield s
        tail, fresh = s[len(s) - min(len(s), overlap) :], False


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """Every run of ``n`` symbols as one integer, the last symbol lowest."""
    size = max(0, len(s) - n + 1)
    g = s[:size].copy()
    for k in range(1, n):
        g <<= BITS
        g |= s[k : k + size]
    return g
