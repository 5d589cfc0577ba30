"""Statistics of one text as bytes that several operators use; words are runs of ``[^\\x20\\x09-\\x0D]``."""

from __future__ import annotations

import numpy as np
import xxhash

WINDOW = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _SYMBOL, _LEAD, _UPPER, _LOWER, _MORE = (np.zeros(256, bool) for _ in range(6))
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_LEAD[[b for b in range(256) if b & 0xC0 != 0x80]] = True
_UPPER[65:91] = True
_LOWER[97:123] = True


def classes(text: bytes) -> tuple[int, int, int, int]:
    """Code points outside white space, symbols, capital letters A-Z, letters a-z."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return int(seen[_LEAD & ~_SPACE].sum()), int(seen[_SYMBOL].sum()), int(seen[_UPPER].sum()), int(seen[_LOWER].sum())


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Stable 64-bit hashes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words, order included."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : len(h) - n + 1 + k]
    return out


def repeated_words(h: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Whether each word is in a window of n words that the text holds twice or more, the first included."""
    grams = rolling(h, n)
    covered = np.zeros(len(h), bool)
    if len(grams) > 1:
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            starts = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            for k in range(n):
                covered[starts + k] = True
    return covered


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))
