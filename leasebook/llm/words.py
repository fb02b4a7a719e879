"""Words of a text as 64-bit hashes, with numpy: spans, rolling hashes, winnowing.

Word and n-gram hashes are polynomials modulo 2^64, taken from prefix sums, so every n-gram
costs the same whatever its length. `lane` selects one of two independent hash families;
identities that must hold over a whole corpus use both.
"""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in BASES]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i < n."""
    if len(_POWERS[lane][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for base in (BASES[lane], pow(BASES[lane], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[lane] = (made[0], made[1])
    return _POWERS[lane]


def byte_class(word_bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(word_bytes)] = True
    return out


# Bytes of a word in texts split at blanks, and in texts split at anything but letters and digits.
NOT_BLANK = byte_class(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
ALPHANUMERIC = byte_class(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def spans(raw: bytes, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = word[np.frombuffer(raw, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(lane, len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[lane][np.frombuffer(raw, np.uint8)] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(hashes: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of every run of n words; empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(lane, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1] + np.uint64(n))


def anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """For every run of `window` grams, the place of its smallest (the first of equals).

    The choice depends on the run's own content only, so equal runs choose alike.
    """
    if len(grams) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return view.argmin(axis=1) + np.arange(len(view))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)
