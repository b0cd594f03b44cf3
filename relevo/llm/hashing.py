"""64-bit hashes of words and word windows, vectorised over a whole text.

A word's hash is a polynomial of its bytes modulo 2^64, taken from running
sums over a block of text, then mixed. Long texts are hashed block by block
(cut at white space), so memory does not grow with them.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 18
#: A fixed odd base and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_SPACES = bytes(range(9, 14)) + b" "
_IS_SPACE = np.isin(np.arange(256), list(_SPACES))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size == BLOCK + 1:
            _powers[key] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of ``data[begin:end]`` for arrays of spans; ``data`` are small integers."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data) + 1)[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * _power(INVERSE, len(data) + 1)[begin] + (end - begin).astype(np.uint64))


def _blocks(raw: bytes):
    """Pieces of about ``BLOCK`` bytes that end at white space (longer where a word is)."""
    at = 0
    while len(raw) - at > BLOCK:
        cut = max(raw.rfind(bytes([c]), at, at + BLOCK) for c in _SPACES)
        if cut <= at:
            later = [x for c in _SPACES if (x := raw.find(bytes([c]), at + BLOCK)) >= 0]
            cut = min(later) if later else len(raw)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words (runs of anything but space and \\t-\\r) of a text with A-Z lower-cased."""
    out = []
    for block in _blocks((text or "").encode().lower()):
        data = np.frombuffer(block, dtype=np.uint8)
        gaps = np.diff(np.concatenate([[True], _IS_SPACE[data], [True]]).astype(np.int8))
        out.append(span_hashes(data, np.flatnonzero(gaps == -1), np.flatnonzero(gaps == 1)))
    return np.concatenate(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` words; of the whole sequence where it is shorter, none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    h = words[:len(words) - size + 1].copy()
    for k in range(1, size):
        h = mix(h * np.uint64(BASE) + words[k:len(words) - size + 1 + k])
    return h if size > 1 else mix(h)
