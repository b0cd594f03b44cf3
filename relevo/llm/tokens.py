"""Byte-level BPE ids of whole texts, for use inside tasks."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

#: Bytes of text that op4 and op5 encode together, and units that they keep: more units of a larger block are alike.
ENCODE_BYTES, ENCODE_UNITS = 4 << 20, 300_000

_OTHER, _LETTER, _DIGIT, _SIGN, _WHITE = range(5)


def _classes() -> np.ndarray:
    """Class of each ASCII byte; the apostrophe, control characters and bytes of longer characters are ``_OTHER``."""
    kind = np.zeros(256, dtype=np.uint8)
    for c in map(chr, range(33, 127)):
        kind[ord(c)] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SIGN
    kind[ord("'")] = _OTHER
    kind[[*range(9, 14), 32]] = _WHITE
    return kind


_CLASS = _classes()


def _kinds(data: np.ndarray) -> np.ndarray:
    """Class of every byte of UTF-8 text, with the letters of Latin-1 and white space beyond ASCII told apart too."""
    kind = _CLASS[data]
    high = np.flatnonzero(data >= 0xC2)
    high = high[high + 1 < len(data)]
    lead, second = data[high], data[high + 1]
    letters = high[(lead == 0xC3) & (second != 0x97) & (second != 0xB7)]
    white = high[(lead == 0xC2) & ((second == 0x85) | (second == 0xA0))]
    for at, k in ((letters, _LETTER), (white, _WHITE)):
        kind[at] = kind[at + 1] = k
    three = high[(lead >= 0xE1) & (lead <= 0xE3) & (high + 2 < len(data))]
    if len(three):
        code = (data[three].astype(np.int32) & 15) << 12 | (data[three + 1].astype(np.int32) & 63) << 6 | data[three + 2] & 63
        wide = three[np.isin(code, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
        kind[wide] = kind[wide + 1] = kind[wide + 2] = _WHITE
    return kind


def cut_units(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Ascending offsets that cut texts (``data[edges[i]:edges[i + 1]]``) into units, 0 and the end included.

    The vocabulary's pre-tokenizer has a boundary at each: where white space
    begins; before its last character where something follows; after that
    character unless it is a space; and where letters, digits and signs meet.
    No boundary is taken at an apostrophe or a character of unknown class.
    """
    kind = _kinds(data)
    white = kind == _WHITE
    left, here = kind[:-1], kind[1:]
    turns = white[1:] != white[:-1]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = (turns & white[1:]) | ((left != here) & (np.minimum(left, here) > _OTHER) & (np.maximum(left, here) < _WHITE))
    last = np.flatnonzero(turns & white[:-1])  # the last byte of white space that something follows
    ends = np.zeros(len(data) + 1, dtype=bool)
    ends[edges] = True
    last = last[(data[last] < 0x80) & ~ends[last + 1]]
    cut[last] = True
    cut[last[data[last] != 32] + 1] = True
    cut[edges] = True
    cut[0] = cut[-1] = True
    return np.flatnonzero(cut)


def gather(lists: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``lists[starts[i]:starts[i] + sizes[i]]`` of all i, one after another."""
    before = np.cumsum(sizes) - sizes
    return lists[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their edges (one more than texts); a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[edges[0]:edges[-1]]
    return data, edges - edges[0]


def _slices(values: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without nulls as ``bytes`` (several times faster than ``to_pylist``)."""
    if not len(values):
        return []
    edges = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset:values.offset + len(values) + 1].tolist()
    data = values.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(edges, edges[1:])]


class Units:
    """Ids of texts from those of their units, each distinct unit of a block of texts encoded once.

    Units are told apart and put together again by whole arrays. The last
    units met are kept, up to twice ``cache_units``: a full generation becomes
    the old one, and what is met again moves to the new one.
    """

    def __init__(self, cache_units: int):
        self.cache_units, self.known, self.old = cache_units, {}, {}

    def encode_new(self, units: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _look_up(self, units: list[bytes]) -> list[bytes]:
        if len(self.known) > self.cache_units:
            self.known, self.old = {}, self.known
        out = list(map(self.known.get, units))
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i in missing:
            out[i] = self.old.get(units[i])
        new = [i for i in missing if out[i] is None]
        for i, ids in zip(new, self.encode_new([units[i].decode() for i in new])):
            out[i] = array("I", ids).tobytes()
        self.known.update((units[i], out[i]) for i in missing if len(units[i]) < 100)
        return out

    def join(self, data: np.ndarray, edges: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) and the edges of each text's; ``cuts`` ascend and hold every edge."""
        units = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        ids = self._look_up(_slices(units.dictionary))
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 2
        lists, which = np.frombuffer(b"".join(ids), dtype="<u4"), units.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        return gather(lists, (np.cumsum(sizes) - sizes)[which], sizes[which]), ends[np.searchsorted(cuts, edges)]


class ByteBpe(Units):
    """Ids of the ``tokenizers`` library for a byte-level vocabulary, by the units of :func:`cut_units`.

    With ``plain`` the strings of special tokens are ordinary text; otherwise
    a text that holds one is a single unit.
    """

    def __init__(self, path: str = BYTE_BPE, plain: bool = False, cache_units: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(cache_units)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode_new(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def encode_bytes(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the edges of each text's, for texts as UTF-8 bytes with edges."""
        cuts, raw = cut_units(data, edges), data.tobytes() if self.special else b""
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                i = int(np.searchsorted(edges, at, "right"))
                if at + len(token) <= edges[i]:  # taken whole
                    cuts = cuts[(cuts <= edges[i - 1]) | (cuts >= edges[i])]
                    at = int(edges[i]) - 1
                at = raw.find(token, at + 1)
        return self.join(data, edges, cuts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the edges of each text's; a null text has none."""
        return self.encode_bytes(*utf8(texts))


@lru_cache(maxsize=2)
def byte_bpe(path: str = BYTE_BPE, plain: bool = False, cache_units: int = 200_000) -> ByteBpe:
    """One encoder per Python worker and vocabulary."""
    return ByteBpe(path, plain, cache_units)


def text_blocks(batches, rows: int = 128):
    """Record batches cut to at most ``rows`` rows, so that few texts are Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sized_blocks(batches, size: int = 2 << 20, column: str = "text"):
    """Record batches cut to about ``size`` bytes of text (one text at least)."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, stop - at)
            at = stop
