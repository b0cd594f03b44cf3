"""SentencePiece encoding and decoding (operator 3), with byte offsets in the original text.

The model's normaliser is run here so that its alignment is known: at each
place the longest prefix found in the compiled character map is replaced, any
other character is copied, spaces become the space mark, and every normalised
byte remembers the original byte it came from. Pieces are laid over the
normalised text and projected back through that alignment. The merges
themselves are the ``sentencepiece`` library's; each distinct unit (a run of
space marks with the characters up to the next) is given to it once, which is
exact as no piece of the vocabulary has a space mark after another character.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from relevo.llm.common import read
from relevo.llm.tokens import text_blocks

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
_UNIT = re.compile(f"{MARK}*[^{MARK}]*")


class CharacterMap:
    """A compiled character map: a double-array trie of UTF-8 prefixes and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.texts = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``text[at:]`` and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for n, byte in enumerate(text[at:at + 256], 1):
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            leaf = units[node] >> 8 & 1
            node ^= offset(units[node])
            if leaf:
                found = n, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1]:self.texts.index(b"\0", found[1])]


class Normaliser:
    """What a SentencePiece model does to a text before its merges, with the alignment."""

    def __init__(self, spec, suffix_mark: bool = False):
        if suffix_mark:
            raise ValueError("models that treat white space as a suffix are not supported")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = (
            spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)

    def align(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and for the end the original byte offset."""
        raw = text.encode()
        if not raw:
            return b"", np.zeros(1, dtype=np.int64)
        if not self.map.units and not self.squeeze and self.escape:
            # nothing but spaces changes
            chars = np.frombuffer(raw, dtype=np.uint8)
            at = np.repeat(np.arange(len(raw)), np.where(chars == 32, 3, 1))
            head = np.zeros(3 * self.prefix, dtype=np.int64)
            return ((MARK if self.prefix else "") + text.replace(" ", MARK)).encode(), np.concatenate([head, at, [len(raw)]])
        mark = MARK.encode() if self.escape else b" "
        out, at = [], []
        i, space, end = 0, self.squeeze, 0

        def put(b: bytes, origin: int) -> None:
            out.append(b)
            at.extend([origin] * len(b))

        def step(i: int) -> tuple[int, bytes]:
            if hit := self.map.longest(raw, i):
                return hit
            n = 1
            while i + n < len(raw) and raw[i + n] & 0xC0 == 0x80:
                n += 1
            return n, raw[i:i + n]

        while self.squeeze and i < len(raw) and (first := step(i))[1] == b" ":  # no space at the beginning
            i += first[0]
        if self.prefix and i < len(raw):
            put(mark, i)
        while i < len(raw):
            n, new = step(i)
            if space and self.squeeze:
                new = new.lstrip(b" ")
            if new:
                for part in re.split(b"( )", new):
                    put(mark if part == b" " else part, i)
                if self.squeeze:
                    space = new.endswith(b" ")
            i += n
            if new or not self.squeeze:
                end = i
        if self.squeeze:  # no space at the end
            while out and (not out[-1] or out[-1] == mark):
                del at[len(at) - len(out[-1]):]
                out.pop()
                end = at[-1] + 1 if at and not out[-1] else end
            end = min(end, len(raw))
        return b"".join(out), np.array(at + [end if self.squeeze else len(raw)], dtype=np.int64)


class PieceCodec:
    """Exact ids, decoded text and original byte spans of a model's pieces."""

    def __init__(self, path: str = PIECE_MODEL, cache_chars: int = 6_000_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto.FromString(self.sp.serialized_model_proto())
        self.normaliser = Normaliser(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        pieces = list(model.pieces)
        # one piece per unit needs: no mark inside a piece, no piece matched before the merges
        self.by_unit = (model.normalizer_spec.add_dummy_prefix and not self.normaliser.map.units
                        and not self.normaliser.squeeze
                        and not any(MARK in p.piece.lstrip(MARK) or p.type == p.USER_DEFINED for p in pieces))
        self.width = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in pieces], dtype=np.int64)
        self.unknown = self.sp.unk_id()
        self.cache_chars, self.held, self.known = cache_chars, 0, {}

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<i4")
        if not self.by_unit:
            return np.array(self.sp.encode(text), dtype="<i4")
        if self.held > self.cache_chars:
            self.held, self.known = 0, {}
        known, normal = self.known, MARK + text.replace(" ", MARK)
        # evenly spaced text has one mark before each unit
        units = ([MARK + u for u in normal.split(MARK)[1:]] if MARK * 2 not in normal
                 else [u for u in _UNIT.findall(normal) if u])
        if new := list(set(units).difference(known)):
            encoded = self.sp.encode([u[1:].replace(MARK, " ") for u in new], num_threads=1)
            for u, ids in zip(new, encoded):
                known[u] = array("i", ids if u != MARK else [self.sp.piece_to_id(MARK)]).tobytes()
                self.held += len(u)
        return np.frombuffer(b"".join(map(known.__getitem__, units)), dtype="<i4")

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Byte offsets in the UTF-8 text where each piece begins, and the end of the last one."""
        normal, align = self.normaliser.align(text)
        widths = self.width[ids]
        if (ids == self.unknown).any():  # an unknown piece is as wide as what it stands for: ask the library
            proto = self.sp.encode(text, out_type="immutable_proto")
            widths = np.array([len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(widths)])
        if bounds[-1] != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return align[bounds]

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


@lru_cache(maxsize=2)
def codec(path: str = PIECE_MODEL) -> PieceCodec:
    """One codec per Python worker and model."""
    return PieceCodec(path)


def _encode(path: str):
    def run(batches):
        c = codec(path)
        for b in text_blocks(batches):
            texts = [t or "" for t in b["text"].to_pylist()]
            ids = [c.encode(t) for t in texts]
            spans = [c.spans(t, i) for t, i in zip(texts, ids)]
            lists = lambda xs, kind: pa.array(xs, type=pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], lists(ids, pa.int32()), lists([s[:-1] for s in spans], pa.int64()),
                 lists([s[1:] for s in spans], pa.int64())], names=["doc_id", "ids", "begins", "ends"])
    return run


def encode_pieces(docs: DataFrame, model: str = PIECE_MODEL) -> DataFrame:
    """``(doc_id, ids, begins, ends)``: the pieces of each text and their byte spans in it.

    A null or empty text has no pieces. Rows are independent: repeated ids,
    null ids and other columns do not matter.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _encode(model), f"doc_id {id_type}, ids array<int>, begins array<bigint>, ends array<bigint>")


def _round_trip(path: str):
    def run(batches):
        c = codec(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in text_blocks(batches):
            rows = []
            for t in b["text"].to_pylist():
                t = t or ""
                ids = c.encode(t)
                rows.append((len(ids), sha(",".join(map(str, ids.tolist())).encode()), sha(c.decode(ids).encode()),
                             sha(c.spans(t, ids).astype("<i8").tobytes())))
            n, a, d, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, type=pa.int64()), pa.array(a), pa.array(d), pa.array(s)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])
    return run


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; ``spans_sha256`` is of the boundaries as little-endian 64-bit integers."""
    docs = read(spark, sf_dir, "documents")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _round_trip(PIECE_MODEL),
        f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


QUERIES = {"op3_piece_codec": op3_piece_codec}
ORACLES: dict[str, str] = {}
