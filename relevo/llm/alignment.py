"""Cross-tokenizer alignment (operator 13): where the tokens of two vocabularies end together.

Both vocabularies split the same bytes, so the ends of a text's tokens are two
ascending lists of byte offsets. They are intersected by galloping: the
shorter list drives, and each of its ends is looked for in the longer one by
exponential, then binary search from where the last one was found. (The
driving lists of a block of texts are cut into lanes of bounded length that
step together, so the search runs on whole arrays.) The common ends cut both
token lists into groups; the differences of their ranks are the groups'
overlap ranges. Tokens that end together are linked.

How often an id pair is linked in the corpus is counted on chunks' distinct
pairs. A chunk (some megabytes of text) lists its distinct pairs once with
their counts, and its documents refer to that list. The lists are summed with
map-side combining, each pair meets its total, and the totals go back to
their chunk: what is shuffled are distinct pairs of chunks, never token
occurrences, and a pair that every chunk holds is one row a chunk.

Null and empty texts, and texts whose joined token bytes are not a space and
the text (a vocabulary cannot write them), have no tokens: counts of zero and
an empty digest. Rows are independent: repeated rows, null ids and other
columns do not matter. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.llm.common import read
from relevo.llm.piece_codec import MARK, PIECE_MODEL, codec
from relevo.llm.tokens import BYTE_BPE, Units, byte_bpe, gather, sized_blocks, utf8
from relevo.session import write_shared

#: Ends of a lane of the driving list, bytes of ids whose pairs are listed together, and bytes of text aligned at once.
LANE, CHUNK_BYTES, BLOCK_BYTES = 64, 12 << 20, 2 << 20


class PieceUnits(Units):
    """Ids of a SentencePiece model whose pieces have no space mark inside: one unit per run of spaces and what follows."""

    def __init__(self, path: str = PIECE_MODEL, cache_units: int = 200_000):
        super().__init__(cache_units)
        self.codec = codec(path)

    def encode_new(self, units: list[str]) -> list[list[int]]:
        sp = self.codec.sp
        ids = sp.encode([u[1:] for u in units], num_threads=1)  # the library puts a space before each
        return [i if u != " " else [sp.piece_to_id(MARK)] for u, i in zip(units, ids)]

    def encode_bytes(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the edges of each text's, for texts that begin with the space which the model adds."""
        if not self.codec.by_unit:
            ids = [self.codec.encode(data[a + 1:b].tobytes().decode()) for a, b in zip(edges, edges[1:])]
            flat = np.concatenate([*ids, np.zeros(0, dtype=np.int32)]).astype("<u4")
            return flat, np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        cut[edges] = True
        return self.join(data, edges, np.flatnonzero(cut))


@lru_cache(maxsize=2)
def piece_units(path: str = PIECE_MODEL) -> PieceUnits:
    """One encoder per Python worker and model."""
    return PieceUnits(path)


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens, and where those of each id begin and how many they are."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    return np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


@lru_cache(maxsize=2)
def byte_level_bytes(path: str):
    """Token bytes of a byte-level vocabulary: printable bytes stand for themselves, the n-th other byte is character 256 + n."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}
    vocab = byte_bpe(path, True).tokenizer.get_vocab()
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return _table(pieces)


@lru_cache(maxsize=2)
def piece_bytes(path: str):
    """Token bytes of a SentencePiece model: the space mark is a space, a byte piece its byte."""
    sp = codec(path).sp
    return _table([bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
                   for i in range(sp.get_piece_size())])


def gallop(short: np.ndarray, short_edges: np.ndarray, long: np.ndarray, long_edges: np.ndarray) -> np.ndarray:
    """Place in ``long`` of every value of ``short``, or -1.

    Both hold ascending lists one after another (list i between edges i and
    i + 1); list i of ``short`` is looked for in list i of ``long``.
    """
    found = np.full(len(short), -1, dtype=np.int64)
    sizes = np.diff(short_edges)
    lanes = -(-sizes // LANE)
    of = np.repeat(np.arange(len(sizes)), lanes)
    first = short_edges[:-1][of] + LANE * (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    last = np.minimum(first + LANE, short_edges[1:][of])
    cursor, stop = long_edges[:-1][of].copy(), long_edges[1:][of]
    for step in range(LANE):
        lane = np.flatnonzero(first + step < last)
        if not len(lane):
            break
        x, end = short[first[lane] + step], stop[lane]
        low, high, jump = cursor[lane], cursor[lane], 1
        ahead = np.flatnonzero(low < end)
        ahead = ahead[long[low[ahead]] < x[ahead]]
        while len(ahead):  # exponential: ``low`` passes what is too small, ``high`` is the next place to look at
            low[ahead] = high[ahead] + 1
            high[ahead] = np.minimum(high[ahead] + jump, end[ahead])
            jump *= 2
            ahead = ahead[high[ahead] < end[ahead]]
            ahead = ahead[long[high[ahead]] < x[ahead]]
        open_ = np.flatnonzero(low < high)
        while len(open_):  # binary, between the two
            middle = (low[open_] + high[open_]) >> 1
            less = long[middle] < x[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        cursor[lane] = low
        inside = np.flatnonzero(low < end)
        hit = inside[long[low[inside]] == x[inside]]
        found[first[lane[hit]] + step] = low[hit]
    return found


def common_ends(a: np.ndarray, a_edges: np.ndarray, b: np.ndarray, b_edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the common values of each pair of ascending lists; of each pair the shorter list drives."""
    a_sizes, b_sizes = np.diff(a_edges), np.diff(b_edges)
    by_a = a_sizes <= b_sizes
    out_a, out_b = [], []
    for drive, swap in ((by_a, False), (~by_a, True)):
        rows = np.flatnonzero(drive)
        if not len(rows):
            continue
        (s, s_edges, s_n), (t, t_edges, t_n) = ((b, b_edges, b_sizes), (a, a_edges, a_sizes)) if swap else (
            (a, a_edges, a_sizes), (b, b_edges, b_sizes))
        mine = gather(np.arange(len(s)), s_edges[rows], s_n[rows])
        theirs = gather(np.arange(len(t)), t_edges[rows], t_n[rows])
        edges = lambda n: np.concatenate([[0], np.cumsum(n[rows])])
        at = gallop(s[mine], edges(s_n), t[theirs], edges(t_n))
        hit = np.flatnonzero(at >= 0)
        one, two = mine[hit], theirs[at[hit]]
        out_a.append(two if swap else one)
        out_b.append(one if swap else two)
    ia, ib = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in (out_a, out_b))
    order = np.argsort(ia, kind="stable")
    return ia[order], ib[order]


class Alignment:
    """Tokens of a block of texts in both vocabularies, and their common ends.

    ``a_ids``, ``b_ids`` with ``a_edges``, ``b_edges`` of each text; ``a_at``,
    ``b_at``: indexes of the tokens that end together, the last of each group;
    ``g_edges``: the groups of each text; ``ends``: byte offset of each group's end
    in its text with the space before it.
    """

    def __init__(self, texts: pa.Array, a_path: str, b_path: str):
        data, edges = utf8(texts)
        sizes = np.diff(edges)
        data = np.insert(data, edges[:-1][sizes > 0], 32)  # the space before each text
        edges = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
        bad = np.zeros(len(sizes), dtype=bool)
        while True:
            self.a_ids, self.a_edges = byte_bpe(a_path, True).encode_bytes(data, edges)
            self.b_ids, self.b_edges = piece_units(b_path).encode_bytes(data, edges)
            a_ends, a_bad = self._ends(byte_level_bytes(a_path), self.a_ids, self.a_edges, data, edges)
            b_ends, b_bad = self._ends(piece_bytes(b_path), self.b_ids, self.b_edges, data, edges)
            bad = a_bad | b_bad
            if not bad.any():
                break
            keep = np.repeat(~bad, np.diff(edges))  # once more without the texts that cannot be written
            data, edges = data[keep], np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(edges)))])
        self.a_at, self.b_at = common_ends(a_ends, self.a_edges, b_ends, self.b_edges)
        self.g_edges = np.searchsorted(self.a_at, self.a_edges)
        self.ends = a_ends[self.a_at] - np.repeat(edges[:-1], np.diff(self.g_edges))

    @staticmethod
    def _ends(table, ids: np.ndarray, id_edges: np.ndarray, data: np.ndarray, edges: np.ndarray):
        """Byte offset where each token ends in ``data``, and which texts are not their tokens' bytes."""
        flat, starts, sizes = table
        ends = np.cumsum(sizes[ids])
        joined = gather(flat, starts[ids], sizes[ids])
        at = np.concatenate([[0], ends])[id_edges]
        if np.array_equal(at, edges) and np.array_equal(joined, data):
            return ends, np.zeros(len(edges) - 1, dtype=bool)
        return ends, np.array([not np.array_equal(joined[p:q], data[s:e])
                               for p, q, s, e in zip(at, at[1:], edges, edges[1:])])

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups as text (``a1,a2|b1;a3|b2,b3``) of all texts, in bytes, and the edges of each text's."""
        a_last, b_last = np.zeros(len(self.a_ids), dtype=np.int64), np.zeros(len(self.b_ids), dtype=np.int64)
        a_last[self.a_at] = b_last[self.b_at] = 1
        a_place = np.arange(len(a_last)) + np.concatenate([[0], self.b_at + 1])[np.cumsum(a_last) - a_last]
        b_place = np.arange(len(b_last)) + (self.a_at + 1)[np.cumsum(b_last) - b_last]
        value = np.empty(len(a_last) + len(b_last), dtype=np.int64)
        sign = np.empty(len(value), dtype=np.uint8)
        value[a_place], value[b_place] = self.a_ids, self.b_ids
        sign[a_place] = np.where(a_last, ord("|"), ord(","))
        sign[b_place] = np.where(b_last, ord(";"), ord(","))
        edges = self.a_edges + self.b_edges
        sign[edges[1:][np.diff(edges) > 0] - 1] = 0
        width = len(str(int(value.max()))) if len(value) else 1
        cells = np.empty((len(value), width + 1), dtype=np.uint8)
        used = np.empty(cells.shape, dtype=bool)
        for k in range(width):
            cells[:, width - 1 - k] = value // 10 ** k % 10 + 48
            used[:, width - 1 - k] = (value >= 10 ** k) | (k == 0)
        cells[:, width], used[:, width] = sign, sign > 0
        return cells[used], np.concatenate([[0], np.cumsum(used.sum(axis=1))])[edges]


def align_tokens(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_MODEL) -> DataFrame:
    """``(doc_id, a_ids, b_ids, a_stops, b_stops, ends)`` of every row of ``(doc_id, text)``.

    Group g of a text is ``a_ids[a_stops[g-1]:a_stops[g]]`` against the same of b,
    and ends at byte ``ends[g]`` of a space and the text.
    """
    def run(batches):
        for b in sized_blocks(batches, BLOCK_BYTES):
            x = Alignment(b["text"], a_path, b_path)
            lists = lambda v, e, kind: pa.ListArray.from_arrays(pa.array(e, type=pa.int32()), pa.array(v.astype(kind)))
            n = np.diff(x.g_edges)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], lists(x.a_ids, x.a_edges, "<i4"), lists(x.b_ids, x.b_edges, "<i4"),
                 lists(x.a_at + 1 - np.repeat(x.a_edges[:-1], n), x.g_edges, "<i8"),
                 lists(x.b_at + 1 - np.repeat(x.b_edges[:-1], n), x.g_edges, "<i8"), lists(x.ends, x.g_edges, "<i8")], names=["doc_id", "a_ids", "b_ids", "a_stops", "b_stops", "ends"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, a_ids array<int>, b_ids array<int>, a_stops array<bigint>, b_stops array<bigint>, "
             "ends array<bigint>")


_NAMES = ["doc_id", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "times"]


def _chunked(a_path: str, b_path: str):
    """Per document its counts and its links as places in its chunk's pair list; per chunk one row with that list."""
    def close(chunk: int, ids: list, counts: list, digests: list, keys: list):
        n_docs = sum(len(c[0]) for c in counts)
        n_a, n_b, n_groups = (np.concatenate([c[k] for c in counts]) for k in range(3))
        pairs, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        of, many = np.unique(np.repeat(np.arange(n_docs), n_groups) << 32 | place, return_counts=True)
        edges = np.searchsorted(of >> 32, np.arange(n_docs + 1))
        step, many = np.diff(of & 0xFFFFFFFF, prepend=0), many.astype("<u4")
        begin = edges[:-1][np.diff(edges) > 0]
        step[begin] = (of & 0xFFFFFFFF)[begin]  # the first place of a document is itself, the next ones are differences
        step = step.astype("<u4")
        blobs = [zlib.compress(step[s:e].tobytes() + many[s:e].tobytes(), 1) for s, e in zip(edges.tolist(), edges[1:].tolist())]
        long, none = pa.int64(), pa.nulls
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array(np.full(n_docs, chunk)), pa.array(n_a), pa.array(n_b), pa.array(n_groups),
             pa.array(n_groups), pa.array(digests, type=pa.string()), pa.array(blobs, type=pa.binary()),
             none(n_docs, pa.list_(long)), none(n_docs, pa.list_(long))], names=_NAMES)
        yield pa.RecordBatch.from_arrays(
            [none(1, ids[0].type), pa.array([chunk]), *(none(1, long) for _ in range(4)), none(1, pa.string()), none(1, pa.binary()),
             pa.array([pairs], type=pa.list_(long)), pa.array([times], type=pa.list_(long))], names=_NAMES)

    def run(batches):
        chunk, size = TaskContext.get().partitionId() << 32, 0
        ids, counts, digests, keys = [], [], [], []
        for b in sized_blocks(batches, BLOCK_BYTES):
            x = Alignment(b["text"], a_path, b_path)
            raw, edges = x.written()
            raw = memoryview(raw)
            digests += [hashlib.sha256(raw[s:e]).hexdigest() if e > s else "" for s, e in zip(edges.tolist(), edges[1:].tolist())]
            ids.append(b["doc_id"])
            counts.append((np.diff(x.a_edges), np.diff(x.b_edges), np.diff(x.g_edges)))
            keys.append(x.a_ids[x.a_at].astype(np.int64) << 32 | x.b_ids[x.b_at])
            size += 4 * len(x.a_ids)
            if size >= CHUNK_BYTES:
                yield from close(chunk, ids, counts, digests, keys)
                chunk, size = chunk + 1, 0
                ids, counts, digests, keys = [], [], [], []
        if ids:
            yield from close(chunk, ids, counts, digests, keys)
    return run


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The sums of a chunk's documents over their links, from its pairs' totals."""
    place = pairs["place"].to_numpy()
    total, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
    total[place], best[place] = pairs["total"].to_numpy(), pairs["best"].to_numpy()
    n_best, count_sum = [], []
    for blob in docs["links"].to_pylist():
        step, many = np.frombuffer(zlib.decompress(blob), dtype="<u4").astype(np.int64).reshape(2, -1)
        at = np.cumsum(step)
        n_best.append(int(many[best[at] > 0].sum()))
        count_sum.append(int((many * total[at]).sum()))
    return docs.drop_columns(["links"]).append_column("n_best", pa.array(n_best, type=pa.int64())).append_column(
        "count_sum", pa.array(count_sum, type=pa.int64()))


def alignment_report(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_MODEL) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)`` of every row of ``(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = write_shared(docs.select("doc_id", "text").mapInArrow(
        _chunked(a_path, b_path),
        f"doc_id {kind}, chunk bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "links binary, pairs array<bigint>, times array<bigint>"), "alignments")
    held = table.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "p")).select(
        "chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    totals = write_shared(held.groupBy("pair").agg(F.sum("times").alias("total")), "pair-totals")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("highest"))  # a row an id of the vocabulary
    judged = (totals.withColumn("b", b_id).join(F.broadcast(highest), F.col("b") == F.col("b_id"))
              .select(F.col("pair").alias("known"), "total", (F.col("total") == F.col("highest")).cast("long").alias("best")))
    answers = held.join(judged, F.col("pair") == F.col("known")).select(
        F.col("chunk").alias("home"), "place", "total", "best")
    rows = table.where("pairs IS NULL").select("doc_id", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    return rows.groupBy("chunk").cogroup(answers.groupBy("home")).applyInArrow(
        _scored, f"doc_id {kind}, chunk bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                 "n_best bigint, count_sum bigint").drop("chunk")


def op13_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of every document in the two vocabularies."""
    return alignment_report(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op13_galloping_alignment": op13_galloping_alignment}
ORACLES: dict[str, str] = {}
