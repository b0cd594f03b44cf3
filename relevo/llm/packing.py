"""Best-fit packing (operator 4) after Martello-Toth dominance reduction.

Only document lengths matter to a packing, and there are at most ``capacity``
different ones, so the packing is found on their counts: a table whose size
does not depend on the corpus. The reduction first fixes sets that dominate
every alternative for a document (alone where nothing fits beside it; with its
exact complement; with the largest fitting partner where no pair or triple can
do better). The rest is packed best-fit in decreasing length. The outcome, a
list of patterns with multiplicities, is turned into slots, and every piece
finds its slot by its rank among the pieces of its length. Ranks are counted
in salted groups, so a length that a third of all pieces have is spread out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevo.llm.common import read
from relevo.llm.tokens import BYTE_BPE, ENCODE_BYTES, ENCODE_UNITS, byte_bpe, sized_blocks
from relevo.session import write_shared

CAPACITY, END_ID = 1024, 2
SALT = 64

Patterns = list[tuple[tuple[int, ...], int]]


def _best_pair(sizes: list[int], counts: Counter, room: int) -> int:
    """Largest sum of two available sizes within ``room``; 0 where none fits. ``sizes`` ascend."""
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        s = sizes[i] + sizes[j]
        if s > room:
            j -= 1
        elif i == j:
            return max(best, s) if counts[sizes[i]] > 1 else best
        else:
            best, i = max(best, s), i + 1
    return best


def reduce_dominated(counts: Counter, capacity: int) -> tuple[Patterns, Counter]:
    """Sets fixed by dominance, and what is left. ``counts``: length -> documents.

    A set that holds j dominates every other set with j when the others'
    documents beside j can all be exchanged for its own. Passes run from the
    longest length down until one fixes nothing.
    """
    left, fixed, changed = Counter({s: n for s, n in counts.items() if n > 0}), [], True
    while changed:
        changed = False
        for s in sorted(left, reverse=True):
            while (n := left[s]) > 0:
                left[s] -= 1  # j itself
                sizes = sorted(x for x, c in left.items() if c > 0)
                room = capacity - s
                small = [x for x in sizes for _ in range(min(3, left[x]))][:3]
                at = bisect_left(sizes, room + 1)
                partner = sizes[at - 1] if at else None
                left[s] += 1
                if partner is None:
                    times, chosen = n, (s,)
                elif (partner == room or sum(small[:2]) > room or len(small) < 2
                      or ((len(small) < 3 or sum(small) > room)
                          and partner >= _best_pair(sizes, left - Counter({s: 1}), room))):
                    # all at once: fewer documents only weaken the alternatives, so the same set stays dominant
                    times = n // 2 if partner == s else min(n, left[partner])
                    chosen = (s, partner)
                else:
                    break
                fixed.append((chosen, times))
                for x in chosen:
                    left[x] -= times
                changed = True
            if left[s] <= 0:
                del left[s]
    return fixed, +left


def best_fit(counts: Counter, capacity: int) -> Patterns:
    """Best-fit decreasing over lengths with multiplicities."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, how many]
    rooms: list[int] = []
    done: Patterns = []

    def put(pattern: tuple, room: int, times: int) -> None:
        if not room:
            done.append((pattern, times))
            return
        if not open_bins[room]:
            insort(rooms, room)
        open_bins[room].append([pattern, times])

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n > 0:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                per = capacity // s
                for k, times in ((per, n // per), (n % per, 1 if n % per else 0)):
                    if times:
                        put((s,) * k, capacity - s * k, times)
                break
            room = rooms[at]
            entry = open_bins[room][-1]
            times = min(n, entry[1])
            entry[1] -= times
            if not entry[1]:
                open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(at)
            put(entry[0] + (s,), room - s, times)
            n -= times
    return done + [(p, t) for room in rooms for p, t in open_bins[room]]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> Patterns:
    """``(lengths of one sequence, how many such sequences)`` for documents of the counted lengths."""
    fixed, rest = reduce_dominated(Counter(counts), capacity)
    merged: Counter = Counter()
    for p, n in fixed + best_fit(rest, capacity):
        merged[p] += n
    return sorted(merged.items(), reverse=True)


def _cut(path: str, end_id: int, capacity: int):
    def run(batches):
        for b in sized_blocks(batches, ENCODE_BYTES):
            ids, edges = byte_bpe(path, cache_units=ENCODE_UNITS).encode(b["text"])
            n = np.diff(edges) + 1  # with the end id
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = ((n - 1) % capacity + 1)[row]
            start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
            stop = first + piece * capacity
            ended = np.insert(ids, edges[1:], np.uint32(end_id)).astype("<u4", copy=False)
            at = memoryview(ended).cast("B")
            base = 4 * (edges[:-1] + np.arange(len(n)))[row]
            crc = [zlib.crc32(at[s:e]) for s, e in zip((base + 4 * start).tolist(), (base + 4 * stop).tolist())]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(stop - start),
                 pa.array(crc, type=pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def cut_pieces(docs: DataFrame, tokenizer: str = BYTE_BPE, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: documents of more than ``capacity`` ids in pieces, the first the shortest."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _cut(tokenizer, end_id, capacity),
        f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: as few sequences of at most ``capacity`` as the method finds.

    ``length`` must be 1 to ``capacity``. Rows that repeat a piece each get a
    place. A piece of ``capacity`` fills a sequence of its own, numbered by its
    row; other lengths with many pieces are ranked in salted groups.
    """
    spark = pieces.sparkSession
    rest = pieces.where(F.col("length") < capacity)
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    salt = F.pmod(F.xxhash64(*order), F.lit(SALT))
    counted = rest.groupBy("length", salt.alias("salt")).agg(F.count("*").alias("n"))
    groups = counted.collect()  # at most capacity x SALT rows
    sizes: Counter = Counter()
    base = []
    for length, s, n in sorted(groups):
        base.append((length, s, sizes[length]))
        sizes[length] += n
    taken: Counter = Counter()
    slots, at = [], 0
    for pattern, times in pack_counts(sizes, capacity):
        offset = 0
        for length in pattern:
            slots.append((length, taken[length], taken[length] + times, at, offset))
            taken[length] += times
            offset += length
        at += times
    bases = F.broadcast(spark.createDataFrame(base, "length_ bigint, salt_ bigint, base bigint"))
    plan = F.broadcast(spark.createDataFrame(
        slots, "length_ bigint, first bigint, stop bigint, sequence bigint, offset bigint"))
    w = Window.partitionBy("length", "salt").orderBy(*order)
    ranked = (rest.withColumn("salt", salt).withColumn("k", F.row_number().over(w) - 1)
              .join(bases, (F.col("length") == F.col("length_")) & (F.col("salt") == F.col("salt_")))
              .withColumn("k", F.col("k") + F.col("base")).drop("length_", "salt_", "base", "salt"))
    placed = ranked.join(plan, (F.col("length") == F.col("length_")) & (F.col("k") >= F.col("first"))
                         & (F.col("k") < F.col("stop")))
    full = pieces.where(F.col("length") == capacity).select(
        *pieces.columns, (F.lit(at) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.select(*pieces.columns, (F.col("sequence") + F.col("k") - F.col("first")).alias("sequence_id"),
                         "offset").union(full)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids; the pieces are written once, packing reads their lengths."""
    return pack_documents(read(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces of ``(doc_id, text)`` with their places. A null text is the end id alone; an empty table gives no row."""
    return pack(write_shared(cut_pieces(docs), "pieces"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
