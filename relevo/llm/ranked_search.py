"""Ranked lexical search (operator 11): best-first search with range maxima over posting lists.

All documents are ranked for a table of queries by a BM25-like sum of integers.

1. Postings. Documents are tokenised where they are read and dealt to shards of
   a bounded number of documents, ordered by id. A shard keeps the posting
   lists of the queries' terms (places of documents, occurrences) and every
   document's length: one row, written once.
2. Statistics. The documents, their terms and each query term's documents are
   summed over the shards.
3. Search. For each shard the impacts (the part of a document's score that
   does not depend on the term's weight) of every posting list get a sparse
   table of range maxima. A query starts with the interval of all documents
   of the shard. The answers of its lists' range-maximum queries, weighted
   and summed, bound every score in an interval. The intervals with the
   highest bounds are taken, ``BATCH`` at a time, and each is split at the
   document with the largest single weighted impact: that document is scored,
   the parts before and after it are bounded and kept if they can still hold
   one of the best ``k``. The search ends when no interval can.
4. The shards' best are merged: ``k`` rows a query and task reach the shuffle.

Nothing is cut off: the result is that of scoring every document. Queries are
taken in blocks of ``BLOCK_TERMS`` (query, term) pairs, so what the tasks are
sent (terms, weights) is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevo.llm.common import ascii_lower, read
from relevo.llm.tokens import sized_blocks, utf8
from relevo.session import write_shared

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a shard; intervals split at a time; (query, term) pairs of a block of queries.
SHARD_DOCS, BATCH, BLOCK_TERMS = 16_384, 64, 200_000
#: The weight of a document's length in percent, and the scale of the impacts.
LENGTH_PERCENT = 50


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte belongs to a term, and the byte with A-Z lower-cased."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    term = np.arange(256) >= 0x80
    term[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    return term, lower


_IS_TERM, _LOWER = _byte_tables()


def term_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, one after another, and the edges of each text's; a null text has none."""
    data, edges = utf8(texts)
    held = _IS_TERM[data]
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    first = edges[:-1][np.diff(edges) > 0]
    begins[first] = held[first]
    at = np.flatnonzero(begins)
    place = np.concatenate([[0], np.cumsum(held)])
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [
        None, pa.py_buffer(np.append(place[at], place[-1]).astype(np.int64)), pa.py_buffer(_LOWER[data[held]])])
    return terms, np.searchsorted(at, edges)


def _posting_shards(vocabulary: dict[bytes, int], shard_docs: int):
    """One row a shard: ids and lengths of its documents, and the posting lists of the vocabulary's terms."""
    def close(ids: list, lengths: list, keys: list) -> pa.RecordBatch:
        ids, n = pa.concat_arrays(ids), np.concatenate(lengths)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        keys = np.concatenate(keys)
        found, tf = np.unique(keys >> 32 << 32 | rank[keys & 0xFFFFFFFF], return_counts=True)
        terms, begin = np.unique(found >> 32, return_index=True)
        one = lambda values, kind: pa.array([values], type=pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], type=pa.int32()), ids.take(pa.array(order))), one(n[order], pa.int64()),
             one(terms, pa.int32()), one(np.diff(np.append(begin, len(found))), pa.int64()),
             one(found & 0xFFFFFFFF, pa.int32()), one(tf, pa.int64()), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])],
            names=["ids", "lengths", "terms", "sizes", "places", "tf", "n_docs", "n_terms"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        ids, lengths, keys, held = [], [], [], 0
        for whole in sized_blocks(batches):
            for at in range(0, whole.num_rows, shard_docs):
                b = whole.slice(at, shard_docs)
                if held + b.num_rows > shard_docs:
                    yield close(ids, lengths, keys)
                    ids, lengths, keys, held = [], [], [], 0
                terms, edges = term_runs(b["text"])
                coded = terms.dictionary_encode()
                known = np.array([vocabulary.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)
                term = known[coded.indices.to_numpy()] if len(terms) else np.zeros(0, dtype=np.int64)
                doc = np.repeat(np.arange(held, held + b.num_rows), np.diff(edges))
                ids.append(b["doc_id"])
                lengths.append(np.diff(edges))
                keys.append((term << 32 | doc)[term >= 0])
                held += b.num_rows
        if held:
            yield close(ids, lengths, keys)
    return run


class Shard:
    """Posting lists with range maxima. ``places`` ascend in each list (``starts[i]:starts[i] + sizes[i]``)."""

    def __init__(self, places: np.ndarray, impacts: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.places, self.impacts, self.starts, self.sizes = places, impacts, starts, sizes
        # level j: place of the largest impact (the first of them) among 2^j postings; windows across two lists are never asked for
        level = np.arange(len(places), dtype=np.int32)
        self.levels = [level]
        width = 1
        while len(sizes) and width * 2 <= int(sizes.max()):
            a, b = level[:-width], level[width:]
            level = np.where(impacts[a] >= impacts[b], a, b)
            self.levels.append(level)
            width *= 2
        self.table = np.zeros((len(self.levels), len(places)), dtype=np.int32)
        for j, level in enumerate(self.levels):
            self.table[j, :len(level)] = level
        del self.levels
        self.log = np.zeros(int(sizes.max(initial=0)) + 1, dtype=np.int64)
        for n in range(2, len(self.log)):
            self.log[n] = self.log[n >> 1] + 1

    def bounds(self, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For intervals (rows) given by each list's range (columns): bound of a score, and the document to split at."""
        filled = low < high
        low, high = np.where(filled, low, 0), np.where(filled, high, 1)
        j = self.log[high - low]
        a, b = self.table[j, low], self.table[j, high - (1 << j)]
        best = np.where(self.impacts[a] >= self.impacts[b], a, b)
        value = np.where(filled, self.impacts[best] * weights, 0)
        top = value.argmax(axis=1)
        return value.sum(axis=1), self.places[best[np.arange(len(top)), top]]

    def find(self, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """First posting in each range that is not before the row's document."""
        low, high = low.copy(), high.copy()
        doc = np.broadcast_to(doc[:, None], low.shape)
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            less = open_ & (self.places[np.where(open_, middle, 0)] < doc)
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    def search(self, lists: np.ndarray, weights: np.ndarray, k: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the best ``k`` documents with a score above 0, equal scores by place."""
        low, high = self.starts[lists][None, :], (self.starts + self.sizes)[lists][None, :]
        left = np.zeros(1, dtype=np.int64)
        bound, split = self.bounds(low, high, weights)
        scores, docs = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        while len(bound):
            take = np.argpartition(-bound, batch - 1)[:batch] if len(bound) > batch else np.arange(len(bound))
            rest = np.ones(len(bound), dtype=bool)
            rest[take] = False
            l, h, d = low[take], high[take], split[take]
            at = self.find(l, h, d)
            holds = at < h
            holds &= self.places[np.where(holds, at, 0)] == d[:, None]
            scored = (self.impacts[np.where(holds, at, 0)] * weights * holds).sum(axis=1)
            scores, docs = np.concatenate([scores, scored]), np.concatenate([docs, d])
            if len(scores) >= k:
                best = np.lexsort((docs, -scores))[:k]
                scores, docs = scores[best], docs[best]
            two_low, two_high = np.concatenate([l, at + holds]), np.concatenate([at, h])
            two_left = np.concatenate([left[take], d + 1])
            two_bound, two_split = self.bounds(two_low, two_high, weights)
            least, last = (scores[-1], docs[-1]) if len(scores) == k else (0, -1)
            bound, left, split = (np.concatenate([x[rest], y]) for x, y in ((bound, two_bound), (left, two_left), (split, two_split)))
            can = (bound > least) | ((bound == least) & (bound > 0) & (left < last))
            low, high = (np.concatenate([x[rest], y])[can] for x, y in ((low, two_low), (high, two_high)))
            bound, left, split = bound[can], left[can], split[can]
        order = np.lexsort((docs, -scores))
        order = order[scores[order] > 0]
        return scores[order], docs[order]


def _search(queries: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The best ``k`` of each shard for every query; ``weights`` by term number."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                column = lambda name: b[name][row].values.to_numpy(zero_copy_only=False)
                terms, sizes, places, tf, lengths = (column(c) for c in ("terms", "sizes", "places", "tf", "lengths"))
                list_of = np.full(len(weights), -1, dtype=np.int64)
                list_of[terms] = np.arange(len(terms))
                m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * lengths * n_docs // max(1, n_terms)
                impacts = 1_000_000_000 * tf // (1000 * tf + 20 * m[places])
                shard = Shard(places.astype(np.int64), impacts, np.cumsum(sizes) - sizes, sizes)
                found = [], [], []
                for number, of in queries:
                    held = of[(list_of[of] >= 0) & (weights[of] > 0)]
                    if len(held):
                        scores, docs = shard.search(list_of[held], weights[held], k)
                        for out, x in zip(found, (np.full(len(docs), number), docs, scores)):
                            out.append(x)
                number, docs, scores = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in found)
                yield pa.RecordBatch.from_arrays([pa.array(number), b["ids"][row].values.take(pa.array(docs)), pa.array(scores)],
                                                 names=["number", "doc_id", "score"])
    return run


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _rank_block(docs: DataFrame, pairs: list[tuple[int, str]], k: int) -> DataFrame:
    """``(number, doc_id, score)``: the best of each shard for queries given as (number, term) pairs."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in pairs}))}
    of: dict[int, list[int]] = {}
    for number, term in pairs:
        of.setdefault(number, []).append(vocabulary[term])
    queries = [(number, np.array(sorted(set(terms)), dtype=np.int64)) for number, terms in sorted(of.items())]
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = write_shared(docs.select("doc_id", "text").mapInArrow(
        _posting_shards({t.encode(): i for t, i in vocabulary.items()}, SHARD_DOCS),
        f"ids array<{kind}>, lengths array<bigint>, terms array<int>, sizes array<bigint>, places array<int>, tf array<bigint>, "
        "n_docs bigint, n_terms bigint"), "posting-shards")
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    df = (shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x"))
          .groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("df")))
    for term, n in df.collect():  # a row a query term
        weights[term] = term_weight(n_docs, n)
    return shards.mapInArrow(_search(queries, weights, n_docs, n_terms, k), f"number bigint, doc_id {kind}, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best of ``(doc_id, text)`` for every row of ``(item_id, text)``.

    Scores above 0 only, the highest first, equal ones by ascending id (null
    last). Null texts, and texts without terms, find nothing and are found by nothing;
    a row that repeats an item is a query of its own with the same result, rows that repeat a
    document are ranked each. Empty tables give no row. Other columns are ignored.
    """
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower("text"), F.lit(TERM), F.lit(0)))
    asked = write_shared(items.where("text IS NOT NULL").select(
        F.monotonically_increasing_id().alias("number"), "item_id", terms.alias("terms")), "queries")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    parts = []
    for block in range(blocks):  # one, unless the queries have more terms than a block takes
        mine = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block)
        pairs = [tuple(r) for r in mine.select("number", F.explode("terms")).collect()]  # bounded by the block
        parts.append(_rank_block(docs, pairs, k))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    w = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(asked.select(F.col("number").alias("asked"), "item_id"), F.col("number") == F.col("asked")).select(
        "item_id", "rank", "doc_id", "score")


def op11_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_SQL = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '{TERM}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
stat AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '{TERM}')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
      FROM tf, stat WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
s AS (SELECT q.item_id, tf.doc_id,
             sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * len.n * stat.docs) // stat.terms))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN len ON len.doc_id = tf.doc_id, stat GROUP BY q.item_id, tf.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 50
"""

QUERIES = {"op11_range_maximum_search": op11_range_maximum_search}
ORACLES = {"op11_range_maximum_search": _SQL}
