"""N-gram Jaccard join (operator 9): prefix-tree join of word-shingle sets.

Two texts link when their sets of word shingles (``shingle`` words each) have a
Jaccard similarity of at least ``percent`` / 100. The steps:

1. Shingle frequencies. Texts are dealt into chunks; each chunk sends its
   sorted shingle keys, packed, to key-range buckets, and every bucket answers
   each chunk with those of its keys that other sets hold as well, and how
   often. (Keys are shortened hashes: a clash can only make a shingle look
   more frequent, which costs work and loses nothing.)
2. Candidates. A text with more shingles of its own than a similarity of
   ``percent`` allows to differ has no link: that settles most texts. The
   others' sets are ordered rarest first (one global order), and their
   prefixes, which must share a shingle with any linked set's, are indexed.
3. Blocks. Sets that share a prefix shingle, directly or through others, form
   a block. Each set goes to its block once.
4. Join. In a block, a prefix tree finds the links (:mod:`trie`): partial
   overlaps are shared along paths, and subtrees that cannot reach the
   required overlap are left. Only links that join two components are
   returned, so a group of near copies gives one link a member, not all pairs.
   A block too large for a task is cut into parts, and every pair of parts is
   one task.

Equal sets are one set throughout, so exact copies cost nothing in 2 to 4.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.llm.blocks import block_members, deal_blocks
from relevo.llm.common import fresh, read, text_key
from relevo.llm.components import components
from relevo.llm.hashing import window_hashes, word_hashes
from relevo.llm.trie import linked
from relevo.session import write_shared

#: What op9 asks for, and the defaults; the pipeline's stage has its own.
SHINGLE, PERCENT = 4, 85
#: Documents of a chunk, and set elements of the largest block part that one task takes.
CHUNK_DOCS, PART_ELEMENTS = 1500, 1_000_000


def _set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(window_hashes(word_hashes(text), shingle))


def _sid(hashes: np.ndarray) -> int:
    """Number of a set: 63 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little") >> 1


def _send_keys(bits: int, shingle: int):
    """A chunk's shingle keys by bucket: those of one set, and those of several with how many."""
    def run(chunk: pa.Table) -> pa.Table:
        sets = {_sid(s): s for s in (_set(t, shingle) for t in chunk["text"].to_pylist()) if len(s)}
        keys, n = np.unique(np.concatenate([*sets.values(), np.zeros(0, dtype=np.uint64)]) >> np.uint64(32 - bits),
                            return_counts=True)
        bucket, low = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)
        edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            k, c = low[edges[b]:edges[b + 1]], n[edges[b]:edges[b + 1]]
            rows.append((b, k[c == 1].tobytes(), k[c > 1].tobytes(), c[c > 1].astype("<u4").tobytes()))
        b, one, more, counts = zip(*rows) if rows else ((), (), (), ())
        first = chunk["chunk"][0].as_py()
        return pa.table({"bucket": pa.array(b, type=pa.int32()), "chunk": pa.array([first] * len(b), type=pa.int32()),
                         "one": pa.array(one, type=pa.binary()), "more": pa.array(more, type=pa.binary()),
                         "counts": pa.array(counts, type=pa.binary())})
    return run


def _count_keys(rows: pa.Table) -> pa.Table:
    """For each chunk its keys that two or more sets hold, with a frequency class."""
    one = [np.frombuffer(x, dtype="<u4") for x in rows["one"].to_pylist()]
    more = [np.frombuffer(x, dtype="<u4") for x in rows["more"].to_pylist()]
    counts = [np.frombuffer(x, dtype="<u4") for x in rows["counts"].to_pylist()]
    keys, inverse = np.unique(np.concatenate(one + more), return_inverse=True)
    df = np.bincount(inverse, weights=np.concatenate([np.ones(sum(map(len, one))), *counts]))
    level = np.minimum(255, 4 * np.log2(df)).astype(np.uint8)
    out = []
    at = np.concatenate([[0], np.cumsum([len(x) for x in one + more])])
    for i in range(len(one)):
        own = np.concatenate([inverse[at[j]:at[j + 1]] for j in (i, len(one) + i)])
        own = np.sort(own[df[own] > 1])
        out.append((keys[own].tobytes(), level[own].tobytes()))
    k, v = zip(*out)
    return pa.table({"bucket": rows["bucket"], "chunk": rows["chunk"], "keys": pa.array(k, type=pa.binary()),
                     "levels": pa.array(v, type=pa.binary())})


def _candidates(bits: int, shingle: int, percent: int):
    """A chunk's documents with their sets' numbers; a set that can have links with its elements and prefix."""
    def run(chunk: pa.Table, shared: pa.Table) -> pa.Table:
        order = np.argsort(shared["bucket"].to_numpy()) if shared.num_rows else []
        part = lambda name, kind: [np.frombuffer(shared[name][int(i)].as_py(), dtype=kind) for i in order]
        buckets = [int(shared["bucket"][int(i)].as_py()) for i in order]
        known = np.concatenate([*(k.astype(np.uint64) | np.uint64(b << 32) for b, k in zip(buckets, part("keys", "<u4"))),
                                np.zeros(0, dtype=np.uint64)])
        level = np.concatenate([*part("levels", np.uint8), np.zeros(0, dtype=np.uint8)])
        rows, seen = [], set()
        for text in chunk["text"].to_pylist():
            s = _set(text, shingle)
            sid = _sid(s) if len(s) else None
            if sid is None or sid in seen or not len(known):
                rows.append((len(s), sid, None, None))
                continue
            seen.add(sid)
            at = np.minimum(np.searchsorted(known, s >> np.uint64(32 - bits)), len(known) - 1)
            common = known[at] == s >> np.uint64(32 - bits)
            prefix = len(s) - -(-percent * len(s) // 100) + 1 - int(len(s) - common.sum())
            if prefix <= 0:
                rows.append((len(s), sid, None, None))
                continue
            held, rank = s[common], level[at[common]]
            tokens = held[np.lexsort((held, rank))][:prefix]
            rows.append((len(s), sid, s.tobytes(), tokens.view(np.int64)))
        n, sids, sets, tokens = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"doc_id": chunk["doc_id"], "key": chunk["key"], "n_shingles": pa.array(n, type=pa.int64()),
                         "sid": pa.array(sids, type=pa.int64()), "elements": pa.array(sets, type=pa.binary()),
                         "tokens": pa.array(tokens, type=pa.list_(pa.int64()))})
    return run


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, key, n_shingles, sid, elements, tokens)`` of every row of ``(doc_id, text)``, written once."""
    n_docs = docs.count()
    chunks = max(1, -(-n_docs // CHUNK_DOCS))
    bits = max(0, (chunks - 1).bit_length())  # as many key ranges as chunks
    id_type = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text", text_key(F.col("text")).alias("key")).select(
        "doc_id", "text", "key", F.pmod(F.xxhash64("doc_id", "key"), F.lit(chunks)).cast("int").alias("chunk"))
    sent = dealt.groupBy("chunk").applyInArrow(
        _send_keys(bits, shingle), "bucket int, chunk int, one binary, more binary, counts binary")
    answers = sent.groupBy("bucket").applyInArrow(_count_keys, "bucket int, chunk int, keys binary, levels binary")
    sets = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _candidates(bits, shingle, percent), f"doc_id {id_type}, key string, n_shingles bigint, sid bigint, elements binary, "
                           "tokens array<bigint>")
    return write_shared(sets, "shingle-sets")


def _join_part(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        sets = {i: np.frombuffer(e, dtype="<u8") for i, e in zip(rows["sid"].to_pylist(), rows["elements"].to_pylist())}
        ids = np.array(sorted(sets), dtype=np.int64)
        links = linked(ids, [sets[i] for i in ids.tolist()], percent)
        return pa.table({"a": pa.array([x for x, _ in links], type=pa.int64()),
                         "b": pa.array([y for _, y in links], type=pa.int64())})
    return run


def set_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(a, b)``: links between set numbers that make the same components as all links do.

    ``percent`` is at least what the sets' prefixes were made for."""
    unique = sets.where("tokens IS NOT NULL").select("sid", "n_shingles", "elements", "tokens")
    tokens = unique.select("sid", F.explode("tokens").alias("token")).distinct()
    first = tokens.groupBy("token").agg(F.min("sid").alias("first"), F.max("sid").alias("last")).where("first < last")
    sharing = tokens.join(first.select(F.col("token").alias("t"), "first"), F.col("token") == F.col("t"))
    member = block_members(sharing.select("sid", "first"), "sid", "first")
    items = unique.select("sid", "n_shingles", "elements").dropDuplicates(["sid"])
    dealt = deal_blocks(items, member, "sid", "n_shingles", PART_ELEMENTS)
    return dealt.groupBy("root", "pair").applyInArrow(_join_part(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, key, n_shingles, component_id, root)`` of every row of ``(doc_id, text)``.

    ``component_id`` is the smallest id reachable by links; ``key`` is the
    text's key and ``root`` the component's own number (null for texts without
    shingles). Null and wordless texts have no shingles and no links; texts
    of fewer than ``shingle`` words are one shingle; repeated rows are equal sets.
    Null ids are larger than none and smaller than no id: they never name a
    component that has another. An empty table gives no row.
    """
    sets = shingle_sets(docs, shingle, percent)
    root_of = write_shared(components(set_links(sets, percent)), "set-components")
    ids = sets.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"))
    labelled = ids.join(root_of, F.col("sid") == F.col("node"), "left").select(
        "sid", "least", F.coalesce("root", "sid").alias("root"))
    best = labelled.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    of_set = labelled.join(best, F.col("root") == F.col("r")).select(F.col("sid").alias("s"), "component_id", "root")
    # every set number is one row here, so a set that a third of all rows hold is only large on the left
    return (sets.select("doc_id", "key", "n_shingles", "sid").join(of_set, F.col("sid") == F.col("s"), "left")
            .select("doc_id", "key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near duplicates (the smallest id, then text key), all columns of ``docs``.

    Texts without words stay, and so do rows that repeat both id and text of a kept one.
    """
    d, k = fresh(docs, "llm_doc", "llm_key")
    found = near_duplicates(docs, shingle, percent)
    first = F.min(F.struct("doc_id", "key")).alias("first")
    kept = (found.where("root IS NOT NULL").groupBy("root").agg(first).select("first.doc_id", "first.key")
            .union(found.where("root IS NULL").select("doc_id", "key")).distinct()
            .select(F.col("doc_id").alias(d), F.col("key").alias(k)))
    return (docs.join(kept, F.col("doc_id").eqNullSafe(F.col(d)) & (text_key(F.col("text")) == F.col(k)))
            .select(*docs.columns))


def op9_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"), SHINGLE, PERCENT).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op9_prefix_tree_join": op9_prefix_tree_join}
ORACLES: dict[str, str] = {}
