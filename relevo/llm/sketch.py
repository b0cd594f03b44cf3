"""Document fingerprints (operator 8): threshold-scaled sketches.

A sketch keeps every word-shingle hash below a fixed fraction of the hash
range, so sketches of any two texts are samples of one hash range: their
union is the sketch of the joined texts, and containment can be estimated
between texts of very unequal length. Where no hash is below the threshold
the smallest one is kept, so that only texts without words have an empty
sketch; a merge drops such a stand-in as soon as a hash below is there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.llm.common import read
from relevo.llm.hashing import window_hashes, word_hashes
from relevo.llm.tokens import text_blocks

#: Shingles of five words; one hash in FRACTION is kept; hashes have BITS bits.
SHINGLE, FRACTION, BITS = 5, 4, 48
LIMIT = (1 << BITS) // FRACTION
#: Documents of a sorted range and the most ranges (the larger of large tables hold more documents); tasks
#: stream over ranges, so these only set how evenly they are dealt and what the driver holds.
ROWS_PER_SHARD, MAX_SHARDS = 2000, 8192


def sketch(text: str | None, shingle: int = SHINGLE, limit: int = LIMIT) -> np.ndarray:
    """Ascending distinct kept hashes of a text; a null or wordless text has none."""
    h = np.unique(window_hashes(word_hashes(text), shingle) >> np.uint64(64 - BITS))
    kept = h[:np.searchsorted(h, limit)]
    return kept if len(kept) else h[:1]


def merge(a: np.ndarray, b: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The sketch of two texts taken together (windows across their border aside)."""
    both = np.union1d(a, b)
    below = both[both < limit]
    return below if len(below) else both[:1]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles that are in the second."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def fingerprint(s: np.ndarray) -> str:
    """The sketch as text: 12 hexadecimal digits a hash, ascending."""
    return s.astype(">u8").tobytes().hex() if not len(s) else "".join(x[4:] for x in np.char.mod("%016x", s))


def parse(text: str) -> np.ndarray:
    return np.array([int(text[i:i + BITS // 4], 16) for i in range(0, len(text), BITS // 4)], dtype=np.uint64)


def _follow(docs: DataFrame, rows_per_shard: int) -> DataFrame:
    """``docs`` (``key``, ``rid``, ...) in shards of consecutive ``(key, rid)``, each sorted, with the row that
    follows a shard repeated at its end (``ahead``); the first row of all follows the last.

    A key that spans several shards is cut between them by ``rid``. The shards' bounds and first rows' numbers
    reach the driver: some bytes for each of at most ``MAX_SHARDS`` shards, whatever the input.
    """
    k = min(max(1, docs.count() // rows_per_shard), MAX_SHARDS)
    shares = [i / k for i in range(1, k)]
    cuts = docs.approxQuantile("key", shares, 0.2 / k) if k > 1 else []
    bounds = np.sort(np.array(cuts, dtype=np.int64))
    again = np.unique(bounds[1:][bounds[1:] == bounds[:-1]])
    inner = docs.where(F.col("key").isin(again.tolist())).approxQuantile("rid", shares, 0.2 / k) if len(again) else []
    rid_bounds = np.sort(np.array(inner, dtype=np.int64))

    @F.pandas_udf("int")
    def shard_of(key: pd.Series, rid: pd.Series) -> pd.Series:
        left, right = (np.searchsorted(bounds, key.to_numpy(), side=side) for side in ("left", "right"))
        share = np.searchsorted(rid_bounds, rid.to_numpy(), side="right") * (right - left) // (len(rid_bounds) + 1)
        return pd.Series(np.where(right - left > 1, left + 1 + share, right), dtype="int32")

    numbered = docs.withColumn("shard", shard_of("key", "rid"))
    firsts = numbered.select("shard", "key", "rid").groupBy("shard").agg(F.min(F.struct("key", "rid")).alias("f")).collect()
    order = sorted((r["shard"], r["f"]["rid"]) for r in firsts)
    before = {rid: order[i - 1][0] for i, (_, rid) in enumerate(order)}
    first_rids = np.array(sorted(before), dtype=np.int64)
    first_shards = np.array([before[r] for r in first_rids.tolist()], dtype=np.int64)

    @F.pandas_udf("int")
    def shown_to(rid: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(first_rids, rid.to_numpy()), len(first_rids) - 1)
        hit = first_rids[at] == rid.to_numpy()
        return pd.Series(np.where(hit, first_shards[at], -1), dtype="int32")

    places = F.array(F.struct(F.col("shard"), F.lit(False).alias("ahead")),
                     F.struct(shown_to("rid").alias("shard"), F.lit(True).alias("ahead")))
    return (numbered.withColumn("p", F.explode(F.filter(places, lambda p: p["shard"] >= 0)))
            .withColumns({"shard": F.col("p.shard"), "ahead": F.col("p.ahead")}).drop("p")
            .repartition("shard").sortWithinPartitions("shard", "ahead", "key", "rid"))


def _compare(batches):
    def rows():
        for b in text_blocks(batches):
            yield from zip(*(b[c].to_pylist() for c in ("shard", "ahead", "doc_id", "text")))

    def out(done):
        ids, n, sha, f, fe, near, nxt, cont = zip(*done)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, type=pa.int64()), pa.array(n, type=pa.int64()), pa.array(sha), pa.array(f), pa.array(fe),
             pa.array(near), pa.array(nxt), pa.array(cont)],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                   "kept_share"])

    done, last = [], None
    for shard, ahead, doc_id, text in rows():
        text = text or ""
        now = (shard, ahead, doc_id, text, sketch(text))
        if last and last[0] == shard and not last[1]:
            cut = len(last[3]) // 4
            edited = last[3][:len(last[3]) - cut] + text[:cut]
            e = sketch(edited)
            done.append((last[2], len(last[3]), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(last[4]),
                         fingerprint(e), resemblance(last[4], e), resemblance(last[4], now[4]), containment(last[4], e)))
        last = now
        if len(done) >= 256:
            yield out(done)
            done = []
    if done:
        yield out(done)


def compare_edits(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Fingerprints of each text of ``(doc_id, text)`` and of its edit by the next document.

    A null text is empty; null ids come first; rows that repeat an id follow
    each other in the order they are read. A single document follows itself.
    """
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("key"),
                        F.monotonically_increasing_id().alias("rid"))
    return _follow(keyed, rows_per_shard).select("shard", "ahead", "doc_id", "text").mapInArrow(
        _compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                  "near_edited double, near_next double, kept_share double")


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document; ``kept_share`` is the estimated
    containment of the text in its edit."""
    return compare_edits(read(spark, sf_dir, "documents"))


QUERIES = {"op8_scaled_sketch": op8_scaled_sketch}
ORACLES: dict[str, str] = {}
