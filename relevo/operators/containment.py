"""Exact passage containment: which documents contain a passage verbatim.

Used to derive judged relevance (qrels) from benchmark passages embedded in
documents. All passages are looked for at once: an Aho-Corasick automaton
over them reads each document one time, where the document is, and reports
every passage that ends at a character, nested and overlapping ones too. So
no text is shuffled and a passage that most documents hold costs its hits
only. The passages are cut into blocks of bounded size, with an automaton
for each, so what a task is sent and holds does not grow with their number.
Hits are ``(document, passage key)`` and meet the passage ids by key.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.operators.util import spread
from relevo.session import write_shared
from relevo.sources import tables as T

#: Characters of the passages of one automaton (a longer passage has one of its own).
BLOCK_CHARS = 1_000_000
#: The automaton of the last block a Python worker met.
_built: dict[str, object] = {}


def _key(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def _automaton(name: str, texts: list[str]):
    if name not in _built:
        import ahocorasick

        made = ahocorasick.Automaton()
        for t in texts:
            made.add_word(t, _key(t))
        made.make_automaton()
        _built.clear()
        _built[name] = made
    return _built[name]


def _scan(texts: list[str]):
    """Distinct passages of every document: ``(doc_id, key)``."""
    name = uuid.uuid4().hex

    def run(batches):
        found = _automaton(name, texts)
        for b in batches:
            rows, keys = [], []
            for row, text in enumerate(b["text"].to_pylist()):
                hits = {key for _, key in found.iter(text)} if text else ()
                rows += [row] * len(hits)
                keys += hits
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(rows, type=pa.int64())), pa.array(keys, type=pa.string())],
                                             names=["doc_id", "key"])
    return run


def containment_pairs(passages: DataFrame, docs: DataFrame, pid: str = "pid", ptext: str = "ptext",
                      did: str = "doc_id", dtext: str = "text") -> DataFrame:
    """``(pid, doc_id)`` for every document row whose text contains the passage text.

    NULL and empty passages are in no document; NULL and empty texts hold none.
    """
    p = write_shared(passages.select(F.col(pid).alias("pid"), F.col(ptext).alias("ptext")).where(F.length("ptext") > 0)
                     .withColumn("key", F.substring(F.sha2("ptext", 256), 1, 32)), "passages")
    unique = p.select("key", "ptext").dropDuplicates(["key"])
    blocks = -(-(unique.agg(F.sum(F.length("ptext"))).first()[0] or 0) // BLOCK_CHARS)
    kind = docs.schema[did].dataType.simpleString()
    texts = spread(docs.select(F.col(did).alias("doc_id"), F.col(dtext).alias("text")), "doc_id")
    hits = []
    for block in range(max(1, blocks)):
        mine = unique if blocks <= 1 else unique.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        held = [r["ptext"] for r in mine.select("ptext").collect()]  # bounded by the block
        if held:
            hits.append(texts.mapInArrow(_scan(held), f"doc_id {kind}, key string"))
    if not hits:
        return texts.join(p, F.lit(False)).select("pid", "doc_id")
    return reduce(DataFrame.union, hits).join(p.select("pid", "key"), "key").select("pid", "doc_id")


def qrels_by_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pairs ``(query_id, doc_id, rel=1)``: documents containing a benchmark passage."""
    bench = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), F.col("text").alias("ptext"))
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = containment_pairs(bench, docs)
    return pairs.select(F.col("pid").alias("query_id"), "doc_id", F.lit(1).alias("rel"))
