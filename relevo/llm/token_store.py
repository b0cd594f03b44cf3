"""Token-ID output (operator 5): token lists in Parquet with selective reads.

Documents are range-partitioned and sorted by id, tokenised where they then
are, and written as one Parquet file per shard: ``tokens`` a dictionary-encoded
list column, ids and counts delta-encoded, row groups and pages of set sizes,
with page indexes. Counts and offsets can be read without touching tokens,
and the sorted ids let row groups and pages be skipped.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevo.llm.common import read
from relevo.llm.tokens import BYTE_BPE, ENCODE_BYTES, ENCODE_UNITS, byte_bpe, sized_blocks
from relevo.session import shared_path

#: Bytes of a row group and of a page, and rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 1000
END_ID = 0


def _tokenise(path: str, end_id: int):
    def run(batches):
        shard, at = TaskContext.get().partitionId(), 0
        for b in sized_blocks(batches, ENCODE_BYTES):
            ids, edges = byte_bpe(path, cache_units=ENCODE_UNITS).encode(b["text"])
            offsets = edges + np.arange(len(edges))
            flat = np.insert(ids, edges[1:], np.uint32(end_id)).astype("<u4", copy=False)
            yield pa.RecordBatch.from_arrays([
                b["doc_id"], pa.array(np.full(b.num_rows, shard, dtype=np.int32)), pa.array(np.diff(offsets)),
                pa.array(at + offsets[:-1]), pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat.view("<i4")))],
                names=["doc_id", "shard", "n_tokens", "shard_start", "tokens"])
            at += int(offsets[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int = END_ID) -> None:
    """Token files of ``(doc_id, text)`` in ascending ``doc_id`` order under ``path``.

    A null text is empty (the end id alone); null ids come first; rows that
    repeat an id are written each, in the order they are read.
    """
    ordered = (docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
               .repartitionByRange("doc_id", "rid").sortWithinPartitions("doc_id", "rid").drop("rid"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    tokens = ordered.mapInArrow(_tokenise(tokenizer, end_id), f"doc_id {id_type}, shard int, n_tokens bigint, "
                                                              "shard_start bigint, tokens array<int>")
    options = {"compression": "snappy", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE,
               "parquet.page.row.count.limit": PAGE_ROWS, "parquet.writer.version": "v2",
               "parquet.enable.dictionary": "true"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "n_tokens", "shard_start")}
    tokens.write.options(**options).parquet(path)


def document_starts(files: DataFrame) -> DataFrame:
    """``(shard, shard_at)``: tokens before each shard, from the counts alone (a row per file)."""
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select(F.col("shard").alias("shard_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_at"))


def _digest(batches):
    for b in batches:
        lists = b["tokens"]
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        flat, offsets = flat.astype("<u4", copy=False), offsets - offsets[0]
        crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["shard"], b["shard_start"], pa.array(np.diff(offsets).astype(np.int64)),
             pa.array(crc, type=pa.int64())], names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def read_digests(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every stored document, from the stored ids."""
    id_type = files.schema["doc_id"].dataType.simpleString()
    digests = files.select("doc_id", "shard", "shard_start", "tokens").mapInArrow(
        _digest, f"doc_id {id_type}, shard int, shard_start bigint, n_tokens bigint, ids_crc32 bigint")
    return digests.join(document_starts(files), F.col("shard") == F.col("shard_")).select(
        "doc_id", (F.col("shard_start") + F.col("shard_at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files and read back."""
    path = shared_path(spark, "tables", f"tokens-{uuid.uuid4().hex[:16]}")
    write_tokens(read(spark, sf_dir, "documents"), path)
    return read_digests(spark.read.parquet(path))


QUERIES = {"op5_token_store": op5_token_store}
ORACLES: dict[str, str] = {}
