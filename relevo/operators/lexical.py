"""Lexical retrieval for a whole table of queries.

Index: postings ``(doc_id, dl, term, tf)``. A document's tokens sit in one
row, so its term counts are run lengths of the sorted tokens: building the
postings needs no shuffle. When only a query batch has to be answered they
are restricted to the batch vocabulary by a semi-join.

Scoring is BM25 with Lucene's defaults (k1=1.2, b=0.75):
``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``,
``score = sum_t qtf * idf * tf / (tf + k1 * (1 - b + b * dl / avgdl))``.
Matching postings are partitioned by document once; scores are summed where
they then are, and only the top k per query and task are shuffled again.
Scores are rounded to 9 decimals before ranking so that summation order
cannot reorder ties; ties are broken by ``doc_id``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevo.functions.fixed import BM25_B, BM25_K1, K_RECALL
from relevo.functions.text import first_words, strip_tags
from relevo.operators.analysis import corpus_stats, token_array
from relevo.session import COMPRESSION, write_shared
from relevo.operators.util import let, spread, top_k

SCORE_DIGITS = 9
#: What rounding changes in a score at most.
ROUNDING = 10.0 ** -SCORE_DIGITS
#: (query, term) rows from which documents are scored in blocks, and the share by which a bound may be off through rounding.
PRUNE_FROM, SLACK = 20_000, 1e-9
#: Matching (query, term, document) rows that one task sums.
TASK_ROWS = 1_000_000
#: Postings of a block of documents that is scored for all queries of a large table at once.
BLOCK_POSTINGS = 2_000_000
#: Terms of a query vocabulary up to which it is sent to the tasks (about 20 MB), so that no token of another term is shuffled.
SENT_TERMS = 200_000


@dataclass
class LexicalIndex:
    """Postings plus corpus statistics for one text field."""

    postings: DataFrame  # (doc_id, dl, term, tf)
    stats: DataFrame     # one row: (n_docs, total_terms, avgdl)
    dfreq: DataFrame | None = None  # (term, df); derived from the postings when absent


def query_from_body(posts: DataFrame, id_col: str = "id", text_col: str = "body",
                    remove_tags: bool = True) -> DataFrame:
    """Query proxy: first 8 words of a post, tags stripped in evaluation mode (L1)."""
    text = strip_tags(F.col(text_col)) if remove_tags else F.col(text_col)
    return posts.select(F.col(id_col).alias("query_id"), first_words(text, 8).alias("query_text"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query_text",
                mode: str = "word") -> DataFrame:
    """``(query_id, term, qtf)``: analysed query terms with their in-query frequency."""
    return (queries.select(F.col(id_col).alias("query_id"),
                           F.explode(token_array(F.col(text_col), mode)).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def _runs(tokens):
    """``(term, tf)`` of each distinct token: run lengths of the sorted array."""
    def cut(t):
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(t, i).alias("term"),
            (F.coalesce(F.get(at, k + 1), F.size(t)) - i).cast("long").alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return let(F.array_sort(tokens), lambda t: F.when(F.size(t) > 0, cut(t)).otherwise(none))


def _term_rows(docs: DataFrame, id_col: str, text_col: str, mode: str, vocabulary: DataFrame | None) -> DataFrame:
    """``(doc_id, dl, term, tf)``: one row per (kept) distinct term plus one
    marker row per document (``term`` NULL) with its length, in one pass over the text; ``vocabulary`` has each term once."""
    text = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "doc_id")
    marker = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf")))
    toks = text.select("doc_id", let(token_array(F.col("_text"), mode), lambda t: F.struct(
        F.size(t).cast("long").alias("dl"), F.concat(_runs(t), marker).alias("runs"))).alias("_t"))
    rows = (toks.select("doc_id", F.col("_t.dl").alias("dl"), F.explode("_t.runs").alias("r"))
            .select("doc_id", "dl", F.col("r.term").alias("term"), F.col("r.tf").alias("tf")))
    if vocabulary is not None:
        vocab = vocabulary.select(F.col("term").alias("_known"))
        rows = rows.join(vocab, F.col("term") == F.col("_known"), "left").where(
            F.col("term").isNull() | F.col("_known").isNotNull()).drop("_known")
    return rows


def build_postings(docs: DataFrame, id_col: str = "id", text_col: str = "body", mode: str = "word",
                   vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings ``(doc_id, dl, term, tf)`` (L2), counted within each row.

    ``vocabulary`` (a ``term`` column) restricts the postings to those terms.
    """
    vocabulary = vocabulary.select("term").distinct() if vocabulary is not None else None
    return _term_rows(docs, id_col, text_col, mode, vocabulary).where(F.col("term").isNotNull())


def build_index(docs: DataFrame, id_col: str = "id", text_col: str = "body", mode: str = "word",
                vocabulary: DataFrame | None = None, materialize: bool = True) -> LexicalIndex:
    """Postings and corpus statistics from one pass over the documents.

    With ``materialize`` the rows are written as parquet to the shared
    checkpoint folder, so scoring, document frequencies and statistics all
    read the written postings (vectorised, column-pruned) instead of
    re-tokenising the corpus, and a lost executor does not send the job back
    to the raw text.
    """
    if vocabulary is not None:
        vocabulary = write_shared(vocabulary.select("term").distinct(), "vocabulary")
        vocabulary = F.broadcast(vocabulary) if vocabulary.count() <= SENT_TERMS else vocabulary
    rows = _term_rows(docs, id_col, text_col, mode, vocabulary)
    if materialize:
        rows = write_shared(rows, "postings")
    return LexicalIndex(rows.where(F.col("term").isNotNull()),
                        corpus_stats(rows.where(F.col("term").isNull()).select("dl")))


def _idf(qtf, n_docs, df):
    return qtf * F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _sum_scores(contrib: DataFrame) -> DataFrame:
    return contrib.groupBy("query_id", "doc_id").agg(
        F.round(F.sum("c"), SCORE_DIGITS).alias("score"), F.count(F.lit(1)).alias("matched"),
        F.max("nq").alias("n_query_terms"))


def _weights(qterms: DataFrame, index: LexicalIndex) -> DataFrame:
    """``(query_id, term, nq, df, w)``, written once, so Spark knows its size and broadcasts it only below its own threshold."""
    n_docs = index.stats.select(F.col("n_docs").cast("double")).scalar()
    if index.dfreq is not None:
        dfreq = index.dfreq.select("term", F.col("df").cast("double").alias("df"))
    else:
        dfreq = index.postings.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    nq = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return write_shared(qterms.withColumn("nq", nq).join(dfreq, "term").select(
        "query_id", "term", "nq", "df", _idf(F.col("qtf"), n_docs, F.col("df")).alias("w")), "weights")


def _by_document(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """``postings`` partitioned by document so that one task sums about ``TASK_ROWS`` matching rows. A term gives as
    many rows as it has postings for every row (with its ``df``) of ``weights``; the bytes of the postings, by which
    AQE would merge partitions, say nothing about that."""
    rows = weights.agg(F.sum("df")).first()[0] or 0
    parts = max(postings.sparkSession.sparkContext.defaultParallelism, -(-int(rows) // TASK_ROWS))
    return postings.repartition(parts, "doc_id")


def _share(index: LexicalIndex, k1: float, b: float):
    """The part of a term's weight that a posting earns, between 0 and 1."""
    avgdl = index.stats.select("avgdl").scalar()
    return F.col("tf") / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / avgdl))


def _bm25(weights: DataFrame, index: LexicalIndex, k1: float, b: float) -> DataFrame:
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / index.stats.select("avgdl").scalar())
    return _sum_scores(_by_document(index.postings, weights).join(weights, "term").select(
        "query_id", "doc_id", "nq", (F.col("w") * F.col("tf") / (F.col("tf") + norm)).alias("c")))


def bm25(qterms: DataFrame, index: LexicalIndex, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Matching ``(query_id, doc_id, score, matched, n_query_terms)`` pairs (L3).

    ``matched`` is the number of distinct query terms found in the document,
    ``n_query_terms`` the number of distinct terms of the query. The postings
    are partitioned by ``doc_id``; while the weights are small enough to be
    broadcast, the sum per (query, document) keeps that partitioning, and
    with ``retrieve`` on top, pairs are cut to k per query before any shuffle.
    For query tables beyond that, see ``top_documents``.
    """
    return _bm25(_weights(qterms, index), index, k1, b)


def top_documents(qterms: DataFrame, index: LexicalIndex, k: int = K_RECALL, k1: float = BM25_K1, b: float = BM25_B,
                  seeds: int = 2, weights: DataFrame | None = None) -> DataFrame:
    """``retrieve(bm25(...), k)`` without summing the documents that cannot be among a query's best k (L3, L4).

    A term earns a query at most its weight times the largest share among its
    postings. (1) The ``seeds`` terms with the highest such bounds are summed
    first: the k-th best of these partial scores is a score that the k best
    reach. (2) A query's terms are ordered by their bounds, lowest first; the
    leading ones whose bounds together stay below that score are optional: a
    document with no other term is out. (3) The other, essential terms
    are summed, and documents that cannot reach the score with all optional terms
    added are cut. (4) Only for those left are the optional terms looked up, by
    (document, term). Equal to the full sum for any k; no cap on candidates.
    """
    w = _weights(qterms, index) if weights is None else weights
    post = index.postings.select("doc_id", "term", _share(index, k1, b).alias("share"))
    bound = F.col("w") * F.col("top")
    bounded = write_shared(w.join(post.groupBy(F.col("term").alias("t")).agg(F.max("share").alias("top")),
                                  F.col("term") == F.col("t")).select("query_id", "term", "nq", "w", bound.alias("u")), "bounds")
    first = top_k(bounded, seeds, "query_id", [F.col("u").desc(), F.col("term")], "r").select("query_id", "term", "w")
    partial = (post.join(first, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("share")).alias("s")))
    reached = (top_k(partial, k, "query_id", [F.col("s").desc(), F.col("doc_id")], "r").groupBy(F.col("query_id").alias("q"))
               .agg(F.when(F.count("*") >= k, F.min("s") * (1 - SLACK)).otherwise(0.0).alias("least")))
    so_far = F.sum("u").over(Window.partitionBy("query_id").orderBy("u", "term").rowsBetween(Window.unboundedPreceding, 0))
    split = write_shared(bounded.withColumn("below", so_far).join(reached, F.col("query_id") == F.col("q"), "left").select(
        "query_id", "term", "nq", "w", "u", F.coalesce("least", F.lit(0.0)).alias("least"),
        (F.col("below") >= F.coalesce("least", F.lit(0.0))).alias("essential")), "terms")
    optional = split.where(~F.col("essential"))
    spare = optional.groupBy(F.col("query_id").alias("q")).agg(F.sum("u").alias("spare"))
    essential = split.where("essential").join(spare, F.col("query_id") == F.col("q"), "left").select(
        "query_id", "term", "nq", "w", "least", F.coalesce("spare", F.lit(0.0)).alias("spare"))
    summed = (post.join(essential, "term").groupBy("query_id", "doc_id")
              .agg(F.sum(F.col("w") * F.col("share")).alias("s"), F.count(F.lit(1)).alias("m"), F.max("nq").alias("n_query_terms"),
                   F.max("least").alias("least"), F.max("spare").alias("spare")))
    left = write_shared(summed.where(F.col("s") + F.col("spare") >= F.col("least")).drop("least", "spare"), "candidates")
    asked = left.select("query_id", "doc_id").join(optional.select("query_id", "term", "w"), "query_id")
    more = (asked.join(post, ["doc_id", "term"]).groupBy(F.col("query_id").alias("q"), F.col("doc_id").alias("d"))
            .agg(F.sum(F.col("w") * F.col("share")).alias("s2"), F.count(F.lit(1)).alias("m2")))
    total = (left.join(more, (F.col("query_id") == F.col("q")) & (F.col("doc_id") == F.col("d")), "left").select(
        "query_id", "doc_id", F.round(F.col("s") + F.coalesce("s2", F.lit(0.0)), SCORE_DIGITS).alias("score"),
        (F.col("m") + F.coalesce("m2", F.lit(0))).alias("matched"), "n_query_terms"))
    return retrieve(total, k)


def _codes(values, order: bool = False):
    """Numbers of the values (nulls are one value) and the distinct values, ascending with null first where ``order``."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    unique = pc.unique(values)
    if order:
        unique = unique.take(pc.array_sort_indices(unique, null_placement="at_start"))
    return pc.index_in(values, value_set=unique).to_numpy(zero_copy_only=False).astype(np.int64), unique


def _block_top(k: int, names: list[str]):
    """The k best documents of a block for every query, but none below the score (``least``) that k documents of other
    blocks reach; the scores of one query at a time are held, as one array."""
    def best(post: pa.Table, asked: pa.Table) -> pa.Table:
        doc, docs = _codes(post["doc_id"], order=True)
        queries, nq = asked["query_id"].combine_chunks(), asked["nq"].to_numpy()
        least = pc.fill_null(asked["least"], 0.0).to_numpy()
        lists = asked["terms"].combine_chunks()
        cut = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        term, w = lists.flatten().flatten()
        (term, terms), w = _codes(term), w.to_numpy(zero_copy_only=False)
        known = pc.index_in(post["term"].combine_chunks(), value_set=terms)
        known = pc.fill_null(known, len(terms)).to_numpy(zero_copy_only=False).astype(np.int64)
        by_term = np.argsort(known * max(len(docs), 1) + doc)  # postings without a query's term come last
        doc, share, at = doc[by_term], post["share"].to_numpy()[by_term], np.searchsorted(known[by_term], np.arange(len(terms) + 1))
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for q in range(len(queries)):
            mine = range(cut[q], cut[q + 1])
            held = [slice(at[term[i]], at[term[i] + 1]) for i in mine]
            place = np.concatenate([doc[x] for x in held])
            score = np.bincount(place, np.concatenate([w[i] * share[x] for i, x in zip(mine, held)]), len(docs))
            if least[q] > 4 * ROUNDING:
                some = np.flatnonzero(score >= least[q] - 2 * ROUNDING)
            else:
                some = np.flatnonzero(np.bincount(place, minlength=len(docs)))
            rounded = np.round(score[some], SCORE_DIGITS)
            if len(some) > k:
                use = rounded >= np.partition(rounded, len(rounded) - k)[len(rounded) - k]
                some, rounded = some[use], rounded[use]
            some = some[np.argsort(-rounded, kind="stable")[:k]]  # documents are in ascending order, which breaks ties
            matched = np.zeros(len(some), np.int64)
            for x in held:  # a term's documents are in ascending order, each once
                matched += np.searchsorted(doc[x], some, side="right") - np.searchsorted(doc[x], some)
            for column, x in zip(found, (np.full(len(some), q), some, score[some], matched, np.full(len(some), nq[q]))):
                column.append(x)
        q, d, *rest = (np.concatenate(x) for x in found)
        return pa.Table.from_arrays([queries.take(pa.array(q)), docs.take(pa.array(d)), *map(pa.array, rest)], names=names)
    return best


def top_by_blocks(weights: DataFrame, index: LexicalIndex, k: int = K_RECALL, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """``retrieve(bm25(...), k)`` for many queries, no (query, document) pair of which is a row unless it is among the
    k best of its block and can be among the k best of all (L3, L4).

    The documents are cut into blocks of about ``BLOCK_POSTINGS`` postings by a hash of their ids. A block meets all
    queries' weights; each query's scores over the block are summed in one array and its k best kept. Blocks are
    taken in rounds, each as large as all before it (at first as many blocks as tasks run at once): a document below
    the k best scores so far is not returned, so a round gives about k rows a query and all of them together k times
    the logarithm of the number of blocks. The rows shuffled are the postings once, the weights for each block,
    and those. The work of the sums is that of the matching postings, which grows with queries times documents.
    Exact for any k.
    """
    post = index.postings.select("doc_id", "term", _share(index, k1, b).alias("share"))
    blocks = max(1, -(-post.count() // BLOCK_POSTINGS))
    post = post.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    queries = write_shared(weights.groupBy("query_id").agg(F.max("nq").alias("nq"), F.collect_list(F.struct("term", "w")).alias("terms")),
                           "query-terms")
    types = dict(weights.dtypes)["query_id"], dict(post.dtypes)["doc_id"]
    names = ["query_id", "doc_id", "score", "matched", "n_query_terms"]
    schema = f"query_id {types[0]}, doc_id {types[1]}, score double, matched bigint, n_query_terms bigint"
    best, done = None, 0
    while True:
        end = min(blocks, done + max(post.sparkSession.sparkContext.defaultParallelism, done))
        if best is None:
            asked = queries.withColumn("least", F.lit(None).cast("double"))
        else:
            least = best.where(F.col("lex_rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("least"))
            asked = queries.join(least, F.col("query_id").eqNullSafe(F.col("q")), "left").drop("q")
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(done), F.lit(end - 1))))
        mine = post.where((F.col("block") >= done) & (F.col("block") < end)) if end - done < blocks else post
        found = mine.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_block_top(k, names), schema)
        found = found.withColumn("score", F.round("score", SCORE_DIGITS))
        best = retrieve(found if best is None else best.drop("lex_rank").unionByName(found), k)
        if end == blocks:
            return best
        best, done = write_shared(best, "best"), end


def search(qterms: DataFrame, index: LexicalIndex, k: int = K_RECALL, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Top-k candidates of every query (L3 + L4): the full sum for small query tables, ``top_by_blocks`` for
    tables of more than ``PRUNE_FROM`` (query, term) rows. The results are the same."""
    w = _weights(qterms, index)
    if w.count() > PRUNE_FROM:
        return top_by_blocks(w, index, k, k1, b)
    return retrieve(_bm25(w, index, k1, b), k)


# ---------------------------------------------------------------- persisted index
def write_index(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "body",
                mode: str = "word") -> str:
    """Build and persist a full inverted index under ``path`` (L2): its version 0.

    ``postings/v=0``: ``(term, doc_id, dl, tf)`` range-partitioned and sorted by
    term, so a lookup of a few terms reads only the row groups whose term
    range covers them (parquet min/max statistics); ``dfreq/v=0``: ``(term, df)``
    sorted by term; ``stats/v=0``: one row ``(n_docs, total_terms, avgdl)``.
    The term rows are written once and the three tables are derived from the
    written copy. ``update_index`` adds versions.
    """
    agg = write_shared(_term_rows(docs, id_col, text_col, mode, None), "index-build")
    post = agg.where(F.col("term").isNotNull())
    _write_postings(post, f"{path}/postings/v=0")
    # counted from the sorted copy: a term is in few of its files, so counts and not postings are shuffled
    written = docs.sparkSession.read.parquet(f"{path}/postings/v=0")
    _write_dfreq(written.groupBy("term").agg(F.count(F.lit(1)).alias("df")), f"{path}/dfreq/v=0")
    corpus_stats(agg.where(F.col("term").isNull()).select("dl")).write.mode("overwrite").parquet(f"{path}/stats/v=0")
    return path


def _write_postings(post: DataFrame, path: str) -> None:
    # range key (term, doc_id): a term holding a third of all postings still
    # spreads over several partitions; AQE merges the small ones by their bytes
    (post.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
     .select("term", "doc_id", "dl", "tf").write.mode("overwrite").parquet(path, compression=COMPRESSION))


def _write_dfreq(dfreq: DataFrame, path: str) -> None:
    dfreq.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def update_index(spark, path: str, changed: DataFrame, deleted: DataFrame | None = None, id_col: str = "id",
                 text_col: str = "body", mode: str = "word") -> str:
    """Bring a persisted index up to date from its changed documents alone.

    ``changed``: new and altered documents, one row each; ``deleted``: ids
    (``id_col``) that are gone. Only these texts are read. Their postings are appended as a
    new version; ``gone/v=N`` lists their ids, and older postings of these ids
    are left out by an anti-join when the index is opened. Document
    frequencies and statistics change by the difference between their new and
    their old postings. The statistics are written last: until then
    readers see the version before, and a failed update is simply run again.
    """
    from relevo.sources.sinks import latest_version

    n = int(latest_version(spark, f"{path}/stats").rsplit("v=", 1)[1]) + 1
    now = open_index(spark, path)
    rows = write_shared(_term_rows(changed, id_col, text_col, mode, None), "index-update")
    ids = changed.select(F.col(id_col).alias("doc_id"))
    if deleted is not None:
        ids = ids.union(deleted.select(F.col(id_col).alias("doc_id")))
    (ids.distinct().withColumn("below", F.lit(n))).write.mode("overwrite").parquet(f"{path}/gone/v={n}")
    gone = spark.read.parquet(f"{path}/gone/v={n}").select("doc_id")
    old = write_shared(now.postings.join(gone, "doc_id", "left_semi"), "index-replaced")
    new = rows.where(F.col("term").isNotNull())
    _write_postings(new, f"{path}/postings/v={n}")
    by = lambda df, sign: df.groupBy("term").agg((F.count(F.lit(1)) * sign).alias("df"))
    _write_dfreq(now.dfreq.unionByName(by(new, 1)).unionByName(by(old, -1)).groupBy("term")
                 .agg(F.sum("df").alias("df")).where(F.col("df") > 0), f"{path}/dfreq/v={n}")
    lengths = lambda df, sign: df.agg(F.lit(sign) * F.count(F.lit(1)), F.lit(sign) * F.coalesce(F.sum("dl"), F.lit(0))).first()
    before = now.stats.first()
    parts = [(before["n_docs"], before["total_terms"] or 0), lengths(rows.where("term IS NULL AND dl > 0"), 1),
             lengths(old.select("doc_id", "dl").distinct(), -1)]
    docs, terms = (sum(p[k] for p in parts) for k in (0, 1))
    (spark.createDataFrame([(docs, terms, terms / docs if docs else None)], "n_docs bigint, total_terms bigint, avgdl double")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/v={n}"))
    return path


def open_index(spark, path: str) -> LexicalIndex:
    """The newest complete version of a persisted index."""
    from relevo.sources.sinks import latest_version

    stats = latest_version(spark, f"{path}/stats")
    n = int(stats.rsplit("v=", 1)[1])
    post = spark.read.option("basePath", f"{path}/postings").parquet(*[f"{path}/postings/v={v}" for v in range(n + 1)])
    if n:
        gone = (spark.read.parquet(*[f"{path}/gone/v={v}" for v in range(1, n + 1)])
                .groupBy(F.col("doc_id").alias("_gone")).agg(F.max("below").alias("_below")))
        post = post.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.col("v") < F.col("_below")), "left_anti")
    return LexicalIndex(post.drop("v"), spark.read.parquet(stats), spark.read.parquet(f"{path}/dfreq/v={n}"))


def lookup(index: LexicalIndex, qterms: DataFrame) -> LexicalIndex:
    """Restrict a persisted index to the query vocabulary (inverted-index lookup): a semi-join on the term."""
    vocab = qterms.select("term").distinct()
    return LexicalIndex(index.postings.join(vocab, "term", "left_semi"), index.stats,
                        index.dfreq.join(vocab, "term", "left_semi") if index.dfreq is not None else None)


def bm25_synonyms(qterms: DataFrame, synonyms: DataFrame, docs: DataFrame, id_col: str = "id",
                  text_col: str = "body", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """BM25 with query-time synonym expansion blended per original term (A3 in L3).

    Each query term and its expansions form one group scored as a single
    pseudo-term: ``tf`` = sum of the members' tf in the document, ``df`` =
    the largest member df. A query term without a rule is its own group, so
    without matching rules the scores equal ``bm25``.
    """
    syn = synonyms.select(F.col("lhs").alias("_lhs"), F.col("rhs").alias("_rhs"))
    expanded = write_shared(qterms.join(syn, F.col("term") == F.col("_lhs"), "left").select(
        "query_id", F.col("term").alias("grp"), F.coalesce("_rhs", "term").alias("term"), "qtf").distinct(), "expanded")
    idx = build_index(docs, id_col, text_col, vocabulary=expanded)
    n_docs = idx.stats.select(F.col("n_docs").cast("double")).scalar()
    avgdl = idx.stats.select("avgdl").scalar()
    dfreq = idx.postings.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    groups = (expanded.join(dfreq, "term").groupBy("query_id", "grp")
              .agg(F.max("qtf").alias("qtf"), F.max("df").alias("df")))
    nq = expanded.select("query_id", "grp").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("nq"))
    weights = groups.join(nq, "query_id").select("query_id", "grp", "nq", _idf(F.col("qtf"), n_docs, F.col("df")).alias("w"))
    # one row per member term with its group's weight; groups are summed per document before saturation
    members = write_shared(expanded.select("query_id", "grp", "term").join(weights, ["query_id", "grp"])
                           .join(dfreq, "term"), "members")
    gtf = (_by_document(idx.postings, members).join(members, "term")
           .groupBy("query_id", "grp", "doc_id", "dl", "nq", "w").agg(F.sum("tf").alias("tf")))
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / avgdl)
    return _sum_scores(gtf.select("query_id", "doc_id", "nq",
                                  (F.col("w") * F.col("tf") / (F.col("tf") + norm)).alias("c")))


def retrieve(scored: DataFrame, k: int = K_RECALL) -> DataFrame:
    """Top-k candidates per query by score, ties by doc_id: adds ``lex_rank`` (L4)."""
    return top_k(scored, k, "query_id", [F.col("score").desc(), F.col("doc_id").asc()], "lex_rank")


def queries_without_hits(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Queries that retrieved nothing."""
    return queries.join(candidates.select("query_id").distinct(), "query_id", "left_anti")


def multi_field_bm25(queries: DataFrame, docs: DataFrame, fields: dict[str, float], id_col: str = "id",
                     k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Weighted sum of per-field BM25 scores (L6): ``sum_f w_f * bm25_f``.

    Each field has its own statistics (as separate indexed fields do).
    """
    qt = query_terms(queries)
    parts = []
    for field, weight in fields.items():
        scored = bm25(qt, build_index(docs, id_col, field, vocabulary=qt), k1, b)
        parts.append(scored.select("query_id", "doc_id", (F.col("score") * F.lit(weight)).alias("s")))
    return (reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id")
            .agg(F.round(F.sum("s"), SCORE_DIGITS).alias("score")))
