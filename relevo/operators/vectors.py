"""Vectors: batch embedding (V1), cosine top-k exact and approximate (V2), validation (V3).

Exact k-nearest-neighbour search must compare every query with every
vector. Both tables are cut into blocks of bounded size by a hash of the id;
each pair of blocks is one task's unit, scored by NumPy matrix products over
slices of the vectors, and gives its k best per query. No pair becomes a row,
nothing is collected, and a final window picks the k best of all blocks.
The approximate searches file vectors under centroids (``knn_inverted``) or
hash them to buckets of random projections (``knn_approximate``) first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevo.operators.analysis import token_array
from relevo.operators.util import let, spread, top_k
from relevo.session import write_shared

SCORE_DIGITS, IDF_SCALE = 9, 1_000_000
#: Rows of a block of queries and of a block of vectors, and vectors of one matrix product.
QUERY_BLOCK, VECTOR_BLOCK, SLICE = 2_000, 20_000, 2_000
#: Terms that texts are summed by where their rows are.
FREQUENT = 200_000


def idf_table(docs: DataFrame, text_col: str = "body", id_col: str = "id") -> DataFrame:
    """``(term, idf)`` as whole millionths of ``ln((n + 1) / (df + 1))``, ``n`` counting all rows, so that sums are exact."""
    n = docs.select(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    held = F.array_distinct(token_array(F.col(text_col)))
    return (spread(docs.select(id_col, text_col), id_col).select(F.explode(held).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .select("term", F.floor(F.log((n + 1) / (F.col("df") + 1)) * IDF_SCALE).cast("bigint").alias("idf")))


def _sum_known(known: pa.Table, dim: int):
    """For each list of tokens: the sums by place of the weights of the ``known`` terms, how many tokens these are, and the others."""
    terms = known["term"].combine_chunks()
    place, weight = known["place"].to_numpy(), known["weight"].to_numpy()

    def sums(tokens: pa.Array) -> pa.Array:
        n = len(tokens)
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        coded = tokens.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=terms), -1).to_numpy(zero_copy_only=False)[code]
        use = at >= 0
        # whole numbers below 2 ** 53, so that the sums in doubles are exact
        x = np.bincount(row[use] * dim + place[at[use]], weight[at[use]], n * dim).astype(np.int64)
        starts = lambda each: pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32))
        other = pa.ListArray.from_arrays(starts(np.bincount(row[~use], minlength=n)), coded.dictionary.take(pa.array(code[~use])))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(starts(np.full(n, dim)), pa.array(x)), pa.array(np.bincount(row[use], minlength=n)), other],
            names=["sums", "found", "others"])
    return sums


def hashed_vectors(docs: DataFrame, idf: DataFrame, text_col: str = "body", dim: int = 64, id_col: str = "id") -> DataFrame:
    """``(doc_id, vector)`` by signed feature hashing of terms, weighted by ``tf * idf``, unit length; texts with tokens only.

    A term's place is the first seven hexadecimal digits of its MD5 modulo
    ``dim``, its sign the parity of the eighth: any engine can repeat it, and
    terms that share a place cancel as often as they add.

    The ``FREQUENT`` most frequent terms, which nearly all tokens are, go to
    the tasks as a table, so that a text is summed where its row is; only the
    tokens of other terms are rows that meet their terms by a join.
    """
    digest = F.md5("term")
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("bigint")
    sign = F.when(number(8, 1) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    placed = idf.select("term", "idf", (number(1, 7) % dim).cast("int").alias("place"), (F.col("idf") * sign).alias("weight"))
    known = placed.orderBy("idf", "term").limit(FREQUENT).toArrow()  # of bounded size
    kind = "struct<sums:array<bigint>,found:bigint,others:array<string>>"
    text = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "doc_id")
    rows = write_shared(text.select("doc_id", F.arrow_udf(_sum_known(known, dim), kind)(token_array(F.col("_text"))).alias("h"))
                        .select("doc_id", "h.*"), "sums")
    # rows that repeat an id are one document
    made = rows.groupBy("doc_id").agg(F.sum("found").alias("found"), *[F.sum(F.col("sums")[i]).alias(f"x{i}") for i in range(dim)])
    x = F.array(*[f"x{i}" for i in range(dim)])
    if known.num_rows == FREQUENT:
        last = known.slice(FREQUENT - 1).to_pylist()[0]
        rare = placed.where((F.col("idf") > last["idf"]) | ((F.col("idf") == last["idf"]) & (F.col("term") > F.lit(last["term"]))))
        more = (rows.select("doc_id", F.explode("others").alias("term")).join(rare, "term")
                .groupBy("doc_id", "place").agg(F.sum("weight").alias("x"))
                .groupBy(F.col("doc_id").alias("_doc")).agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("more")))
        made = (made.join(more, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
                .where((F.col("found") > 0) | F.col("more").isNotNull()))
        x = F.transform(x, lambda e, i: e + F.coalesce(F.element_at("more", i), F.lit(0)))
    else:
        made = made.where(F.col("found") > 0)
    unit = let(F.transform(x, lambda e: e.cast("double")), lambda v: let(
        F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: a + e * e)), lambda n: F.transform(
            v, lambda e: F.when(n > 0, F.round(e / n, SCORE_DIGITS)).otherwise(F.lit(0.0)))))
    return made.select("doc_id", unit.alias("vector"))


def embed(df: DataFrame, text_col: str = "body", dim: int = 64, out: str = "vector", encoder=None, id_col: str = "id",
          idf: DataFrame | None = None) -> DataFrame:
    """Batch text embedding as ``array<double>`` (V1): ``df`` with the column ``out``.

    Default: ``hashed_vectors`` with ``idf`` (a stored table; fitted on ``df`` where it is not given); needs no model
    files. A text without tokens is the zero vector. Rows are told apart by ``id_col``. ``encoder``:
    a function ``list[str] -> array (n, d)`` (e.g. a sentence encoder) run on
    Arrow batches with ``mapInPandas``; it is called once per batch, and any
    model it holds is loaded once per Python worker by the caller's closure.
    """
    if encoder is not None:
        schema = df.schema.simpleString()[len("struct<"):-1] + f",{out}:array<double>"

        def run(batches):
            for pdf in batches:
                texts = pdf[text_col].fillna("").astype(str).tolist()
                vecs = np.asarray(encoder(texts), dtype="float64") if texts else np.zeros((0, 0))
                pdf[out] = list(vecs)
                yield pdf

        return df.mapInPandas(run, schema)
    stored = write_shared(idf_table(df, text_col, id_col), "idf") if idf is None else idf
    made = hashed_vectors(df, stored, text_col, dim, id_col).withColumnRenamed("vector", "_vector")
    zero = F.array_repeat(F.lit(0.0), dim)
    return (df.join(made, F.col(id_col).eqNullSafe(F.col("doc_id")), "left").withColumn(out, F.coalesce("_vector", zero))
            .select(*df.columns, out))


def check_vectors(df: DataFrame, vec: str = "embedding", dim: int = 64) -> DataFrame:
    """Per vector: right dimension, no NaN, non-zero norm, and ``valid`` (V3)."""
    v = F.col(vec)
    norm2 = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    has_nan = F.exists(v, lambda x: F.isnan(x))
    return df.select("*", (F.size(v) == dim).alias("dim_ok"), (~has_nan).alias("finite"),
                     (norm2 > 0).alias("nonzero")).withColumn(
        "valid", F.col("dim_ok") & F.col("finite") & F.col("nonzero"))


def _unit(column) -> np.ndarray:
    m = np.array([np.asarray(v, dtype="float64") for v in column])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _block_best(k: int, qid: str, vid: str):
    """The k best vectors of a block for every query of a block."""
    def best(q, v):
        import pandas as pd

        if not len(q) or not len(v):
            return pd.DataFrame({qid: q["q"][:0], vid: v["id"][:0], "score": np.zeros(0)})
        v = v.sort_values("id")
        m, ids = _unit(q["v"]), v["id"].to_numpy()
        score, pick = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), dtype=np.int64)
        for at in range(0, len(v), SLICE):
            s = np.round(m @ _unit(v["v"].iloc[at:at + SLICE]).T, SCORE_DIGITS)
            score = np.concatenate([score, s], axis=1)
            pick = np.concatenate([pick, np.broadcast_to(np.arange(at, at + s.shape[1]), s.shape)], axis=1)
            # vectors are in id order, so a stable sort breaks ties by id
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, pick = np.take_along_axis(score, top, 1), np.take_along_axis(pick, top, 1)
        return pd.DataFrame({qid: np.repeat(q["q"].to_numpy(), score.shape[1]), vid: ids[pick.ravel()],
                             "score": score.ravel()})
    return best


def _best_of_units(left: DataFrame, right: DataFrame, unit: list[str], k: int, qid: str, vid: str) -> DataFrame:
    types = dict(left.dtypes)["q"], dict(right.dtypes)["id"]
    partial = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInPandas(
        _block_best(k, qid, vid), f"{qid} {types[0]}, {vid} {types[1]}, score double")
    return top_k(partial, k, qid, [F.col("score").desc(), F.col(vid).asc()], "rank")


def _own(c: str, n: int):
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, qid: str = "query_id", qvec: str = "vector",
        vid: str = "vec_id", vvec: str = "embedding") -> DataFrame:
    """Exact cosine top-k per query: ``(query_id, vec_id, score, rank)`` (V2).

    Scores are rounded to 9 decimals before ranking; ties by ``vec_id``.
    """
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    v_blocks = max(1, -(-vectors.count() // VECTOR_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col(qid).alias("q"), F.col(qvec).alias("v"), _own(qid, q_blocks).alias("i"),
                          every(v_blocks).alias("j"))
    right = vectors.select(F.col(vid).alias("id"), F.col(vvec).alias("v"), _own(vid, v_blocks).alias("j"),
                           every(q_blocks).alias("i"))
    return _best_of_units(left, right, ["i", "j"], k, qid, vid)


def _filed(df: DataFrame, ident: str, vec: str, name: str, centers: np.ndarray, most: int) -> DataFrame:
    """``(name, v, list)``: the ``most`` nearest lists of every vector, a row each."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<int>")
    def nearest(v):
        import pandas as pd

        s = _unit(v) @ centers.T if len(v) else np.zeros((0, len(centers)))
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :most].astype(np.int32)))

    return df.select(F.col(ident).alias(name), F.col(vec).alias("v"), F.explode(nearest(F.col(vec))).alias("list"))


def inverted_file(vectors: DataFrame, n_lists: int = 32, vid: str = "vec_id", vvec: str = "embedding",
                  sample: int = 50_000, seed: int = 7) -> np.ndarray:
    """Unit centroids of the lists: k-means over at most ``sample`` unit vectors, those with the smallest id hashes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    some = vectors.orderBy(F.xxhash64(vid), vid).limit(sample).select(
        array_to_vector(F.transform(vvec, lambda e: e.cast("double"))).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="features").transform(some).select("features")
    model = KMeans(k=n_lists, seed=seed, maxIter=15).fit(unit)
    return _unit(model.clusterCenters())


def knn_inverted(queries: DataFrame, vectors: DataFrame, k: int = 10, nprobe: int = 24, qid: str = "query_id",
                 qvec: str = "vector", vid: str = "vec_id", vvec: str = "embedding", centers: np.ndarray | None = None,
                 n_lists: int = 32) -> DataFrame:
    """Approximate cosine top-k: an inverted file of vectors, of which a query probes the ``nprobe`` nearest lists (V2).

    Every vector is filed under its nearest centroid; a list is compared
    exactly with the queries that probe it. Lists of more than
    ``VECTOR_BLOCK`` vectors are cut into parts, so a hot list is many units. With
    ``nprobe`` at the number of lists the result is that of ``knn``. The default
    probes 24 of 32 lists, for vectors without any clusters (recall 0.96 on
    64-dimensional noise); clustered ones need 8 for 0.9.
    """
    centers = inverted_file(vectors, n_lists, vid, vvec) if centers is None else centers
    filed = write_shared(_filed(vectors, vid, vvec, "id", centers, 1), "filed-vectors")
    parts = (filed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(VECTOR_BLOCK)).cast("int").alias("parts"))
             .select(F.col("list").alias("l"), "parts"))  # a row a list
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    left = (_filed(queries, qid, qvec, "q", centers, nprobe).join(parts, F.col("list") == F.col("l"))
            .withColumn("i", _own("q", q_blocks)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("q", "v", "list", "i", "j"))
    right = (filed.join(parts, F.col("list") == F.col("l")).withColumn("j", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).select("id", "v", "list", "i", "j"))
    return _best_of_units(left, right, ["list", "i", "j"], k, qid, vid)


def knn_approximate(queries: DataFrame, vectors: DataFrame, k: int = 10, qid: str = "query_id", qvec: str = "vector",
                    vid: str = "vec_id", vvec: str = "embedding", bucket: float = 0.5, tables: int = 12,
                    distance: float = 1.3, seed: int = 7) -> DataFrame:
    """Approximate cosine top-k: random-projection buckets propose candidates, cosines rank them.

    Unit vectors within ``distance`` of a query that share one of ``tables``
    bucket numbers with it are compared; more tables raise recall and cost.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    def unit(df, i, v, name):
        x = df.select(F.col(i).alias(name), array_to_vector(F.transform(v, lambda e: e.cast("double"))).alias("_v"))
        return Normalizer(inputCol="_v", outputCol="_u").transform(x).select(name, "_u")

    q, d = unit(queries, qid, qvec, qid), unit(vectors, vid, vvec, vid)
    model = BucketedRandomProjectionLSH(inputCol="_u", outputCol="_h", bucketLength=bucket, numHashTables=tables,
                                        seed=seed).fit(d)
    near = model.approxSimilarityJoin(q, d, distance, "_d").select(
        F.col(f"datasetA.{qid}").alias(qid), F.col(f"datasetB.{vid}").alias(vid),
        F.round(1 - F.col("_d") * F.col("_d") / 2, SCORE_DIGITS).alias("score"))
    return top_k(near, k, qid, [F.col("score").desc(), F.col(vid).asc()], "rank")


def centroids(vectors: DataFrame, group: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per group: ``(group, vector)``; one value per dimension is
    aggregated (partial aggregation), so a large group is never gathered."""
    x = vectors.select(group, F.posexplode(vec).alias("pos", "x"))
    m = x.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (m.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_s"))
            .select(group, F.transform("_s", lambda s: s["m"]).alias("vector")))
