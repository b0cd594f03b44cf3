"""Operators checked against brute force on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevo.operators.containment import containment_pairs
from relevo.operators.stats import exact_percentile
from relevo.operators import vectors as V
from relevo.sources.sinks import upsert_documents
from relevo.sources import synth as Y


def test_exact_percentile_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])  # a heavy duplicate value
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    for p in (0.0, 0.5, 0.99, 1.0):
        assert exact_percentile(df, "x", p) == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-12)
    # force the narrowing recursion with a tiny candidate budget
    assert exact_percentile(df, "x", 0.37, k=64, max_candidates=50) == pytest.approx(
        float(np.percentile(vals, 37)), abs=1e-12)


def test_containment_matches_brute_force(spark):
    docs = [(1, "alpha beta gamma delta. epsilon"), (2, "xx alpha beta gamma delta"), (3, "beta gamma"),
            (4, "zz Alpha beta gamma delta"), (5, "an ab cd ef")]
    passages = [(10, "alpha beta gamma delta"), (11, "beta gamma"), (12, "b cd e"), (13, "gamma delta. eps")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(passages, "pid long, ptext string")
    got = {(r["pid"], r["doc_id"]) for r in containment_pairs(p, d).collect()}
    brute = {(pid, did) for pid, pt in passages for did, t in docs if pt in t}
    assert got == brute


def test_knn_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(300, 8))
    qs = rng.normal(size=(4, 8))
    vdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    qdf = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(qs)], "query_id long, vector array<double>")
    got = {}
    for r in V.knn(qdf, vdf.repartition(7), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    vn = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for qi, q in enumerate(qs):
        s = np.round(vn @ (q / np.linalg.norm(q)), 9)
        expect = sorted(range(len(s)), key=lambda j: (-s[j], j))[:5]
        assert [v for _, v in sorted(got[qi])] == expect


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("a", 0, "v0"), ("b", 0, "b0")], "id string, ingest_seq int, body string")
    new = spark.createDataFrame([("a", 1, "v1"), ("a", 2, "v2"), ("c", 1, "c1")], "id string, ingest_seq int, body string")
    got = {r["id"]: r["body"] for r in upsert_documents(old, new).collect()}
    assert got == {"a": "v2", "b": "b0", "c": "c1"}


def test_synth_posts_rules(spark):
    base = spark.range(2000).withColumnRenamed("id", "doc_id")
    rows = Y.synth_posts(base, "doc_id", seed=3).collect()
    assert len(rows) == 2000
    for r in rows:
        assert r["label"] == int(r["expertise_score"] > 0.5 and r["utility_score"] > 0.5)
        assert r["title"] and r["body"]
    from relevo.functions.fixed import SYNTH_SOLUTION_PHRASES
    high = sum(1 for r in rows if r["body"].startswith(tuple(p[:5] for p in SYNTH_SOLUTION_PHRASES)))
    assert 0.1 < high / 2000 < 0.35
    again = Y.synth_posts(base, "doc_id", seed=3).orderBy("id").collect()
    assert sorted(rows, key=lambda r: r["id"]) == again


def test_result_independent_of_partitioning(spark):
    from relevo.operators import signals as G
    from relevo.sources import tables as T
    sf = "/root/testdata/sf0.001"
    a = T.activity(spark, sf)
    r1 = sorted(tuple(r) for r in G.topical_reputation(a, T.FIXTURE_CUTOFF, 10).collect())
    r2 = sorted(tuple(r) for r in G.topical_reputation(a.repartition(13), T.FIXTURE_CUTOFF, 10).collect())
    assert r1 == r2


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    s = sorted(tuple(r) for r in E.queries()["stream_utility"](spark, sf).collect())
    b = sorted(tuple(r) for r in E.queries()["utility_hits"](spark, sf).collect())
    assert s == b


def test_dynamic_types(spark):
    from relevo.sources.readers import apply_dynamic_types
    df = spark.createDataFrame([("1", "3", "x", None, "q"), (None, "4", "y", 0.5, "r")],
                               "id string, n_i string, tags_ss string, expertise_score double, other string")
    rows = apply_dynamic_types(df).collect()
    assert len(rows) == 1 and rows[0]["n_i"] == 3 and rows[0]["tags_ss"] == ["x"]
    assert rows[0]["expertise_score"] == 0.0 and "other" not in rows[0].asDict()


def test_bm25_synonym_blending(spark):
    import math
    from relevo.operators import analysis as A
    from relevo.operators import lexical as L
    docs = spark.createDataFrame([(1, "tv tv show"), (2, "television show"), (3, "radio show")], "id long, body string")
    q = spark.createDataFrame([(7, "TV"), (8, "show")], "query_id long, query_text string")
    qt = L.query_terms(q)
    got = {(r["query_id"], r["doc_id"]): r["score"]
           for r in L.bm25_synonyms(qt, A.synonym_table(spark), docs).collect()}
    n, avgdl = 3.0, 7 / 3
    idf = math.log(1 + (n - 1 + 0.5) / (1 + 0.5))       # group df = max(1, 1)
    tfn = lambda tf, dl: tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert got[(7, 1)] == pytest.approx(idf * tfn(2, 3), abs=2e-9)
    assert got[(7, 2)] == pytest.approx(idf * tfn(1, 2), abs=2e-9)
    assert (7, 3) not in got
    plain = {(r["query_id"], r["doc_id"]): r["score"]
             for r in L.bm25(qt, L.build_index(docs, vocabulary=qt)).collect()}
    for d in (1, 2, 3):
        assert got[(8, d)] == plain[(8, d)]


def test_keyed_overwrite_replaces_only_incoming_keys(spark, tmp_path):
    from relevo.sources.sinks import latest_version, write_features
    path = str(tmp_path / "feat")
    schema = "author string, subreddit string, utility_hit long"
    write_features(spark.createDataFrame([("a", "s", 1), ("b", "s", 2)], schema), path)
    write_features(spark.createDataFrame([("a", "s", 5), ("c", "s", 1)], schema), path)
    got = {r["author"]: r["utility_hit"] for r in spark.read.parquet(latest_version(spark, path)).collect()}
    assert got == {"a": 5, "b": 2, "c": 1}


def test_stream_restart_and_new_files(spark, tmp_path):
    """Two runs over a growing folder with one checkpoint equal one batch count."""
    from pyspark.sql import functions as F
    from relevo.operators.signals import utility_hits
    from relevo.sources import tables as T
    from relevo.streaming.utility_stream import read_utility, stream_utility

    docs = T.table(spark, "/root/testdata/sf0.001", "documents")
    src, sink, ckpt = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ckpt")
    docs.where(F.col("doc_id") % 2 == 0).coalesce(1).write.parquet(src + "/part1")

    def to_posts(raw):
        return raw.select(F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string")).alias("author"),
                          F.col("source").alias("subreddit"), F.col("text").alias("body"))

    def run():
        q = stream_utility(spark, src + "/*", docs.schema, sink, ckpt, T.FIXTURE_KEYWORDS, to_posts)
        q.awaitTermination()

    run()
    docs.where(F.col("doc_id") % 2 == 1).coalesce(1).write.parquet(src + "/part2")
    run()
    got = sorted(tuple(r) for r in read_utility(spark, sink).collect())
    expect = sorted(tuple(r) for r in utility_hits(T.corpus(spark, "/root/testdata/sf0.001"),
                                                   T.FIXTURE_KEYWORDS).collect())
    assert got == expect


def test_embed_with_custom_encoder(spark):
    from relevo.operators.vectors import embed

    def encoder(texts):
        return np.array([[len(t), t.count(" ")] for t in texts], dtype=float)

    df = spark.createDataFrame([(1, "a b c"), (2, None)], "id long, body string")
    got = {r["id"]: r["vector"] for r in embed(df, "body", encoder=encoder).collect()}
    assert got == {1: [5.0, 2.0], 2: [0.0, 0.0]}
    default = embed(df, "body", dim=16).collect()
    assert all(len(r["vector"]) == 16 for r in default)


def test_score_pairs_three_scorer_kinds(spark):
    from relevo.operators import scoring as SC
    df = spark.createDataFrame([(1, 0.5, 0.2, 0.9), (2, 1.0, 0.0, 0.0)],
                               "id long, coverage double, expertise_score double, utility_score double")
    col = {r["id"]: r["semantic"] for r in SC.score_pairs(df, SC.logistic_scorer()).collect()}
    z = -2.0 + 3.0 * 0.5 + 0.2 + 0.9
    assert col[1] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)

    @SC.pandas_scorer
    def batch(pdf):
        return 1 / (1 + np.exp(-(-2.0 + 3.0 * pdf["coverage"] + pdf["expertise_score"] + pdf["utility_score"])))

    pan = {r["id"]: r["semantic"] for r in SC.score_pairs(df, batch).collect()}
    assert pan == pytest.approx(col)
