"""Cases the fixtures do not show: missing keys and values, second runs, changed files, hot keys, blocks, plans."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevo.functions.fixed import DEFAULT_NORM_PARAMS
from relevo.operators import features as N
from relevo.operators import lexical as L
from relevo.operators import signals as G
from relevo.operators import vectors as V
from relevo.operators.analysis import parse_synonyms
from relevo.operators.containment import containment_pairs
from relevo.sources import readers as R
from relevo.sources import sinks as K
from relevo.sources import tables as T
from tests.conftest import SF_SMALL

HITS = "author string, subreddit string, utility_hit long"


def test_null_keys_are_overwritten_once(spark, tmp_path):
    path = str(tmp_path / "f")
    for n in (2, 5):
        K.write_features(spark.createDataFrame([("b", None, n), ("a", "s", 1)], HITS), path)
    got = sorted(map(tuple, spark.read.parquet(K.latest_version(spark, path)).collect()), key=str)
    assert got == [("a", "s", 1), ("b", None, 5)]


def test_null_keys_are_streamed_once(spark, tmp_path):
    from relevo.streaming.utility_stream import read_utility, stream_utility

    src, sink, ckpt = (str(tmp_path / x) for x in ("src", "sink", "ckpt"))
    schema = "author string, subreddit string, body string"
    for n in (2, 1):
        spark.createDataFrame([("b", None, "fixed it")] * n, schema).coalesce(1).write.mode("append").parquet(src)
        stream_utility(spark, src, spark.read.parquet(src).schema, sink, ckpt, ["fixed"]).awaitTermination()
    assert list(map(tuple, read_utility(spark, sink).collect())) == [("b", None, 3)]


def test_upsert_prefers_the_incoming_row(spark):
    s = "id string, ingest_seq int, body string"
    old = spark.createDataFrame([("a", 0, "zzz old"), ("b", 0, "b0"), (None, 0, "n")], s)
    new = spark.createDataFrame([("a", 0, "aaa new")], s)
    assert {r["id"]: r["body"] for r in K.upsert_documents(old, new).collect()} == {"a": "aaa new", "b": "b0", None: "n"}
    assert (K.next_order(None), K.next_order(old)) == (0, 1)


def test_second_pipeline_run_replaces_changed_documents(spark, tmp_path):
    from relevo.operators.lexical import open_index
    from relevo.plans.pipeline import run_pipeline

    src, out = tmp_path / "sf", str(tmp_path / "out")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name in ("events", "labels"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(f"{src}/{name}.parquet")
    docs.write.parquet(f"{src}/documents.parquet")
    run_pipeline(spark, str(src), out, keywords=T.FIXTURE_KEYWORDS, train=False)
    changed = F.when(F.col("doc_id") == 3, F.lit("aaa changed body")).otherwise(F.col("text"))
    docs.where("doc_id < 5").withColumn("text", changed).write.mode("overwrite").parquet(f"{src}/documents.parquet")
    run_pipeline(spark, str(src), out, keywords=T.FIXTURE_KEYWORDS, train=False)
    store = spark.read.parquet(K.latest_version(spark, f"{out}/documents"))
    rows = {r["id"]: r for r in store.collect()}
    assert len(rows) == docs.count() and rows["3"]["body"] == "aaa changed body"
    assert rows["3"]["ingest_seq"] == 1 and rows["100"]["ingest_seq"] == 0 and len(rows["100"]["content_vector"]) == 64
    postings = open_index(spark, f"{out}/index").postings
    assert postings.select("doc_id").distinct().count() == store.where("body <> ''").count()


def test_nan_is_imputed(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double").withColumn("y", F.lit(None).cast("double"))
    got = N.impute_median(df, ("x", "y")).collect()
    assert sorted(r["x"] for r in got) == [1.0, 2.0, 2.0, 3.0] and {r["y"] for r in got} == {0.0}


def test_parameter_files(spark, tmp_path):
    good, bad, short = (tmp_path / f"{n}.json" for n in ("good", "bad", "short"))
    values = {c: float(i) for i, c in enumerate(N.PARAM_COLS)}
    good.write_text(json.dumps(values, indent=1))
    bad.write_text("{not json")
    short.write_text(json.dumps({"expertise_min": 1.0}))
    assert R.read_norm_params(spark, str(good)).first().asDict() == values
    assert R.read_norm_params(spark, str(tmp_path / "none")).first().asDict() == DEFAULT_NORM_PARAMS
    for p in (bad, short):
        with pytest.raises(Exception, match="."):
            R.read_norm_params(spark, str(p))


def test_source_key_sees_files_in_folders(spark, tmp_path):
    from relevo.plans.search import source_key

    path = str(tmp_path / "t.parquet")
    spark.range(3).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(path)
    before = source_key(spark, path)
    assert source_key(spark, path) == before
    spark.range(5).coalesce(1).write.mode("append").parquet(path + "/p=0")
    assert source_key(spark, path) != before and T.table(spark, str(tmp_path), "t").count() == 8


def test_fallback_only_for_missing_sources(spark, tmp_path):
    def broken(_):
        raise ValueError("a fault, not a missing source")

    with pytest.raises(ValueError):
        R.read_with_fallback(spark, broken, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        R.read_with_fallback(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))


def test_dynamic_text_fields(spark):
    df = spark.createDataFrame([("1", "x", "y", "z")], "id string, a_str string, b_ws string, c_txt_en string")
    assert R.apply_dynamic_types(df).first().asDict() == {"id": "1", "a_str": ["x"], "b_ws": "y", "c_txt_en": "z"}


def test_a_hot_author_is_split(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        posts = spark.range(60_000).select(
            "id", F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id") % 500)).alias("author"),
            F.lit("s").alias("subreddit"), F.sha2(F.col("id").cast("string"), 256).alias("body")).repartition(8, "id")
        rep = posts.groupBy("author", "subreddit").agg(F.count("*").cast("double").alias("topical_focus_score"))
        util = spark.createDataFrame([("hot", "s", 9), (None, "s", 4)], HITS)
        out = G.enrich_posts(posts, rep, util)
        assert out.where("author = 'hot' AND utility_score = 9").count() == 40_000
        out.foreach(lambda _: None)
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_scores_are_cut_before_the_shuffle_of_pairs(spark):
    docs, qt = T.corpus(spark, SF_SMALL).select("id", "body"), L.query_terms(T.queries(spark, SF_SMALL))
    top = L.retrieve(L.bm25(qt, L.build_index(docs, vocabulary=qt)), 5)
    top.collect()
    plan = top._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    below = plan.split("WindowGroupLimit", 1)[1].split("WindowGroupLimit", 1)[1]  # under the per-task cut
    assert "hashpartitioning(query_id" not in below.split("repartition", 1)[0].split("REPARTITION", 1)[0]


def test_postings_count_within_rows(spark):
    docs = spark.createDataFrame([(1, "b a b B c"), (2, ""), (3, None)], "id long, body string")
    got = sorted(map(tuple, L.build_postings(docs).collect()))
    assert got == [(1, 5, "a", 1), (1, 5, "b", 3), (1, 5, "c", 1)]
    plan = L.build_postings(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "doc_id", "text")
    assert "HashAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_containment_of_many_and_short_passages(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words, 30))) for i in range(60)] + [(99, None), (98, ""), (97, "é")]
    passages = []
    for k in range(1500):
        text = docs[rng.integers(0, 60)][1]
        at = int(rng.integers(0, len(text)))
        passages.append((k, text[at:at + int(rng.integers(1, 25))]))
    passages += [(5000, ""), (5001, None), (5002, "é"), (5003, "nowhere to be found at all")]
    p, d = spark.createDataFrame(passages, "pid long, ptext string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in containment_pairs(p, d).collect()}
    assert got == {(i, j) for i, t in passages if t for j, u in docs if u and t in u}


def test_knn_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vecs, qs = rng.normal(size=(230, 6)), rng.normal(size=(33, 6))
    vecs[7] = vecs[8]
    for name, n in (("QUERY_BLOCK", 10), ("VECTOR_BLOCK", 60), ("SLICE", 16)):
        monkeypatch.setattr(V, name, n)
    frame = lambda m, a, b: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{a} long, {b} array<double>")
    vdf, qdf = frame(vecs, "vec_id", "embedding"), frame(qs, "query_id", "vector")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in V.knn(qdf, vdf, 5).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(qs) @ unit(vecs).T, 9)
    want = {(i, k + 1): j for i, s in enumerate(scores) for k, j in enumerate(sorted(range(len(s)), key=lambda j: (-s[j], j))[:5])}
    assert got == want
    assert V.knn(qdf.limit(0), vdf, 5).count() == 0 and V.knn(qdf, vdf.limit(0), 5).count() == 0
    near = {(r["query_id"], r["vec_id"]) for r in V.knn_approximate(qdf, vdf, 5).collect()}
    assert len(near & {(q, v) for (q, _), v in want.items()}) >= 0.9 * len(want)


def test_training_keeps_the_best_epoch(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from relevo.operators import scoring as SC
    from relevo.operators import training as M

    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        e, u = rng.random(2)
        rows.append((i, "alpha beta gamma", "alpha beta" if e > 0.5 else "delta words", float(e), float(u), int(e + 0.2 * u > 0.6)))
    pairs = spark.createDataFrame(rows, "id long, query_text string, body string, expertise_score double, utility_score double, label int")
    for hidden in (None, 4):
        model, report = M.train_relevance_model(pairs, epochs=3, hidden=hidden)
        losses = M.training_report(report).collect()
        assert [r["epoch"] for r in losses] == [1, 2, 3]
        kept = [r for r in losses if r["kept"]]
        assert len(kept) == 1 and kept[0]["val_log_loss"] == min(r["val_log_loss"] for r in losses) == losses[-1]["best_so_far"]
        scored = SC.score_pairs(M.model_frame(pairs), model).collect()
        assert len(scored) == 400 and all(0 <= r["semantic"] <= 1 for r in scored)
        assert np.mean([(r["semantic"] > 0.5) == r["label"] for r in scored]) > 0.8
    path = M.save_model(model, str(tmp_path), "9")
    again = {r["id"]: r["semantic"] for r in SC.score_pairs(M.model_frame(pairs), PipelineModel.load(path)).collect()}
    assert again == {r["id"]: r["semantic"] for r in scored}
    frame = {r["id"]: r for r in M.model_frame(pairs).collect()}
    assert frame[0]["coverage"] in (0.0, 2 / 3) and all(0 <= r["cosine"] <= 1 for r in frame.values())
    broken = pairs.withColumn("utility_score", F.when(F.col("id") == 1, None).otherwise(F.col("utility_score")))
    with pytest.raises(Exception, match="."):
        M.train_relevance_model(broken, epochs=1)


def test_model_scored_search_has_one_row_per_candidate(spark):
    import __spark_entry__ as E

    rows = E.queries()["hybrid_search_model"](spark, SF_SMALL).collect()
    assert rows and len({(r["query_id"], r["doc_id"]) for r in rows}) == len(rows)
    assert all(0 <= r["semantic"] <= 1 for r in rows) and len({r["semantic"] for r in rows}) > 10


def test_checkpoint_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from relevo.session import ensure_checkpoint_dir

    def session(master):
        conf = SimpleNamespace(get=lambda k, d=None: d)
        return SimpleNamespace(sparkContext=SimpleNamespace(
            master=master, getCheckpointDir=lambda: None, getConf=lambda: conf, setCheckpointDir=lambda p: None))

    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(session(master))
    assert ensure_checkpoint_dir(session("local[2]"))


def test_fixture_rules_change_their_inputs(spark):
    import __spark_entry__ as E

    q = E.queries()
    plain = {tuple(r) for r in L.query_terms(T.queries(spark, SF_SMALL)).select("term").collect()}
    assert {lhs for lhs, _ in parse_synonyms(T.FIXTURE_SYNONYMS)} & {t for t, in plain}
    assert q["queries_without_hits"](spark, SF_SMALL).count() >= 10
    assert q["escape_query"](spark, SF_SMALL).where("contains(escaped, '\\\\(')").count() > 0
