"""Containment by automaton, pruned retrieval, inverted file, bucketed streaming sink."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevo.operators import containment as C
from relevo.operators import lexical as L
from relevo.operators import stats
from relevo.operators import vectors as V
from relevo.sources import tables as T
from tests.conftest import SF_SMALL


def test_automaton_finds_nested_overlapping_and_short_passages(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab é\n"), rng.integers(0, 60))) for _ in range(80)] + [None, "", "日本語 a"]
    passages = ["a", "ab", "bab", "abab", "b\na", "é", " ", "", None, "ab", "日本", "zz", "".join(["ab"] * 9)] + [
        t[3:9] for t in texts[:30] if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "pid long, ptext string")
    want = sorted((p, d) for p, x in enumerate(passages) if x for d, t in enumerate(texts) if t and x in t)
    for block in (C.BLOCK_CHARS, 20):
        monkeypatch.setattr(C, "BLOCK_CHARS", block)
        assert sorted(tuple(r) for r in C.containment_pairs(asked, docs).collect()) == want
    assert C.containment_pairs(asked.where("ptext = ''"), docs).count() == 0


def test_no_text_is_shuffled_for_containment(spark, monkeypatch):
    monkeypatch.setattr("relevo.operators.util.SPREAD_BYTES", 0)
    bench = T.table(spark, SF_SMALL, "benchmark").select(F.col("item_id").alias("pid"), F.col("text").alias("ptext"))
    plan = C.containment_pairs(bench, T.table(spark, SF_SMALL, "documents"))._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in scan[:scan.index("FileScan")] and "documents.parquet" in scan


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_pruned_retrieval_is_the_full_sum(spark, broadcast):
    rng = np.random.default_rng(2)
    corpus = T.corpus(spark, SF_SMALL).select("id", "body")
    words = np.array([r["term"] for r in L.build_postings(corpus).groupBy("term").count().orderBy(F.desc("count"), "term").collect()])
    queries = [(i, " ".join(words[np.minimum(rng.zipf(1.3, rng.integers(1, 9)) - 1, len(words) - 1)])) for i in range(400)]
    qt = L.query_terms(spark.createDataFrame(queries, "query_id long, query_text string"))
    idx = L.build_index(corpus, vocabulary=qt)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        for k in (1, 10):
            full = sorted(tuple(r) for r in L.retrieve(L.bm25(qt, idx), k).collect())
            pruned = L.top_documents(qt, idx, k)
            assert sorted(tuple(r) for r in pruned.select(
                "query_id", "doc_id", "score", "matched", "n_query_terms", "lex_rank").collect()) == full
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_most_pairs_are_never_summed(spark, monkeypatch):
    qt = L.query_terms(T.queries(spark, SF_SMALL))
    idx = L.build_index(T.corpus(spark, SF_SMALL).select("id", "body"), vocabulary=qt)
    written, keep = {}, L.write_shared
    monkeypatch.setattr(L, "write_shared", lambda df, name: written.setdefault(name, keep(df, name)))
    L.top_documents(qt, idx, 5).collect()
    assert written["candidates"].count() < 0.7 * L.bm25(qt, idx).count()  # 2,863 of 4,391
    monkeypatch.setattr(L, "PRUNE_FROM", 0)
    monkeypatch.setattr(L, "write_shared", keep)
    pruned = sorted(map(tuple, L.search(qt, idx, 5).collect()))
    monkeypatch.setattr(L, "PRUNE_FROM", 10**9)
    assert pruned == sorted(map(tuple, L.search(qt, idx, 5).collect())) and pruned


def _vectors(spark, n=3000, dim=64):
    rng = np.random.default_rng(3)
    tops = rng.normal(size=(25, dim))
    m = tops[rng.integers(0, 25, n)] + rng.normal(scale=0.6, size=(n, dim))
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")


def test_inverted_file_recall_and_hot_lists(spark, monkeypatch):
    vecs = _vectors(spark)
    asked = vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {tuple(r) for r in V.knn(asked, vecs, 10).select("query_id", "vec_id").collect()}
    found = {tuple(r) for r in V.knn_inverted(asked, vecs, 10, nprobe=8, n_lists=32).select("query_id", "vec_id").collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 40)  # every list is cut into parts
    monkeypatch.setattr(V, "QUERY_BLOCK", 30)
    whole = V.knn_inverted(asked, vecs, 10, nprobe=12, n_lists=12)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, V.knn(asked, vecs, 10).collect()))


def test_inverted_file_recall_on_the_table(spark):
    import __spark_entry__ as E

    d = SF_SMALL.replace("0.001", "0.01")
    vecs = T.vectors(spark, d)
    asked = vecs.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {tuple(r) for r in V.knn(asked, vecs, 10).select("query_id", "vec_id").collect()}
    found = {tuple(r) for r in E.queries()["knn_inverted"](spark, d).select("query_id", "vec_id").collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_new_checkpoint_over_an_old_sink(spark, tmp_path):
    from relevo.streaming.utility_stream import _manifest, read_utility, stream_utility

    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    schema = "author string, subreddit string, body string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run(ckpt):
        stream_utility(spark, src, schema, sink, str(tmp_path / ckpt), ["fixed"], buckets=8).awaitTermination()
        return {(r[0], r[1]): r[2] for r in read_utility(spark, sink).collect()}

    add([("a", "x", "fixed")] * 5 + [(f"u{i}", "x", "fixed") for i in range(30)])
    first = run("one")
    assert first["a", "x"] == 5 and len(first) == 31
    before = _files(f"{sink}/data")
    add([("a", "x", "it is fixed")] * 4)
    assert run("two")["a", "x"] == 9  # counts everything anew, over the old sink
    add([("a", "x", "fixed"), (None, "x", "fixed")])
    last = run("two")
    assert last["a", "x"] == 10 and last[None, "x"] == 1 and len(last) == 32
    add([("a", "x", "fixed")])
    held = _files(f"{sink}/data")
    assert run("two")["a", "x"] == 11
    kept = held & _files(f"{sink}/data")
    assert kept and not before & _files(f"{sink}/data")  # untouched buckets keep their files, old versions go
    number = _manifest(spark, sink)[0]
    assert run("two") == {**last, ("a", "x"): 11} and _manifest(spark, sink)[0] == number


def test_replayed_epoch_is_written_once(spark, tmp_path):
    from relevo.streaming.utility_stream import _merge_batch, read_utility

    sink, schema = str(tmp_path / "sink"), "author string, subreddit string, utility_hit long"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    merge = _merge_batch(sink, "s1", 4)
    merge(frame(("a", "x", 3), ("b", "x", 1)), 0)
    merge(frame(("a", "x", 7), ("c", "x", 1)), 1)
    merge(frame(("a", "x", 6)), 1)  # the attempt before did not end: its keys are gone
    assert sorted(map(tuple, read_utility(spark, sink).collect())) == [("a", "x", 6), ("b", "x", 1)]
    _merge_batch(sink, "s2", 4)(frame(("b", "x", 9)), 0)
    assert sorted(map(tuple, read_utility(spark, sink).collect())) == [("a", "x", 6), ("b", "x", 9)]


def test_updated_index_is_the_rebuilt_one(spark, tmp_path):
    docs = T.corpus(spark, SF_SMALL).select("id", "body")
    path, whole = str(tmp_path / "a"), str(tmp_path / "b")
    L.write_index(docs, path)
    first = docs.where("id % 50 = 3").withColumn("body", F.concat(F.lit("fresh words "), "body")).union(
        spark.createDataFrame([(10**6, "a new document of new words"), (10**6 + 1, "")], "id long, body string"))
    L.update_index(spark, path, first, docs.where("id % 40 = 7").select("id"))
    second = docs.where("id = 3").withColumn("body", F.lit("")).union(docs.where("id = 7"))
    L.update_index(spark, path, second)
    now = docs.where("id % 40 <> 7 AND id % 50 <> 3").union(first.where("id <> 3")).union(second)
    L.write_index(now, whole)
    a, b = L.open_index(spark, path), L.open_index(spark, whole)
    for x, y in ((a.postings, b.postings), (a.dfreq, b.dfreq), (a.stats, b.stats)):
        assert sorted(map(tuple, x.select(*sorted(x.columns)).collect())) == sorted(map(tuple, y.select(*sorted(x.columns)).collect()))
    qt = L.query_terms(T.queries(spark, SF_SMALL).limit(20))
    found = [sorted(map(tuple, L.retrieve(L.bm25(qt, L.lookup(i, qt)), 20).collect())) for i in (a, b)]
    assert found[0] == found[1] and found[0]


def test_pipeline_resumes_and_serves_its_outputs(spark, tmp_path, monkeypatch):
    from relevo.config import Config
    from relevo.plans import pipeline as P

    out, seen = str(tmp_path / "out"), []
    monkeypatch.setattr(P.G, "enrich_posts", lambda *a, f=P.G.enrich_posts: seen.append("enrich") or f(*a))
    fail = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed"))
    kept = P.V.embed
    monkeypatch.setattr(P.V, "embed", fail)
    with pytest.raises(RuntimeError, match="killed"):
        P.run_pipeline(spark, SF_SMALL, out, keywords=T.FIXTURE_KEYWORDS, train=False, run="day1")
    monkeypatch.setattr(P.V, "embed", kept)
    monkeypatch.setattr(P.G, "topical_reputation", fail)
    P.run_pipeline(spark, SF_SMALL, out, keywords=T.FIXTURE_KEYWORDS, train=False, run="day1")
    assert seen == ["enrich"]
    few = P.search_outputs(spark, out, T.queries(spark, SF_SMALL), Config(k_recall=7, alpha=1.0, top_k=3)).collect()
    assert max(r["lex_rank"] for r in few) <= 3 and {r["hybrid_rank"] for r in few} <= {1, 2, 3} and few
    assert all(r["lex_rank"] == r["hybrid_rank"] for r in few)
    wide = P.search_outputs(spark, out, T.queries(spark, SF_SMALL), Config(k_recall=7, alpha=0.0, top_k=50)).collect()
    assert max(r["lex_rank"] for r in wide) == 7


def test_stop_lists_of_every_language(spark):
    from relevo.operators import analysis as A

    rows = [(1, "fr", "le chat dans la maison"), (2, "de", "der Hund und die Katze"), (3, "es", "el perro de la casa"),
            (4, "en", "the dog of the house"), (5, "it", "il cane")]
    toks = A.analyze(spark.createDataFrame(rows, "id long, lang string, body string"), "id", "body", keep=("lang",))
    left = {}
    for r in A.remove_stopwords(toks, A.stopword_table(spark), "lang").orderBy("id", "pos").collect():
        left.setdefault(r["id"], []).append(r["term"])
    assert left == {1: ["chat", "maison"], 2: ["hund", "katze"], 3: ["perro", "casa"], 4: ["dog", "house"], 5: ["il", "cane"]}


def test_phrases_take_the_longest_match(spark):
    from relevo.operators import analysis as A

    rules = ["a b => x y, z", "a b c d => long", "b => a", "c, d e", "# none"]
    df = spark.createDataFrame([(1, "a b c d a b c e"), (2, "a b c x d e"), (3, None), (4, "b a")], "query_id long, query_text string")
    got = {}
    for r in A.expand_phrases(df, rules).orderBy("query_id", "pos", "alt", "part").collect():
        got.setdefault(r["query_id"], []).append((r["pos"], r["span"], r["alt"], r["part"], r["term"]))
    ab = lambda p: [(p, 2, 0, 0, "x"), (p, 2, 0, 1, "y"), (p, 2, 1, 0, "z")]
    group = lambda p, n: [(p, n, 0, 0, "c"), (p, n, 1, 0, "d"), (p, n, 1, 1, "e")]
    assert got == {1: [(0, 4, 0, 0, "long"), *ab(4), *group(6, 1), (7, 1, 0, 0, "e")],
                   2: [*ab(0), *group(2, 1), (3, 1, 0, 0, "x"), *group(4, 2)], 4: [(0, 1, 0, 0, "a"), (1, 1, 0, 0, "a")]}


def test_reputation_file_reads_its_table_once(spark):
    import __spark_entry__ as E

    df = E.queries()["run_sql_file"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan or final.count("FileScan") == 1


def _columns(seed=5, n=6000):
    rng = np.random.default_rng(seed)
    return {"skewed": rng.lognormal(0, 3, n), "tied": rng.choice([1.0, 2.0, 7.5], n, p=[0.05, 0.9, 0.05]),
            "same": np.full(n, 4.25), "mixed": np.where(rng.random(n) < 0.4, -1.0, rng.normal(size=n))}


@pytest.mark.parametrize("k", [200, stats.SKETCH_K])
def test_sketched_ranks_are_within_the_stated_error(spark, k):
    values, ps = _columns(), [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*values.values())], [*values]).repartition(7)
    df = df.union(spark.createDataFrame([(None, float("nan"), None, None)], df.schema))
    for name, v in values.items():
        got = stats.sketch_percentiles(df, name, ps, k=k).first()
        assert got["n"] == len(v)
        for p, q in zip(ps, got["quantiles"]):
            assert (v < q).mean() - 1.5 * stats.rank_error(k) <= p <= (v <= q).mean() + 1.5 * stats.rank_error(k)
    by = stats.sketch_percentiles(df, "skewed", [0.5], by=("tied",)).collect()
    assert {r["tied"] for r in by if r["n"]} == {1.0, 2.0, 7.5} and len(by) == 4
    assert all((r["quantiles"] is None) == (r["n"] == 0) for r in by)


@pytest.mark.parametrize("max_candidates, k", [(stats.MAX_CANDIDATES, stats.SKETCH_K), (40, 256)])
def test_percentiles_of_many_columns_share_their_passes(spark, monkeypatch, max_candidates, k):
    values = _columns()
    df = spark.createDataFrame([(*map(float, r), None) for r in zip(*values.values())],
                               ", ".join(f"{c} double" for c in values) + ", empty double").cache()
    passes = []
    for name in ("_sketched", "_picked"):
        real = getattr(stats, name)
        monkeypatch.setattr(stats, name, lambda *a, real=real, name=name: passes.append(name) or real(*a))
    for p in (0.0, 0.123, 0.5, 0.99, 1.0):
        passes.clear()
        got = stats.exact_percentiles(df, {c: p for c in df.columns}, k, max_candidates)
        assert got.pop("empty") is None
        for c, v in got.items():
            assert v == pytest.approx(float(np.quantile(values[c], p)), abs=1e-12), (c, p)
        assert max_candidates == 40 or passes == ["_sketched", "_picked"]
        assert len(passes) < 8


def test_brackets_that_miss_their_ranks_are_opened(spark, monkeypatch):
    v = np.arange(1000.0)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    for wrong in ((900.0, 950.0), (10.0, 20.0)):
        monkeypatch.setattr(stats, "_narrowed", lambda *a, wrong=wrong: (wrong, 0.0))
        assert stats.exact_percentiles(df, {"x": 0.5})["x"] == 499.5
