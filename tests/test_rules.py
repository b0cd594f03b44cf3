"""Hand-computed cases and semantic rules (small in-memory frames)."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevo.functions import fixed as X
from relevo.functions.text import escape_query, first_words, has_any_keyword, preview, strip_tags
from relevo.operators import evaluation as E
from relevo.operators import features as N
from relevo.operators import fusion as H
from relevo.operators import scoring as SC
from relevo.operators import signals as G


def _ranked(spark, rels, scores=None, hyb=None):
    n = len(rels)
    scores = scores or [float(n - i) for i in range(n)]
    hyb = hyb or list(range(1, n + 1))
    rows = [(1, i, i + 1, scores[i], int(rels[i]), hyb[i]) for i in range(n)]
    return spark.createDataFrame(rows, "query_id int, doc_id int, lex_rank int, score double, rel int, "
                                       "hybrid_rank int")


@pytest.mark.parametrize("rels,expected", [([1, 0, 1], 0.91972), ([0, 0], 0.0), ([0, 1], 0.63093)])
def test_ndcg_cases(spark, rels, expected):
    r = E.per_query_metrics(_ranked(spark, rels)).first()
    assert r["lexical_ndcg"] == pytest.approx(expected, abs=1e-5)


def test_minmax_per_query(spark):
    df = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (1, 3, 3.0), (2, 4, 7.0)],
                               "query_id int, doc_id int, score double")
    got = {r["doc_id"]: r["lex_norm"] for r in N.minmax_per_query(df).collect()}
    assert got[1] == pytest.approx(0.9999995)
    assert got[2] == 0.0
    assert got[3] == pytest.approx(0.49999975)
    assert got[4] == 0.0  # single hit


def test_serve_norm_with_shipped_params(spark):
    params = N.params_frame(spark, X.SHIPPED_NORM_PARAMS)
    df = spark.createDataFrame([(0.95, 0.5), (0.05, 2.0), (None, None)], "expertise_score double, utility_score double")
    rows = N.apply_norm(df, params, "serve", default=0.0).collect()
    assert rows[0]["expertise_score"] == pytest.approx(0.848 / 0.848001)
    assert rows[1]["expertise_score"] == 0.0 and rows[1]["utility_score"] == 1.0
    assert rows[2]["expertise_score"] == 0.0


def test_train_norm_has_no_clip(spark):
    params = N.params_frame(spark, {"expertise_min": 0.0, "expertise_max": 1.0, "utility_min": 0.0, "utility_max": 1.0})
    df = spark.createDataFrame([(2.0, -1.0)], "expertise_score double, utility_score double")
    r = N.apply_norm(df, params, "train").first()
    assert r["expertise_score"] == pytest.approx(2.0) and r["utility_score"] == pytest.approx(-1.0)


def test_fit_degenerate_ranges(spark):
    df = spark.createDataFrame([(0.5, None), (0.5, None)], "expertise_score double, utility_score double")
    r = N.fit_norm(df).first()
    assert (r["expertise_min"], r["expertise_max"]) == (0.0, 1000.0)
    assert (r["utility_min"], r["utility_max"]) == (0.0, 2.0)


def test_fusion_value(spark):
    df = spark.createDataFrame([(1.0, 0.6)], "lex_norm double, semantic double")
    assert H.fuse(df, 0.2).first()["hybrid"] == pytest.approx(0.68)
    with pytest.raises(ValueError):
        H.fuse(df, 1.5)


def test_layer_norm(spark):
    df = spark.createDataFrame([(0.8, 0.2)], "a double, b double")
    r = df.select(*SC.layer_norm("a", "b")).first()
    assert r["ln_a"] == pytest.approx(0.99994, abs=1e-5) and r["ln_b"] == pytest.approx(-0.99994, abs=1e-5)


def test_class_imbalance(spark):
    df = spark.createDataFrame([(0,)] * 90 + [(1,)] * 10, "label int")
    from relevo.operators.quality import class_imbalance
    r = class_imbalance(df).first()
    assert r["imbalance_ratio"] == pytest.approx(90 / 11) and r["severe"] is False


def test_proxy_relevance_ties(spark):
    scores = [20.0 - i for i in range(9)] + [5.0, 5.0]
    df = _ranked(spark, [0] * 11, scores).drop("rel")
    rels = [r["rel"] for r in E.proxy_relevance(df).collect()]
    assert rels == [1] * 11
    few = _ranked(spark, [0] * 4).drop("rel")
    assert [r["rel"] for r in E.proxy_relevance(few).collect()] == [1] * 4


def test_thin_queries_are_skipped(spark):
    df = _ranked(spark, [1])
    assert E.drop_thin_queries(df).count() == 0


def test_lift(spark):
    pq = spark.createDataFrame([(1, 2, 1.0, 0.9, 1)], "query_id int, n_hits int, lexical_ndcg double, "
                                                      "hybrid_ndcg double, recall int")
    assert E.summarize(pq).first()["lift_pct"] == pytest.approx(-10.0, abs=1e-6)


def _activity(spark, rows):
    from decimal import Decimal
    rows = [(i, a, s, Decimal(v), t) for i, a, s, v, t in rows]
    return spark.createDataFrame(rows, "id string, author string, subreddit string, score decimal(18,2), "
                                       "created_utc timestamp")


def test_reputation_threshold_after_global_total(spark):
    t = datetime(2024, 1, 1)
    rows = [("1", "a", "s", 20, t), ("2", "a", "s", 10, t), ("3", "b", "s", 5, t)]
    r = G.topical_reputation(_activity(spark, rows), "2024-02-01", 10).collect()
    assert len(r) == 1 and r[0]["topical_focus_score"] == pytest.approx(30 / 35)
    assert r[0]["activity_density"] == pytest.approx(math.log(3))


def test_reputation_rules(spark):
    t, late = datetime(2024, 1, 1), datetime(2024, 2, 1)
    rows = [("1", None, "s", 50, t),          # NULL author dropped
            ("2", "a", None, 20, t),          # NULL subreddit kept as a key
            ("3", "a", "s", 30, late),        # cut-off is strict
            (None, "a", "x", 15, t)]          # COUNT(id) skips NULL ids
    r = {(x["author"], x["subreddit"]): x for x in
         G.topical_reputation(_activity(spark, rows), "2024-02-01", 10).collect()}
    assert set(r) == {("a", None), ("a", "x")}
    assert r[("a", "x")]["activity_density"] == pytest.approx(math.log(1))
    zero = [("1", "a", "s", 0, t)]
    z = G.topical_reputation(_activity(spark, zero), "2024-02-01", -1).first()
    assert z["topical_focus_score"] is None


def test_utility_keyword_rules(spark):
    rows = [("user1", "python", "I fixed the bug!"), ("user2", "python", "Hello world"),
            ("user3", "python", "FIXED the issue"), ("user4", "python", "fixed and it worked!"),
            ("user5", "python", "unfixed"), ("user6", "python", None)]
    df = spark.createDataFrame(rows, "author string, subreddit string, body string")
    got = {r["author"]: r["utility_hit"] for r in G.utility_hits(df, X.UTILITY_KEYWORDS).collect()}
    assert got == {"user1": 1, "user3": 1, "user4": 1, "user5": 1}


def test_text_functions(spark):
    df = spark.createDataFrame([("<b>Hi</b>  there a b c d e f g h", "a+b (c)")], "t string, q string")
    r = df.select(first_words(strip_tags("t"), 3).alias("w"), escape_query("q").alias("e"),
                  preview("t", 5).alias("p"), has_any_keyword("t", ["there"]).alias("k")).first()
    assert r["w"] == "Hi there a"
    assert r["e"] == "a\\+b \\(c\\)"
    assert r["p"] == "<b>Hi..."
    assert r["k"] is True


def test_invariants_alpha_extremes(spark):
    from relevo.plans import q_search as QS
    sf = "/root/testdata/sf0.001"
    lex = QS.ranked(spark, sf, alpha=1.0).collect()
    for r in lex:
        assert 0.0 <= r["hybrid"] <= 1.0
    by_q = {}
    for r in lex:
        by_q.setdefault(r["query_id"], []).append(r)
    for rows in by_q.values():
        order_h = [r["doc_id"] for r in sorted(rows, key=lambda r: r["hybrid_rank"])]
        order_l = [r["doc_id"] for r in sorted(rows, key=lambda r: r["lex_rank"])]
        # alpha = 1: hybrid is the min-max of the lexical score (monotone), ties keep lexical order
        assert order_h == order_l


def test_config_validation():
    from relevo.config import Config
    assert Config().validate().alpha == 0.2
    with pytest.raises(ValueError):
        Config(alpha=1.2).validate()
    with pytest.raises(KeyError):
        Config.from_dict({"database": {}, "training": {}, "artifacts": {}})
    cfg = Config.from_dict({"database": {"project_id": "p", "dataset": "d"}, "training": {"extra_feature_dim": 2},
                            "artifacts": {}, "search_tuning": {"alpha": 0.3}})
    assert cfg.alpha == 0.3 and cfg.extra_feature_dim == 2


def test_config_from_yaml(tmp_path):
    from relevo.config import Config
    f = tmp_path / "settings.yaml"
    f.write_text("database: {project_id: p, dataset: d}\nfeatures: {min_upvote_threshold: 7, utility_keywords: [a, b]}\n"
                 "training: {extra_feature_dim: 2, epochs: 3, val_split: 0.2}\nartifacts: {version: '2.0'}\n"
                 "search_tuning: {k_recall: 20, alpha: 0.5}\n")
    cfg = Config.from_yaml(str(f))
    assert (cfg.min_upvote_threshold, cfg.utility_keywords, cfg.epochs, cfg.k_recall, cfg.alpha, cfg.version) == \
        (7, ["a", "b"], 3, 20, 0.5, "2.0")


def test_split_is_deterministic_and_near_ratio(spark):
    from relevo.operators.training import split
    df = spark.range(20000)
    a = split(df, 0.15, 42).where("is_validation").count()
    b = split(df.repartition(7), 0.15, 42).where("is_validation").count()
    assert a == b and 0.13 < a / 20000 < 0.17
