"""Registered queries: scans and sinks, predicates and column functions,
enrichment, features, quality, windows, vectors, training splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from relevo.functions import fixed as X
from relevo.functions.text import (escape_query, first_value, first_words, has_any_keyword, preview, strip_tags)
from relevo.operators import features as N
from relevo.operators import quality as Q
from relevo.operators import scoring as SC
from relevo.operators import signals as G
from relevo.operators import training as M
from relevo.operators import vectors as V
from relevo.operators.util import rank_within, top_k
from relevo.plans.oracle_search import PARAMS_CTES, norm_expr, search_ctes
from relevo.plans.oracle_views import FIRST8, with_views
from relevo.plans.registry import register
from relevo.sources import readers as R
from relevo.sources import synth as Y
from relevo.sources import tables as T

KW_SQL = " OR ".join(f"contains(lower(coalesce(body, '')), '{w}')" for w in T.FIXTURE_KEYWORDS)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- scans
@register("read_posts", "SELECT doc_id, source, text FROM documents")
def q_read_posts(spark, sf):
    return R.read_posts(spark, f"{sf}/documents.parquet", ("doc_id", "source", "text"))


@register("index_source", with_views("""
    SELECT id, title, body, expertise_score, utility_score FROM post_scores
    WHERE body IS NOT NULL""", "post_scores"))
def q_index_source(spark, sf):
    return R.index_source(T.post_scores(spark, sf))


@register("training_source", with_views("""
    SELECT body, expertise_score, utility_score, label FROM post_scores WHERE label IS NOT NULL""",
                                      "post_scores"))
def q_training_source(spark, sf):
    return R.training_source(T.post_scores(spark, sf))


HOLDOUT_SQL = f"""
    SELECT * FROM post_scores WHERE label = 1
      AND ((id % {M.SPLIT_MOD}) * {M.SPLIT_MULT} + 42) % {M.SPLIT_MOD} % 10000 < {round(X.VAL_SPLIT * 10000)}"""


@register("holdout", with_views(HOLDOUT_SQL, "post_scores"))
def q_holdout(spark, sf):
    return R.holdout(T.post_scores(spark, sf))


@register("run_sql_file", with_views(f"""
    SELECT author, subreddit, CAST(total_upvotes AS DOUBLE) AS total_upvotes,
           CASE WHEN g.t = 0 THEN NULL ELSE CAST(total_upvotes AS DOUBLE) / g.t END AS topical_focus_score,
           round(ln(post_count + 1), 12) AS activity_density
    FROM ua, (SELECT CAST(SUM(total_upvotes) AS DOUBLE) AS t FROM ua) g
    WHERE total_upvotes >= 10""", "activity", extra=[("ua", f"""
    SELECT author, subreddit, COUNT(id) AS post_count, SUM(score) AS total_upvotes
    FROM activity WHERE created_utc < TIMESTAMP '{T.FIXTURE_CUTOFF}' AND author IS NOT NULL
    GROUP BY author, subreddit""")]))
def q_run_sql_file(spark, sf):
    T.activity(spark, sf).createOrReplaceTempView("relevo_activity")
    return R.run_sql_file(spark, "topical_reputation.sql",
                          {"source_table": "relevo_activity", "cutoff": T.FIXTURE_CUTOFF, "min_upvotes": 10})


@register("apply_dynamic_types", """
    SELECT CAST(doc_id AS VARCHAR) AS id, text AS body_t, CAST(n_chars AS INTEGER) AS n_chars_i, lang AS lang_s,
           CASE WHEN source IS NULL THEN NULL ELSE [source] END AS source_ss,
           TRY_CAST(CAST(n_chars AS VARCHAR) AS DOUBLE) AS chars_d,
           coalesce(CASE WHEN n_chars % 2 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) / 1000.0 END, 0.0)
             AS expertise_score
    FROM documents""")
def q_apply_dynamic_types(spark, sf):
    d = T.table(spark, sf, "documents")
    raw = d.select(F.col("doc_id").alias("id"), F.col("text").alias("body_t"), F.col("n_chars").alias("n_chars_i"),
                   F.col("lang").alias("lang_s"), F.col("source").alias("source_ss"),
                   F.col("n_chars").cast("string").alias("chars_d"),
                   F.when(F.col("n_chars") % 2 == 0, F.lit(None))
                    .otherwise(F.col("n_chars").cast("double") / 1000.0).alias("expertise_score"),
                   F.lit("dropped").alias("unknown_field"))
    return R.apply_dynamic_types(raw)


@register("coerce_documents", with_views("""
    SELECT CAST(id AS VARCHAR) AS id, coalesce(title, '') AS title, coalesce(body, '') AS body,
           coalesce(TRY_CAST(expertise_score AS DOUBLE), 0.0) AS expertise_score,
           coalesce(TRY_CAST(utility_score AS DOUBLE), 0.0) AS utility_score FROM post_scores""", "post_scores"))
def q_coerce_documents(spark, sf):
    return R.coerce_documents(T.post_scores(spark, sf))


@register("upsert_documents", """
    SELECT id, ingest_seq, n_chars, source FROM (
      SELECT md5(text) AS id, doc_id AS ingest_seq, n_chars, source,
             row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS rn FROM documents) t
    WHERE rn = 1""")
def q_upsert_documents(spark, sf):
    from relevo.sources.sinks import upsert_documents
    d = T.table(spark, sf, "documents")
    versions = d.select(F.md5("text").alias("id"), F.col("doc_id").alias("ingest_seq"), "n_chars", "source")
    return upsert_documents(None, versions, key="id", order="ingest_seq")


# ---------------------------------------------------------------- synthetic data
def _synth_sql(seed: int = 42) -> str:
    M_, A_, C_ = Y.MOD, Y.MULT, Y.INC
    step = lambda x: f"(({x}) * {A_} + {C_}) % {M_}"
    xs = [step(f"((doc_id % {M_}) * {Y.SEED_MULT} % {M_}) + {seed % M_}")]
    for _ in range(9):
        xs.append(step(xs[-1]))
    cols = ", ".join(f"{xs[i + 1]} AS x{i}" for i in range(9))
    lst = lambda vals: "[" + ", ".join(_q(v) for v in vals) + "]"
    nt = len(X.SYNTH_TOPICS)
    u = lambda i: f"(CAST(x{i} AS DOUBLE) / {float(M_)})"
    titles = []
    for i, tpl in enumerate(X.SYNTH_QUESTION_TEMPLATES):
        parts = tpl.split("{}")
        expr = [_q(parts[0])]
        for j, p in enumerate(parts[1:]):
            expr += ["t1" if j == 0 else "t2", _q(p)]
        titles.append(f"WHEN {i} THEN " + " || ".join(expr))
    (eh_lo, eh_hi), (uh_lo, uh_hi) = X.SYNTH_HIGH_RANGES
    (el_lo, el_hi), (ul_lo, ul_hi) = X.SYNTH_LOW_RANGES
    place = {"t1": "t1", "t2": "t2",
             "phrase": f"{lst(X.SYNTH_SOLUTION_PHRASES)}[x5 % {len(X.SYNTH_SOLUTION_PHRASES)} + 1]",
             "snippet": f"{lst(X.SYNTH_CODE_SNIPPETS)}[x6 % {len(X.SYNTH_CODE_SNIPPETS)} + 1]"}
    body = lambda tpl: " || ".join(
        c for text, name in Y.template_parts(tpl) for c in ([_q(text)] if text else []) + ([place[name]] if name else []))
    return f"""
    WITH d AS (SELECT doc_id, {cols} FROM documents),
    t AS (SELECT *, {lst(X.SYNTH_TOPICS)}[x0 % {nt} + 1] AS t1,
                    {lst(X.SYNTH_TOPICS)}[(x0 % {nt} + 1 + x1 % {nt - 1}) % {nt} + 1] AS t2,
                    ({u(3)} < {X.SYNTH_HIGH_RATIO}) AND ({u(4)} > {round(1 - X.SYNTH_SOLUTION_PROB, 9)}) AS solution FROM d),
    p AS (SELECT 'post_' || CAST(doc_id AS VARCHAR) AS id,
                 CASE x2 % {len(X.SYNTH_QUESTION_TEMPLATES)} {' '.join(titles)} END AS title,
                 CASE WHEN solution THEN {body(X.SYNTH_HIGH_BODY)} ELSE {body(X.SYNTH_LOW_BODY)}
                 END AS body,
                 round(CASE WHEN solution THEN {eh_lo} + {eh_hi - eh_lo!r} * {u(7)}
                            ELSE {el_lo} + {el_hi - el_lo!r} * {u(7)} END, 3) AS expertise_score,
                 round(CASE WHEN solution THEN {uh_lo} + {uh_hi - uh_lo!r} * {u(8)}
                            ELSE {ul_lo} + {ul_hi - ul_lo!r} * {u(8)} END, 3) AS utility_score
          FROM t)
    SELECT *, CAST(expertise_score > 0.5 AND utility_score > 0.5 AS INTEGER) AS label FROM p"""


@register("synth_posts", _synth_sql())
def q_synth_posts(spark, sf):
    return Y.synth_posts(T.table(spark, sf, "documents"), "doc_id", seed=42)


@register("derive_label", with_views("""
    SELECT id, expertise_score, utility_score,
           CAST(expertise_score > 0.5 AND utility_score > 0.5 AS INTEGER) AS label FROM post_scores""",
                                     "post_scores"))
def q_derive_label(spark, sf):
    return Y.derive_label(T.post_scores(spark, sf).select("id", "expertise_score", "utility_score"))


@register("shuffle", with_views("SELECT id, subreddit FROM corpus", "corpus"))
def q_shuffle(spark, sf):
    return Y.shuffle(T.corpus(spark, sf).select("id", "subreddit"), "id", 42)


# ---------------------------------------------------------------- predicates and column functions
@register("has_any_keyword", with_views(f"SELECT id, ({KW_SQL}) AS hit FROM posts", "posts"))
def q_has_any_keyword(spark, sf):
    return T.corpus(spark, sf).select("id", has_any_keyword("body", T.FIXTURE_KEYWORDS).alias("hit"))


@register("first_value", with_views("""
    SELECT id, coalesce(string_split(body, chr(10))[1], '') AS first_line FROM corpus""", "corpus"))
def q_first_value(spark, sf):
    return T.corpus(spark, sf).select("id", first_value(F.split("body", "\n")).alias("first_line"))


def _preview_sql(n: int, flatten: bool, always: bool = False) -> str:
    head = f"substr(coalesce(body, ''), 1, {n})"
    if flatten:
        head = f"regexp_replace(replace({head}, chr(10), ' '), '^\\s+|\\s+$', '', 'g')"
    if always:
        return f"{head} || '...'"
    return f"CASE WHEN length(coalesce(body, '')) > {n} THEN {head} || '...' ELSE {head} END"


@register("preview", with_views(f"""
    SELECT id, {_preview_sql(100, True)} AS preview_100, {_preview_sql(400, False)} AS text_400,
           {_preview_sql(150, False, True)} AS console_150 FROM corpus""", "corpus"))
def q_preview(spark, sf):
    c = T.corpus(spark, sf)
    return c.select("id", preview("body", 100, True).alias("preview_100"),
                    preview("body", 400, False).alias("text_400"),
                    preview("body", 150, False, always_ellipsis=True).alias("console_150"))


# the fixture queries hold no metacharacters: their first space becomes some
@register("escape_query", with_views("""
    SELECT query_id, regexp_replace(regexp_replace(query_text, ' ', ' (a:b)/* '), '([+\\-!(){}\\[\\]^"~*?:\\\\/])', '\\\\\\1', 'g') AS escaped
    FROM queries""", "queries"))
def q_escape_query(spark, sf):
    text = F.regexp_replace("query_text", "^([^ ]*) ", "$1 (a:b)/* ")
    return T.queries(spark, sf).select("query_id", escape_query(text).alias("escaped"))


@register("strip_tags", "SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS text FROM pages")
def q_strip_tags(spark, sf):
    return T.text_table(spark, sf, "pages", "page_id").select("page_id", strip_tags("html").alias("text"))


@register("first_words", f"""
    SELECT conv_id, turn, {FIRST8.format(x='text')} AS first_words FROM conversations""")
def q_first_words(spark, sf):
    return T.table(spark, sf, "conversations").select("conv_id", "turn", first_words("text", 8).alias("first_words"))


# ---------------------------------------------------------------- enrichment
_ENRICH_SQL = with_views(f"""
    SELECT p.id, p.author, p.subreddit, p.label,
           coalesce(r.topical_focus_score, 0.0) AS expertise_score,
           coalesce(CAST(u.utility_hit AS DOUBLE), 0.0) AS utility_score
    FROM posts p
    LEFT JOIN rep r ON r.author = p.author AND r.subreddit = p.subreddit
    LEFT JOIN util u ON u.author = p.author AND u.subreddit = p.subreddit""", "posts", "posts_activity", extra=[
    ("ua", f"""SELECT author, subreddit, COUNT(id) AS post_count, SUM(score) AS total_upvotes
               FROM posts_activity WHERE created_utc < TIMESTAMP '{T.FIXTURE_CUTOFF}' AND author IS NOT NULL
               GROUP BY author, subreddit"""),
    ("rep", """SELECT author, subreddit,
                      CASE WHEN g.t = 0 THEN NULL ELSE CAST(total_upvotes AS DOUBLE) / g.t END AS topical_focus_score
               FROM ua, (SELECT CAST(SUM(total_upvotes) AS DOUBLE) AS t FROM ua) g WHERE total_upvotes >= 10"""),
    ("util", f"""SELECT author, subreddit, COUNT(*) AS utility_hit FROM posts WHERE {KW_SQL}
                 GROUP BY author, subreddit""")])


@register("enrich_posts", _ENRICH_SQL)
def q_enrich_posts(spark, sf):
    posts = T.posts(spark, sf)
    rep = G.topical_reputation(T.posts_activity(spark, sf), T.FIXTURE_CUTOFF, 10)
    util = G.utility_hits(T.corpus(spark, sf), T.FIXTURE_KEYWORDS)
    return G.enrich_posts(posts, rep, util).select("id", "author", "subreddit", "label", "expertise_score",
                                                   "utility_score")


# ---------------------------------------------------------------- features (N1-N3, G7, G8, P6, SC4)
@register("drop_incomplete", with_views("SELECT id, label FROM post_scores WHERE body IS NOT NULL AND label IS NOT NULL",
                                        "post_scores"))
def q_drop_incomplete(spark, sf):
    return N.drop_incomplete(T.post_scores(spark, sf), ("body", "label")).select("id", "label")


@register("feature_ranges", with_views("""
    SELECT min(expertise_score) AS expertise_score_min, max(expertise_score) AS expertise_score_max,
           min(utility_score) AS utility_score_min, max(utility_score) AS utility_score_max FROM post_scores""",
                                       "post_scores"))
def q_feature_ranges(spark, sf):
    return N.feature_ranges(T.post_scores(spark, sf))


@register("fit_norm", with_views("SELECT * FROM params", "post_scores", extra=PARAMS_CTES))
def q_fit_norm(spark, sf):
    return N.fit_norm(N.drop_incomplete(T.post_scores(spark, sf), ("body", "label")))


@register("apply_norm", with_views(f"""
    SELECT ps.id, {norm_expr('coalesce(ps.expertise_score, 0.0)', 'p.expertise_min', 'p.expertise_max')}
             AS expertise_score,
           {norm_expr('coalesce(ps.utility_score, 0.0)', 'p.utility_min', 'p.utility_max')} AS utility_score
    FROM post_scores ps CROSS JOIN params p""", "post_scores", extra=PARAMS_CTES))
def q_apply_norm(spark, sf):
    ps = T.post_scores(spark, sf)
    params = N.fit_norm(N.drop_incomplete(ps, ("body", "label")))
    return N.apply_norm(ps.select("id", "expertise_score", "utility_score"), params, "serve", default=0.0)


_TRAIN_CTES = PARAMS_CTES + [
    ("clean", "SELECT * FROM post_scores WHERE body IS NOT NULL AND label IS NOT NULL"),
    ("med", """SELECT coalesce(median(expertise_score), 0.0) AS me, coalesce(median(utility_score), 0.0) AS mu
               FROM clean"""),
    ("imputed", """SELECT c.id, c.label, coalesce(c.expertise_score, m.me) AS expertise_score,
                          coalesce(c.utility_score, m.mu) AS utility_score FROM clean c CROSS JOIN med m"""),
    ("trained", f"""SELECT i.id, i.label,
                      {norm_expr('i.expertise_score', 'p.expertise_min', 'p.expertise_max', '1e-10', False)}
                        AS expertise_score,
                      {norm_expr('i.utility_score', 'p.utility_min', 'p.utility_max', '1e-10', False)}
                        AS utility_score
                    FROM imputed i CROSS JOIN params p"""),
]


def _trained(spark, sf):
    clean = N.drop_incomplete(T.post_scores(spark, sf), ("body", "label"))
    params = N.fit_norm(clean)
    return N.apply_norm(N.impute_median(clean), params, "train")


@register("impute_median", with_views("SELECT id, label, expertise_score, utility_score FROM imputed",
                                      "post_scores", extra=_TRAIN_CTES))
def q_impute_median(spark, sf):
    clean = N.drop_incomplete(T.post_scores(spark, sf), ("body", "label"))
    return N.impute_median(clean).select("id", "label", "expertise_score", "utility_score")


@register("apply_norm_train", with_views("SELECT * FROM trained", "post_scores", extra=_TRAIN_CTES))
def q_apply_norm_train(spark, sf):
    return _trained(spark, sf).select("id", "label", "expertise_score", "utility_score")


@register("layer_norm", with_views("""
    SELECT id, (expertise_score - m) / sqrt(v + 1e-05) * 1.0 + 0.0 AS ln_a,
               (utility_score - m) / sqrt(v + 1e-05) * 1.0 + 0.0 AS ln_b
    FROM (SELECT *, ((expertise_score - m) * (expertise_score - m) + (utility_score - m) * (utility_score - m))
                    / 2.0 AS v
          FROM (SELECT *, (expertise_score + utility_score) / 2.0 AS m FROM trained) a) b""",
                                   "post_scores", extra=_TRAIN_CTES))
def q_layer_norm(spark, sf):
    return _trained(spark, sf).select("id", *SC.layer_norm("expertise_score", "utility_score"))


# ---------------------------------------------------------------- quality
_STATS_COLS = """COUNT(*) AS count, round(AVG(expertise_score), 12) AS avg_expertise,
    round(AVG(utility_score), 12) AS avg_utility, round(stddev_samp(expertise_score), 12) AS std_expertise,
    round(stddev_samp(utility_score), 12) AS std_utility"""


@register("label_stats", with_views(f"SELECT label, {_STATS_COLS} FROM post_scores GROUP BY label", "post_scores"))
def q_label_stats(spark, sf):
    return Q.label_stats(T.post_scores(spark, sf))


_IMB_SQL = """SELECT c0, c1, CASE WHEN n_labels + coalesce(has_null, 0) > 1
        THEN round(CAST(greatest(c0, c1) AS DOUBLE) / (least(c0, c1) + 1), 12) END AS imbalance_ratio,
        coalesce(CASE WHEN n_labels + coalesce(has_null, 0) > 1
                 THEN CAST(greatest(c0, c1) AS DOUBLE) / (least(c0, c1) + 1) END, 0.0) > 10.0 AS severe
    FROM (SELECT CAST(count_if(label = 0) AS BIGINT) AS c0, CAST(count_if(label = 1) AS BIGINT) AS c1,
                 COUNT(DISTINCT label) AS n_labels,
                 MAX(CAST(label IS NULL AS INTEGER)) AS has_null FROM post_scores) a"""


@register("class_imbalance", with_views(_IMB_SQL, "post_scores"))
def q_class_imbalance(spark, sf):
    return Q.class_imbalance(T.post_scores(spark, sf))


_FSTATS_SQL = """SELECT round(AVG(expertise_score), 12) AS avg_expertise,
        round(stddev_samp(expertise_score), 12) AS std_expertise,
        round(AVG(utility_score), 12) AS avg_utility, round(stddev_samp(utility_score), 12) AS std_utility,
        CAST(count_if(expertise_score IS NULL) AS BIGINT) AS null_expertise,
        CAST(count_if(utility_score IS NULL) AS BIGINT) AS null_utility,
        COUNT(*) AS n_rows FROM post_scores WHERE label = 1"""


@register("feature_stats", with_views(_FSTATS_SQL, "post_scores"))
def q_feature_stats(spark, sf):
    return Q.feature_stats(T.post_scores(spark, sf))


_DIAGNOSE_SQL = with_views("""
    SELECT 'class_imbalance' AS "check", imbalance_ratio AS value, CAST(10.0 AS DOUBLE) AS threshold,
           coalesce(severe, false) AS failed FROM imb
    UNION ALL SELECT 'no_eval_data', CAST(n_rows AS DOUBLE), 0.0, n_rows = 0 FROM fs
    UNION ALL SELECT 'low_variance_expertise', std_expertise, 0.1, coalesce(std_expertise < 0.1, false) FROM fs
    UNION ALL SELECT 'low_variance_utility', std_utility, 0.1, coalesce(std_utility < 0.1, false) FROM fs
    UNION ALL SELECT 'feature_scale_mismatch', v, 10.0, coalesce(v > 10.0, false)
              FROM (SELECT round(AVG(avg_expertise), 12) AS v FROM ls) x""", "post_scores", extra=[
    ("imb", _IMB_SQL), ("fs", _FSTATS_SQL),
    ("ls", f"SELECT label, {_STATS_COLS} FROM post_scores GROUP BY label")])


@register("diagnose", _DIAGNOSE_SQL)
def q_diagnose(spark, sf):
    return Q.diagnose(T.post_scores(spark, sf))


# ---------------------------------------------------------------- windows, top-k, head
@register("rank_within", with_views("""
    SELECT query_id, doc_id, semantic,
           row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, doc_id) AS rank FROM sem""",
                                    "queries", "corpus", "post_scores", extra=search_ctes()))
def q_rank_within(spark, sf):
    """Rank each query's recalled candidates (at most k_recall per query) by the pair score."""
    from relevo.plans.q_search import ranked
    r = ranked(spark, sf).select("query_id", "doc_id", "semantic")
    return rank_within(r, "query_id", [F.col("semantic").desc(), F.col("doc_id")])


@register("top_k", """
    SELECT * FROM (SELECT doc_id, source, n_chars,
           row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) t
    WHERE rank <= 3""")
def q_top_k(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return top_k(d, 3, "source", [F.col("n_chars").desc(), F.col("doc_id")])


@register("head_row", with_views(f"""
    SELECT author, subreddit, CAST(total_upvotes AS DOUBLE) AS total_upvotes,
           CASE WHEN g.t = 0 THEN NULL ELSE CAST(total_upvotes AS DOUBLE) / g.t END AS topical_focus_score,
           round(ln(post_count + 1), 12) AS activity_density
    FROM ua, (SELECT CAST(SUM(total_upvotes) AS DOUBLE) AS t FROM ua) g
    WHERE total_upvotes >= 10 ORDER BY topical_focus_score DESC NULLS LAST, author, subreddit LIMIT 1""",
                                 "activity", extra=[("ua", f"""
    SELECT author, subreddit, COUNT(id) AS post_count, SUM(score) AS total_upvotes
    FROM activity WHERE created_utc < TIMESTAMP '{T.FIXTURE_CUTOFF}' AND author IS NOT NULL
    GROUP BY author, subreddit""")]))
def q_head_row(spark, sf):
    rep = G.topical_reputation(T.activity(spark, sf), T.FIXTURE_CUTOFF, 10)
    return G.head_row(rep, ["author", "subreddit"])


# ---------------------------------------------------------------- vectors (V2, V3)
@register("check_vectors", """
    SELECT vec_id, label, len(embedding) = 64 AS dim_ok, NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))
           AS finite, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) > 0 AS nonzero,
           len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))
           AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) > 0 AS valid
    FROM embeddings""")
def q_check_vectors(spark, sf):
    return V.check_vectors(T.vectors(spark, sf), "embedding", 64).select("vec_id", "label", "dim_ok", "finite",
                                                                         "nonzero", "valid")


_KNN_SQL = """
WITH x AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings),
m AS (SELECT label, pos, AVG(CAST(v AS DOUBLE)) AS m FROM x GROUP BY label, pos),
c AS (SELECT label AS query_id, list(m ORDER BY pos) AS centroid FROM m GROUP BY label),
s AS (SELECT c.query_id, e.vec_id,
             round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.centroid), 9) AS score
      FROM c CROSS JOIN embeddings e)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t
WHERE rank <= 10"""


@register("knn", _KNN_SQL)
def q_knn(spark, sf):
    vecs = T.vectors(spark, sf)
    cents = V.centroids(vecs, "label", "embedding").select(F.col("label").alias("query_id"), "vector")
    return V.knn(cents, vecs, 10)


def _label_centroids(vecs):
    return V.centroids(vecs, "label", "embedding").select(F.col("label").alias("query_id"), "vector")


@register("knn_inverted")
def q_knn_inverted(spark, sf):
    """Every vector whose id is divisible by 100 as a query against the inverted file of all."""
    vecs = T.vectors(spark, sf)
    asked = vecs.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return V.knn_inverted(asked, vecs, 10)


@register("knn_inverted_all", _KNN_SQL)
def q_knn_inverted_all(spark, sf):
    """The inverted file with every list probed: the exact result."""
    vecs = T.vectors(spark, sf)
    return V.knn_inverted(_label_centroids(vecs), vecs, 10, nprobe=16, n_lists=16)


# ---------------------------------------------------------------- training data (M1, M2)
@register("split", with_views("""
    SELECT id, ((id % 2147483647) * 48271 + 42) % 2147483647 % 10000 < 1500 AS is_validation FROM post_scores""",
                              "post_scores"))
def q_split(spark, sf):
    return M.split(T.post_scores(spark, sf).select("id"), 0.15, 42)


@register("training_pairs", with_views(f"""
    SELECT id, {FIRST8.format(x='body')} AS query_text, body, expertise_score, utility_score, label
    FROM post_scores""", "post_scores"))
def q_training_pairs(spark, sf):
    return M.training_pairs(T.post_scores(spark, sf))


# ---------------------------------------------------------------- row / class counts
@register("sample_counts", with_views("""
    SELECT COUNT(*) AS loaded, CAST(count_if(body IS NOT NULL AND label IS NOT NULL) AS BIGINT) AS cleaned,
           CAST(count_if(label = 0) AS BIGINT) AS class_0, CAST(count_if(label = 1) AS BIGINT) AS class_1
    FROM post_scores""", "post_scores"))
def q_sample_counts(spark, sf):
    return Q.sample_counts(T.post_scores(spark, sf))
