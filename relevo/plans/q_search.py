"""Registered queries: text analysis, lexical retrieval, hybrid ranking, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from relevo.functions.text import POSSESSIVE_PATTERN, elision_pattern
from relevo.operators import analysis as A
from relevo.operators import evaluation as E
from relevo.operators import features as N
from relevo.operators import fusion as H
from relevo.operators import lexical as L
from relevo.operators.containment import qrels_by_containment
from relevo.operators.stats import rank_error, sketch_percentiles
from relevo.plans import search as S
from relevo.plans.oracle_search import (SUMMARY_SQL, bm25_ctes, cands_cte, per_query_ctes, proxy_ctes,
                                        ranked_ctes, search_ctes)
from relevo.plans.oracle_views import FIRST8, with_views, words
from relevo.plans.q_tables import HOLDOUT_SQL
from relevo.plans.registry import register
from relevo.sources import tables as T
from relevo.sources.readers import holdout

ALPHAS = [0.0, 0.2, 0.5, 0.8, 1.0]
TITLE_BOOST = 2.0  # [ours] weight of the title field in multi-field scoring


def _features(spark, sf):
    return T.doc_scores(spark, sf)


def ranked(spark, sf, alpha=0.2, indexed: bool = False):
    index = S.corpus_index(spark, sf) if indexed else None
    return S.ranked_candidates(T.queries(spark, sf), T.corpus(spark, sf).select("id", "body"),
                               _features(spark, sf), S.serving_params(spark, sf), alpha=alpha, index=index)


def _index(spark, sf):
    """Queries, their terms and an index restricted to the query vocabulary."""
    q = T.queries(spark, sf)
    qt = L.query_terms(q)
    return q, qt, L.build_index(T.corpus(spark, sf), "id", "body", vocabulary=qt)


# ---------------------------------------------------------------- analysis
@register("analyze", with_views(f"""
    SELECT id, unnest(range(len(toks))) AS pos, unnest(toks) AS term
    FROM (SELECT id, {words('body')} AS toks FROM corpus) t""", "corpus"))
def q_analyze(spark, sf):
    return A.analyze(T.corpus(spark, sf), "id", "body")


@register("analyze_whitespace", with_views("""
    SELECT id, unnest(range(len(toks))) AS pos, unnest(toks) AS term
    FROM (SELECT id, list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '') AS toks FROM corpus) t""",
                                           "corpus"))
def q_analyze_whitespace(spark, sf):
    return A.analyze(T.corpus(spark, sf), "id", "body", mode="whitespace")


@register("analyze_keyword", with_views("""
    SELECT page_id, CAST(0 AS BIGINT) AS pos, lower(path) AS term FROM paths""", "paths"))
def q_analyze_keyword(spark, sf):
    return A.analyze(T.paths(spark, sf), "page_id", "path", mode="keyword")


_STOP_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{lang}', '{w.replace(chr(39), chr(39) * 2)}')" for lang, w in A.stop_lists()) + ") s(lang, term)"


@register("remove_stopwords", with_views(f"""
    SELECT t.id, t.lang, t.pos, t.term
    FROM (SELECT id, lang, unnest(range(len(toks))) AS pos, unnest(toks) AS term
          FROM (SELECT id, lang, {words('body')} AS toks FROM corpus) x) t
    WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.term = t.term AND s.lang = t.lang)""", "corpus",
                                         extra=[("stops", _STOP_SQL)]))
def q_remove_stopwords(spark, sf):
    toks = A.analyze(T.corpus(spark, sf), "id", "body", keep=("lang",))
    return A.remove_stopwords(toks, A.stopword_table(spark), lang_col="lang").select("id", "lang", "pos", "term")


def _syn_sql():
    pairs = A.parse_synonyms(T.FIXTURE_SYNONYMS)
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ") s(lhs, rhs)"


_PHRASES = A.parse_phrases(T.FIXTURE_PHRASES)
_PHRASE_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{' '.join(left)}', {alt}, {part}, '{term}')" for left, rights in sorted(_PHRASES.items())
    for alt, right in enumerate(rights) for part, term in enumerate(right)) + ") s(lhs, alt, part, term)"
_LEFT_SIDES = "[" + ", ".join(f"'{' '.join(left)}'" for left in sorted(_PHRASES)) + "]"
_MATCHED = f"""list_max(list_transform(range(1, {max(map(len, _PHRASES)) + 1}), lambda k: CASE WHEN i + k - 1 <= len(toks)
    AND list_contains({_LEFT_SIDES}, array_to_string(list_slice(toks, i, i + k - 1), ' ')) THEN k ELSE 0 END))"""


@register("expand_phrases", f"""
    WITH RECURSIVE corpus AS (SELECT doc_id AS id, text AS body FROM documents), rules AS ({_PHRASE_SQL}),
    t AS (SELECT id, {words('body')} AS toks FROM corpus),
    -- i: first token of a step (1-based), n: tokens of the rule that matches there (0: none)
    step AS (SELECT id, toks, CAST(1 AS BIGINT) AS i FROM t WHERE len(toks) > 0),
    walk AS (
        SELECT id, toks, i, {_MATCHED} AS n FROM step
        UNION ALL
        SELECT id, toks, i, {_MATCHED} AS n FROM (SELECT id, toks, i + greatest(n, 1) AS i FROM walk) w WHERE i <= len(toks))
    SELECT id, i - 1 AS pos, greatest(n, 1) AS span, coalesce(r.alt, 0) AS alt, coalesce(r.part, 0) AS part,
           coalesce(r.term, toks[i]) AS term
    FROM walk LEFT JOIN rules r ON n > 0 AND r.lhs = array_to_string(list_slice(toks, i, i + n - 1), ' ')""")
def q_expand_phrases(spark, sf):
    """Rules of several words over all texts, positions kept."""
    return A.expand_phrases(T.corpus(spark, sf).select("id", "body"), T.FIXTURE_PHRASES, "id", "body")


@register("expand_synonyms", with_views(f"""
    SELECT q.query_id, coalesce(s.rhs, q.term) AS term, q.qtf
    FROM (SELECT query_id, term, COUNT(*) AS qtf FROM
            (SELECT query_id, unnest({words('query_text')}) AS term
             FROM (SELECT 'b' || CAST(query_id AS VARCHAR) AS query_id, query_text FROM queries
                   UNION ALL SELECT 't' || CAST(id AS VARCHAR), title FROM corpus) u) t
          GROUP BY query_id, term) q
    LEFT JOIN syn s ON s.lhs = q.term""", "queries", "corpus", extra=[("syn", _syn_sql())]))
def q_expand_synonyms(spark, sf):
    # queries: the benchmark items ('b' ids) plus every post title ('t' ids)
    titles = T.corpus(spark, sf).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("query_id"),
                                        F.col("title").alias("query_text"))
    bench = T.queries(spark, sf).select(F.concat(F.lit("b"), F.col("query_id").cast("string")).alias("query_id"),
                                        "query_text")
    qs = bench.unionByName(titles)
    return A.expand_synonyms(L.query_terms(qs), A.synonym_table(spark, T.FIXTURE_SYNONYMS)).select("query_id", "term", "qtf")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# the fixture texts hold no apostrophes: the first space of a text becomes an elided article or a possessive
_ELIDED = "regexp_replace(body, ' ', ' l' || chr(39))"
_OWNED = "regexp_replace(body, ' ', chr(39) || 's ')"


@register("strip_elision", with_views(f"""
    SELECT id, CASE WHEN lang = 'fr' THEN regexp_replace({_ELIDED}, {_sql_str(elision_pattern('fr'))}, '\\1', 'g')
        ELSE {_ELIDED} END AS body FROM corpus""", "corpus"))
def q_strip_elision(spark, sf):
    from relevo.functions.text import strip_elision
    c = T.corpus(spark, sf).select("id", "lang", F.regexp_replace("body", "^([^ ]*) ", "$1 l'").alias("body"))
    return c.select("id", F.when(F.col("lang") == "fr", strip_elision("body", "fr")).otherwise(F.col("body"))
                    .alias("body"))


@register("strip_possessive", with_views(f"""
    SELECT id, CASE WHEN lang = 'en' THEN regexp_replace({_OWNED}, {_sql_str(POSSESSIVE_PATTERN)}, '\\1', 'g')
        ELSE {_OWNED} END AS body FROM corpus""", "corpus"))
def q_strip_possessive(spark, sf):
    from relevo.functions.text import strip_possessive
    c = T.corpus(spark, sf).select("id", "lang", F.regexp_replace("body", "^([^ ]*) ", "$1's ").alias("body"))
    return c.select("id", F.when(F.col("lang") == "en", strip_possessive("body")).otherwise(F.col("body"))
                    .alias("body"))


@register("distinct_terms", with_views(f"""
    SELECT id, len(toks) AS n_terms, len(list_distinct(toks)) AS n_distinct
    FROM (SELECT id, {words('body')} AS toks FROM corpus) t""", "corpus"))
def q_distinct_terms(spark, sf):
    c = T.corpus(spark, sf)
    return c.select("id", F.size(A.token_array(F.col("body"))).cast("long").alias("n_terms"),
                    F.size(A.distinct_terms(F.col("body"))).cast("long").alias("n_distinct"))


@register("path_rollup", with_views("""
    SELECT ancestor, MAX(d) + 1 AS depth, COUNT(*) AS n FROM (
      SELECT i - 1 AS d, array_to_string(list_slice(segs, 1, i), '/') AS ancestor
      FROM (SELECT list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM paths) p,
           LATERAL (SELECT unnest(range(1, len(segs) + 1)) AS i) r) x
    GROUP BY ancestor""", "paths"))
def q_path_rollup(spark, sf):
    return A.path_rollup(T.paths(spark, sf), "path")


@register("corpus_stats", with_views(f"""
    SELECT CAST(count_if(len(toks) > 0) AS BIGINT) AS n_docs, CAST(SUM(len(toks)) AS BIGINT) AS total_terms,
           CAST(SUM(len(toks)) AS DOUBLE) / count_if(len(toks) > 0) AS avgdl
    FROM (SELECT {words('body')} AS toks FROM corpus) t""", "corpus"))
def q_corpus_stats(spark, sf):
    return A.corpus_stats(A.doc_lengths(T.corpus(spark, sf), "id", "body").select("dl"))


@register("term_df", with_views(f"""
    SELECT term, COUNT(DISTINCT id) AS df FROM (SELECT id, unnest({words('body')}) AS term FROM corpus) t
    GROUP BY term""", "corpus"))
def q_term_df(spark, sf):
    return A.term_document_frequency(L.build_postings(T.corpus(spark, sf)))


# ---------------------------------------------------------------- lexical
@register("query_from_body", with_views(f"""
    SELECT id AS query_id, {FIRST8.format(x="regexp_replace(body, '<.*?>', '', 'g')")} AS query_text
    FROM posts""", "posts"))
def q_query_from_body(spark, sf):
    return L.query_from_body(T.corpus(spark, sf), remove_tags=True)


@register("build_postings", with_views(f"""
    SELECT doc_id, dl, term, COUNT(*) AS tf
    FROM (SELECT id AS doc_id, len(toks) AS dl, unnest(toks) AS term
          FROM (SELECT id, {words('body')} AS toks FROM corpus) x) t
    GROUP BY doc_id, dl, term""", "corpus"))
def q_build_postings(spark, sf):
    return L.build_postings(T.corpus(spark, sf))


@register("bm25", with_views("SELECT * FROM scored", "queries", "corpus", extra=bm25_ctes()))
def q_bm25(spark, sf):
    """All matching pairs: the operator's own output, which retrieval cuts to the top k."""
    _, qt, idx = _index(spark, sf)
    return L.bm25(qt, idx)


@register("retrieve", with_views("SELECT * FROM cands", "queries", "corpus", extra=bm25_ctes() + [cands_cte(50)]))
def q_retrieve(spark, sf):
    _, qt, idx = _index(spark, sf)
    return L.retrieve(L.bm25(qt, idx), 50)


@register("retrieve_pruned", with_views("SELECT * FROM cands", "queries", "corpus", extra=bm25_ctes() + [cands_cte(50)]))
def q_retrieve_pruned(spark, sf):
    """L3 + L4 with candidates cut by score bounds, the plan for large query tables."""
    _, qt, idx = _index(spark, sf)
    return L.top_documents(qt, idx, 50)


@register("retrieve_indexed", with_views("SELECT * FROM cands", "queries", "corpus",
                                         extra=bm25_ctes() + [cands_cte(50)]))
def q_retrieve_indexed(spark, sf):
    """L3 + L4 against the persisted corpus index (inverted-index lookup of the query terms)."""
    q = T.queries(spark, sf)
    qt = L.query_terms(q)
    return L.retrieve(L.bm25(qt, L.lookup(S.corpus_index(spark, sf), qt)), 50)


def _bm25_syn_ctes():
    """CTEs ending in ``scored``: synonym-blended BM25 (mirrors ``L.bm25_synonyms``)."""
    return [
        ("syn", _syn_sql()),
        ("qt", f"""SELECT query_id, term, COUNT(*) AS qtf
            FROM (SELECT query_id, unnest({words('query_text')}) AS term FROM queries) t GROUP BY query_id, term"""),
        ("ex", """SELECT DISTINCT q.query_id, q.term AS grp, coalesce(s.rhs, q.term) AS term, q.qtf
                  FROM qt q LEFT JOIN syn s ON s.lhs = q.term"""),
        ("dt", f"SELECT id AS doc_id, {words('body')} AS toks FROM corpus"),
        ("st", """SELECT CAST(count_if(len(toks) > 0) AS DOUBLE) AS n_docs,
                  CAST(SUM(len(toks)) AS DOUBLE) / count_if(len(toks) > 0) AS avgdl FROM dt"""),
        ("post", """SELECT doc_id, dl, term, COUNT(*) AS tf
            FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM dt) t
            WHERE term IN (SELECT term FROM ex) GROUP BY doc_id, dl, term"""),
        ("dfq", "SELECT term, CAST(COUNT(*) AS DOUBLE) AS df FROM post GROUP BY term"),
        ("grp", """SELECT e.query_id, e.grp, MAX(e.qtf) AS qtf, MAX(d.df) AS df
                   FROM ex e JOIN dfq d ON d.term = e.term GROUP BY e.query_id, e.grp"""),
        ("nq", "SELECT query_id, COUNT(*) AS nq FROM (SELECT DISTINCT query_id, grp FROM ex) t GROUP BY query_id"),
        ("w", """SELECT g.query_id, g.grp, n.nq,
                        g.qtf * ln(1.0 + (st.n_docs - g.df + 0.5) / (g.df + 0.5)) AS w
                 FROM grp g JOIN nq n ON n.query_id = g.query_id CROSS JOIN st"""),
        ("scored", """
    SELECT query_id, doc_id, round(SUM(c), 9) AS score, COUNT(*) AS matched, MAX(nq) AS n_query_terms FROM (
      SELECT g.query_id, g.doc_id, w.nq,
             w.w * g.tf / (g.tf + 1.2 * (0.25 + 0.75 * g.dl / st.avgdl)) AS c
      FROM (SELECT e.query_id, e.grp, p.doc_id, p.dl, SUM(p.tf) AS tf
            FROM post p JOIN ex e ON p.term = e.term GROUP BY e.query_id, e.grp, p.doc_id, p.dl) g
      JOIN w ON w.query_id = g.query_id AND w.grp = g.grp CROSS JOIN st) x
    GROUP BY query_id, doc_id"""),
    ]


@register("bm25_synonyms", with_views("SELECT * FROM cands", "queries", "corpus",
                                      extra=_bm25_syn_ctes() + [cands_cte(50)]))
def q_bm25_synonyms(spark, sf):
    qt = L.query_terms(T.queries(spark, sf))
    return L.retrieve(L.bm25_synonyms(qt, A.synonym_table(spark, T.FIXTURE_SYNONYMS), T.corpus(spark, sf)), 50)


# benchmark queries, of which every third is made of terms that no text holds
_MIXED_SQL = "SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'zq' || query_id ELSE query_text END AS query_text FROM queries"


@register("queries_without_hits", with_views("""
    SELECT * FROM mixed q WHERE NOT EXISTS (SELECT 1 FROM cands c WHERE c.query_id = q.query_id)""",
                                             "queries", "corpus",
                                             extra=[("mixed", _MIXED_SQL)] + bm25_ctes("mixed") + [cands_cte(50)]))
def q_queries_without_hits(spark, sf):
    none = F.concat(F.lit("zq"), F.col("query_id").cast("string"))
    q = T.queries(spark, sf).withColumn("query_text", F.when(F.col("query_id") % 3 == 0, none).otherwise(F.col("query_text")))
    qt = L.query_terms(q)
    idx = L.build_index(T.corpus(spark, sf), "id", "body", vocabulary=qt)
    return L.queries_without_hits(q, L.retrieve(L.bm25(qt, idx), 50))


@register("multi_field_bm25", with_views("""
    SELECT * FROM cands""", "queries", "corpus",
                                         extra=bm25_ctes(field="title", p="t_") + bm25_ctes(field="body", p="b_") + [
    ("both_fields", f"""SELECT query_id, doc_id, round(SUM(s), 9) AS score FROM (
        SELECT query_id, doc_id, score * {TITLE_BOOST} AS s FROM t_scored
        UNION ALL SELECT query_id, doc_id, score * 1.0 AS s FROM b_scored) u GROUP BY query_id, doc_id"""),
    cands_cte(50, "both_fields")]))
def q_multi_field_bm25(spark, sf):
    scored = L.multi_field_bm25(T.queries(spark, sf), T.corpus(spark, sf), {"title": TITLE_BOOST, "body": 1.0})
    return L.retrieve(scored, 50)


# ---------------------------------------------------------------- hybrid ranking
_RANKED_COLS = ("query_id, doc_id, lex_rank, hybrid_rank, score, lex_norm, semantic, hybrid, "
                "expertise_score, utility_score")


def _ranked_cols(df):
    return df.select(*[c.strip() for c in _RANKED_COLS.split(",")])


@register("hybrid_search", with_views(f"SELECT {_RANKED_COLS} FROM ranked WHERE hybrid_rank <= 10",
                                      "queries", "corpus", "post_scores", extra=search_ctes()))
def q_hybrid_search(spark, sf):
    return _ranked_cols(ranked(spark, sf).where(F.col("hybrid_rank") <= 10))


@register("hybrid_search_indexed", with_views(f"SELECT {_RANKED_COLS} FROM ranked WHERE hybrid_rank <= 10",
                                              "queries", "corpus", "post_scores", extra=search_ctes()))
def q_hybrid_search_indexed(spark, sf):
    """H2 against the persisted corpus index (built once per corpus, then only looked up)."""
    return _ranked_cols(ranked(spark, sf, indexed=True).where(F.col("hybrid_rank") <= 10))


@register("hybrid_search_synonyms", with_views(
    f"SELECT {_RANKED_COLS} FROM ranked WHERE hybrid_rank <= 10", "queries", "corpus", "post_scores",
    extra=_bm25_syn_ctes() + [cands_cte(50)] + ranked_ctes()))
def q_hybrid_search_synonyms(spark, sf):
    """H2 with query-time synonym expansion blended into BM25 (as the query analyzer does)."""
    r = S.ranked_candidates(T.queries(spark, sf), T.corpus(spark, sf).select("id", "body"), _features(spark, sf),
                            S.serving_params(spark, sf), synonyms=A.synonym_table(spark, T.FIXTURE_SYNONYMS))
    return _ranked_cols(r.where(F.col("hybrid_rank") <= 10))


@register("fuse", with_views(f"SELECT {_RANKED_COLS} FROM ranked", "queries", "corpus", "post_scores",
                             extra=search_ctes()))
def q_fuse(spark, sf):
    return _ranked_cols(ranked(spark, sf))


@register("minmax_per_query", with_views("SELECT query_id, doc_id, score, lex_norm FROM mm",
                                         "queries", "corpus", "post_scores", extra=search_ctes()))
def q_minmax_per_query(spark, sf):
    return ranked(spark, sf).select("query_id", "doc_id", "score", "lex_norm")


@register("score_pairs", with_views("SELECT query_id, doc_id, coverage, expertise_score, utility_score, semantic FROM sem",
                                    "queries", "corpus", "post_scores", extra=search_ctes()))
def q_score_pairs(spark, sf):
    return ranked(spark, sf).select("query_id", "doc_id", "coverage", "expertise_score", "utility_score", "semantic")


@register("pair_features", with_views("""
    SELECT f.query_id, f.doc_id, f.matched, f.n_query_terms, f.coverage,
           round(f.matched / sqrt(f.n_query_terms * len(list_distinct(dt.toks))), 12) AS cosine,
           round(ln(len(dt.toks) + 1.0), 12) AS log_length
    FROM feat f JOIN dt ON dt.doc_id = f.doc_id""", "queries", "corpus", "post_scores", extra=search_ctes()))
def q_pair_features(spark, sf):
    """Pair features of all candidates; the documents' sizes travel with their stored features."""
    tokens = A.token_array(F.col("body"))
    sizes = T.corpus(spark, sf).select(F.col("id").alias("_id"), F.size(tokens).alias("dl"),
                                       F.size(F.array_distinct(tokens)).alias("n_doc_terms"))
    feats = _features(spark, sf).join(sizes, F.col("id") == F.col("_id")).drop("_id")
    r = S.ranked_candidates(T.queries(spark, sf), T.corpus(spark, sf).select("id", "body"), feats, S.serving_params(spark, sf))
    return r.select("query_id", "doc_id", "matched", "n_query_terms", "coverage", F.round("cosine", 12).alias("cosine"),
                    F.round("log_length", 12).alias("log_length"))


@register("compare_rankings", with_views("""
    SELECT coalesce(l.query_id, h.query_id) AS query_id, coalesce(l.doc_id, h.doc_id) AS doc_id,
           l.lex_rank, h.hybrid_rank, CASE WHEN l.lex_rank > h.hybrid_rank THEN l.lex_rank END AS was_rank
    FROM (SELECT query_id, doc_id, lex_rank FROM ranked WHERE lex_rank <= 10) l
    FULL OUTER JOIN (SELECT query_id, doc_id, hybrid_rank FROM ranked WHERE hybrid_rank <= 10) h
      ON l.query_id = h.query_id AND l.doc_id = h.doc_id""", "queries", "corpus", "post_scores",
                                         extra=search_ctes()))
def q_compare_rankings(spark, sf):
    return H.compare_rankings(ranked(spark, sf), 10)


@register("rank_shift", with_views("""
    SELECT h.query_id, h.doc_id, h.hybrid_rank,
           CASE WHEN l.lex_rank > h.hybrid_rank THEN l.lex_rank END AS was_rank
    FROM (SELECT query_id, doc_id, hybrid_rank FROM ranked WHERE hybrid_rank <= 10) h
    LEFT JOIN (SELECT query_id, doc_id, lex_rank FROM ranked WHERE lex_rank <= 10) l
      ON l.query_id = h.query_id AND l.doc_id = h.doc_id""", "queries", "corpus", "post_scores",
                                   extra=search_ctes()))
def q_rank_shift(spark, sf):
    r = ranked(spark, sf)
    lex = r.where(F.col("lex_rank") <= 10)
    hyb = r.where(F.col("hybrid_rank") <= 10)
    return H.rank_shift(lex, hyb).select("query_id", "doc_id", "hybrid_rank", "was_rank")


# ---------------------------------------------------------------- evaluation
@register("drop_thin_queries", with_views("SELECT query_id, doc_id, lex_rank FROM thick",
                                          "queries", "corpus", "post_scores", extra=search_ctes() + proxy_ctes()))
def q_drop_thin_queries(spark, sf):
    return E.drop_thin_queries(ranked(spark, sf)).select("query_id", "doc_id", "lex_rank")


@register("proxy_relevance", with_views("SELECT query_id, doc_id, lex_rank, score, rel FROM labelled",
                                        "queries", "corpus", "post_scores", extra=search_ctes() + proxy_ctes()))
def q_proxy_relevance(spark, sf):
    return E.proxy_relevance(E.drop_thin_queries(ranked(spark, sf))).select("query_id", "doc_id", "lex_rank",
                                                                            "score", "rel")


@register("ndcg", with_views("SELECT * FROM pq", "queries", "corpus", "post_scores",
                             extra=search_ctes() + proxy_ctes() + per_query_ctes()))
def q_ndcg(spark, sf):
    return E.per_query_metrics(E.proxy_relevance(E.drop_thin_queries(ranked(spark, sf))))


@register("evaluate_rankings", with_views(SUMMARY_SQL, "queries", "corpus", "post_scores",
                                          extra=search_ctes() + proxy_ctes() + per_query_ctes()))
def q_evaluate_rankings(spark, sf):
    return E.evaluate_rankings(ranked(spark, sf))


# ---------------------------------------------------------------- hold-out evaluation (S4 -> L1 -> H2 -> E1-E5)
_HOLDOUT_QUERIES = [("held", HOLDOUT_SQL), ("queries", f"""
    SELECT id AS query_id, {FIRST8.format(x="regexp_replace(body, '<.*?>', '', 'g')")} AS query_text FROM held""")]


@register("evaluate_holdout", with_views(SUMMARY_SQL, "corpus", "post_scores", extra=_HOLDOUT_QUERIES
                                         + search_ctes() + proxy_ctes() + per_query_ctes()))
def q_evaluate_holdout(spark, sf):
    """Held-out positive posts as queries (first words of the body, tags stripped) against the whole corpus."""
    held = holdout(T.post_scores(spark, sf))
    r = S.ranked_candidates(L.query_from_body(held), T.corpus(spark, sf).select("id", "body"), _features(spark, sf),
                            S.serving_params(spark, sf))
    return E.evaluate_rankings(r)


def _alpha_sql():
    parts = []
    for a in ALPHAS:
        parts.append(f"""SELECT CAST({a} AS DOUBLE) AS alpha, query_id, doc_id, lex_rank, score,
                         round({a} * lex_norm + {1.0 - a} * semantic, 9) AS hybrid FROM mm""")
    return " UNION ALL ".join(parts)


@register("alpha_sweep", with_views("""
    SELECT alpha, COUNT(*) AS n_queries, round(AVG(nd), 9) AS hybrid_ndcg FROM (
      SELECT alpha, query_id, CASE WHEN di > 0 THEN dh / di ELSE 0.0 END AS nd FROM (
        SELECT alpha, query_id, SUM(rel / log2(hr + 1)) AS dh, SUM(rel / log2(ir + 1)) AS di FROM (
          SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY hybrid DESC, lex_rank, doc_id) AS hr,
                    row_number() OVER (PARTITION BY alpha, query_id ORDER BY rel DESC, lex_rank) AS ir
          FROM (SELECT *, CASE WHEN n_q > 10 THEN CAST(score >= max(CASE WHEN lex_rank = 10 THEN score END)
                     OVER (PARTITION BY alpha, query_id) AS INTEGER) ELSE 1 END AS rel
                FROM (SELECT *, COUNT(*) OVER (PARTITION BY alpha, query_id) AS n_q FROM grid) g
                WHERE n_q >= 2) l) r
        GROUP BY alpha, query_id) a) b
    GROUP BY alpha""", "queries", "corpus", "post_scores", extra=search_ctes() + [("grid", _alpha_sql())]))
def q_alpha_sweep(spark, sf):
    from pyspark.sql import Window
    g = H.alpha_grid(ranked(spark, sf).select("query_id", "doc_id", "lex_rank", "score", "lex_norm", "semantic"),
                     ALPHAS)
    w = Window.partitionBy("alpha", "query_id")
    g = g.withColumn("n_q", F.count(F.lit(1)).over(w)).where(F.col("n_q") >= 2)
    kth = F.max(F.when(F.col("lex_rank") == 10, F.col("score"))).over(w)
    g = g.withColumn("rel", F.when(F.col("n_q") > 10, (F.col("score") >= kth).cast("int")).otherwise(F.lit(1)))
    g = g.withColumn("hr", F.row_number().over(w.orderBy(F.col("hybrid").desc(), "lex_rank", "doc_id")))
    g = g.withColumn("ir", F.row_number().over(w.orderBy(F.col("rel").desc(), "lex_rank")))
    pq = g.groupBy("alpha", "query_id").agg(
        F.sum(F.col("rel") / F.log2(F.col("hr") + 1)).alias("dh"), F.sum(F.col("rel") / F.log2(F.col("ir") + 1)).alias("di"))
    pq = pq.select("alpha", F.when(F.col("di") > 0, F.col("dh") / F.col("di")).otherwise(0.0).alias("nd"))
    return pq.groupBy("alpha").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("nd"), 9).alias("hybrid_ndcg"))


_QRELS_EVAL_SQL = """
SELECT n_queries, round(l, 9) AS lexical_ndcg, round(h, 9) AS hybrid_ndcg,
       round((h - l) / (l + 1e-9) * 100.0, 6) AS lift_pct,
       round(lr * 100.0, 9) AS lexical_recall_pct, round(hr * 100.0, 9) AS hybrid_recall_pct
FROM (SELECT COUNT(*) AS n_queries, AVG(coalesce(dl, 0.0) / di) AS l, AVG(coalesce(dh, 0.0) / di) AS h,
             AVG(coalesce(fl, 0) / n_rel) AS lr, AVG(coalesce(fh, 0) / n_rel) AS hr
      FROM (SELECT j.query_id, j.n_rel, g.dl, g.dh, g.fl, g.fh,
                   list_sum(list_transform(range(1, least(10, j.n_rel) + 1), lambda i: 1.0 / log2(i + 1))) AS di
            FROM (SELECT query_id, COUNT(DISTINCT doc_id) AS n_rel FROM qrels WHERE rel > 0 GROUP BY query_id) j
            LEFT JOIN (SELECT query_id,
                          SUM(CASE WHEN lex_rank <= 10 THEN rel / log2(lex_rank + 1) END) AS dl,
                          SUM(CASE WHEN hybrid_rank <= 10 THEN rel / log2(hybrid_rank + 1) END) AS dh,
                          SUM(CASE WHEN lex_rank <= 10 THEN rel END) AS fl,
                          SUM(CASE WHEN hybrid_rank <= 10 THEN rel END) AS fh
                       FROM (SELECT r.*, coalesce(q.rel, 0) AS rel FROM ranked r
                             LEFT JOIN (SELECT DISTINCT query_id, doc_id, rel FROM qrels) q
                               ON q.query_id = r.query_id AND q.doc_id = r.doc_id) x
                       GROUP BY query_id) g ON g.query_id = j.query_id) y) z"""


@register("evaluate_qrels", with_views(_QRELS_EVAL_SQL, "queries", "corpus", "post_scores", "qrels",
                                       extra=search_ctes()))
def q_evaluate_qrels(spark, sf):
    return E.evaluate_qrels(ranked(spark, sf), S.judged_pairs(spark, sf), 10)


@register("with_qrels", with_views("""
    SELECT r.query_id, r.doc_id, r.lex_rank, coalesce(q.rel, 0) AS rel FROM ranked r
    LEFT JOIN (SELECT DISTINCT query_id, doc_id, rel FROM qrels) q ON q.query_id = r.query_id AND q.doc_id = r.doc_id""",
                                   "queries", "corpus", "post_scores", "qrels", extra=search_ctes()))
def q_with_qrels(spark, sf):
    return E.with_qrels(ranked(spark, sf), S.judged_pairs(spark, sf)).select("query_id", "doc_id", "lex_rank",
                                                                                   "rel")


@register("qrels", with_views("SELECT query_id, doc_id, rel FROM qrels", "qrels"))
def q_qrels(spark, sf):
    return qrels_by_containment(spark, sf)


@register("latency_summary", with_views("""
    SELECT COUNT(latency_ms) AS n, quantile_cont(latency_ms, 0.99) AS p99_ms FROM latency""", "latency"))
def q_latency_summary(spark, sf):
    return E.latency_summary(T.latency(spark, sf), "latency_ms", 0.99)


_SHARES = (0.5, 0.9, 0.99)


@register("latency_sketch", f"""
    SELECT event_type, COUNT(value) AS n, CAST(p AS DOUBLE) AS p, TRUE AS within_error
    FROM events CROSS JOIN (VALUES {", ".join(f"({p})" for p in _SHARES)}) s(p) GROUP BY event_type, p""")
def q_latency_sketch(spark, sf):
    """Sketched percentiles of each event type, held against the values' real ranks: a value below which, or up
    to which, the asked share of the rows lies within twice the sketch's stated rank error."""
    latency = T.table(spark, sf, "events").select("event_type", F.col("value").alias("latency_ms"))
    kept = sketch_percentiles(latency, "latency_ms", list(_SHARES), by=("event_type",)).select(
        F.col("event_type").alias("type"), "quantiles")
    error = 2 * rank_error()
    of = [F.element_at("quantiles", i + 1) for i in range(len(_SHARES))]
    ranks = (latency.join(kept, F.col("event_type").eqNullSafe(F.col("type"))).groupBy("event_type")
             .agg(F.count("latency_ms").alias("n"), *[
                 F.array(F.count_if(F.col("latency_ms") < q), F.count_if(F.col("latency_ms") <= q)).alias(f"r{i}")
                 for i, q in enumerate(of)]))
    each = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"r{i}").alias("r")) for i, p in enumerate(_SHARES)])
    return ranks.select("event_type", "n", F.inline(each)).select(
        "event_type", "n", "p", ((F.col("r")[0] <= (F.col("p") + error) * F.col("n")) &
                                 (F.col("r")[1] >= (F.col("p") - error) * F.col("n"))).alias("within_error"))


# ---------------------------------------------------------------- pass-through with score
@register("retrieve_documents", with_views("""
    SELECT c.query_id, c.doc_id, c.lex_rank, c.score, d.title, d.body
    FROM cands c JOIN corpus d ON d.id = c.doc_id""", "queries", "corpus", extra=bm25_ctes() + [cands_cte(50)]))
def q_retrieve_documents(spark, sf):
    """Candidates with their stored fields: the candidate set (bounded by
    #queries x k) is joined back to the documents."""
    _, qt, idx = _index(spark, sf)
    cands = L.retrieve(L.bm25(qt, idx), 50)
    docs = T.corpus(spark, sf).select(F.col("id").alias("doc_id"), "title", "body")
    return docs.join(cands, "doc_id").select("query_id", "doc_id", "lex_rank", "score", "title", "body")


# ---------------------------------------------------------------- full evaluation report (E5 + G10)
@register("evaluation_report", with_views(f"""
    SELECT s.*, l.p99_ms FROM ({SUMMARY_SQL}) s,
         (SELECT quantile_cont(latency_ms, 0.99) AS p99_ms FROM latency) l""",
                                          "queries", "corpus", "post_scores", "latency",
                                          extra=search_ctes() + proxy_ctes() + per_query_ctes()))
def q_evaluation_report(spark, sf):
    """The summary the evaluation prints: both nDCGs, lift, recall and the p99 latency."""
    summary = E.evaluate_rankings(ranked(spark, sf))
    p99 = E.latency_summary(T.latency(spark, sf), "latency_ms", 0.99).select("p99_ms")
    return _attach_scalar(summary, p99, "p99_ms")


def _attach_scalar(df, one_row, col):
    """Add a one-row result as a column (scalar subquery, not a join)."""
    return df.withColumn(col, one_row.select(col).scalar())
