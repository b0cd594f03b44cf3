"""DuckDB building blocks for the retrieval / ranking / evaluation oracles.

Each function returns ``(name, sql)`` CTEs that mirror the Spark operators
expression by expression (same operation order, same rounding points).
"""

from __future__ import annotations

from relevo.plans.oracle_views import words


def bm25_ctes(queries: str = "queries", corpus: str = "corpus", field: str = "body", p: str = "",
              k1: float = 1.2, b: float = 0.75) -> list[tuple[str, str]]:
    return [
        (f"{p}qt", f"""SELECT query_id, term, COUNT(*) AS qtf
            FROM (SELECT query_id, unnest({words('query_text')}) AS term FROM {queries}) t
            GROUP BY query_id, term"""),
        (f"{p}qn", f"SELECT query_id, COUNT(*) AS nq FROM {p}qt GROUP BY query_id"),
        (f"{p}dt", f"SELECT id AS doc_id, {words(field)} AS toks FROM {corpus}"),
        (f"{p}st", f"""SELECT CAST(count_if(len(toks) > 0) AS DOUBLE) AS n_docs,
                   CAST(SUM(len(toks)) AS DOUBLE) / count_if(len(toks) > 0) AS avgdl FROM {p}dt"""),
        (f"{p}post", f"""SELECT doc_id, dl, term, COUNT(*) AS tf
            FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM {p}dt) t
            WHERE term IN (SELECT term FROM {p}qt) GROUP BY doc_id, dl, term"""),
        (f"{p}dfq", f"SELECT term, CAST(COUNT(*) AS DOUBLE) AS df FROM {p}post GROUP BY term"),
        (f"{p}wq", f"""SELECT qt.query_id, qt.term, qn.nq,
                   qt.qtf * ln(1.0 + (st.n_docs - dfq.df + 0.5) / (dfq.df + 0.5)) AS w
            FROM {p}qt qt JOIN {p}qn qn ON qt.query_id = qn.query_id JOIN {p}dfq dfq ON qt.term = dfq.term
            CROSS JOIN {p}st st"""),
        (f"{p}scored", f"""SELECT wq.query_id, post.doc_id,
                   round(SUM(wq.w * post.tf / (post.tf + {k1} * ({1.0 - b} + {b} * post.dl / st.avgdl))), 9) AS score,
                   COUNT(*) AS matched, MAX(wq.nq) AS n_query_terms
            FROM {p}post post JOIN {p}wq wq ON post.term = wq.term CROSS JOIN {p}st st
            GROUP BY wq.query_id, post.doc_id"""),
    ]


def cands_cte(k: int = 50, src: str = "scored") -> tuple[str, str]:
    return ("cands", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY score DESC, doc_id ASC) AS lex_rank FROM {src}) t WHERE lex_rank <= {k}""")


PARAMS_CTES = [
    ("pr", """SELECT min(expertise_score) AS emin, max(expertise_score) AS emax,
                     min(utility_score) AS umin, max(utility_score) AS umax
              FROM post_scores WHERE body IS NOT NULL AND label IS NOT NULL"""),
    ("params", """SELECT
        CAST(CASE WHEN emin IS NULL OR emax IS NULL OR emin = emax THEN 0.0 ELSE emin END AS DOUBLE) AS expertise_min,
        CAST(CASE WHEN emin IS NULL OR emax IS NULL OR emin = emax THEN 1000.0 ELSE emax END AS DOUBLE) AS expertise_max,
        CAST(CASE WHEN umin IS NULL OR umax IS NULL OR umin = umax THEN 0.0 ELSE umin END AS DOUBLE) AS utility_min,
        CAST(CASE WHEN umin IS NULL OR umax IS NULL OR umin = umax THEN 2.0 ELSE umax END AS DOUBLE) AS utility_max
        FROM pr"""),
]


def norm_expr(x: str, lo: str, hi: str, eps: str = "1e-6", clip: bool = True) -> str:
    y = f"(({x}) - {lo}) / ({hi} - {lo} + {eps})"
    return f"greatest(0.0, least(1.0, {y}))" if clip else y


def ranked_ctes(alpha: float = 0.2) -> list[tuple[str, str]]:
    """Candidates -> features -> logistic semantic -> min-max -> hybrid -> ranks."""
    e = norm_expr("coalesce(ps.expertise_score, 0.0)", "p.expertise_min", "p.expertise_max")
    u = norm_expr("coalesce(ps.utility_score, 0.0)", "p.utility_min", "p.utility_max")
    return PARAMS_CTES + [
        ("feat", f"""SELECT c.*, {e} AS expertise_score, {u} AS utility_score,
                     CAST(c.matched AS DOUBLE) / c.n_query_terms AS coverage
              FROM cands c JOIN post_scores ps ON ps.id = c.doc_id CROSS JOIN params p"""),
        ("sem", """SELECT *, round(1.0 / (1.0 + exp(-(((-2.0 + 3.0 * coverage) + 1.0 * expertise_score)
                                                  + 1.0 * utility_score))), 9) AS semantic FROM feat"""),
        ("mm", """SELECT *, (score - min(score) OVER (PARTITION BY query_id))
                     / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id) + 1e-6)
                     AS lex_norm FROM sem"""),
        ("hy", f"SELECT *, round({alpha} * lex_norm + {1.0 - alpha} * semantic, 9) AS hybrid FROM mm"),
        ("ranked", """SELECT *, row_number() OVER (PARTITION BY query_id
                      ORDER BY hybrid DESC, lex_rank ASC, doc_id ASC) AS hybrid_rank FROM hy"""),
    ]


def search_ctes(alpha: float = 0.2, k_recall: int = 50) -> list[tuple[str, str]]:
    return bm25_ctes() + [cands_cte(k_recall)] + ranked_ctes(alpha)


def proxy_ctes(src: str = "ranked") -> list[tuple[str, str]]:
    return [
        ("thick", f"""SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY query_id) AS n_q FROM {src}) t
                      WHERE n_q >= 2"""),
        ("labelled", """SELECT *, CASE WHEN n_q > 10 THEN CAST(score >= max(CASE WHEN lex_rank = 10 THEN score END)
                             OVER (PARTITION BY query_id) AS INTEGER) ELSE 1 END AS rel FROM thick"""),
    ]


def per_query_ctes(src: str = "labelled") -> list[tuple[str, str]]:
    return [
        ("ideal", f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, lex_rank) AS ideal_rank
                     FROM {src}"""),
        ("pq0", """SELECT query_id, COUNT(*) AS n_hits, SUM(rel / log2(lex_rank + 1)) AS dl,
                          SUM(rel / log2(hybrid_rank + 1)) AS dh, SUM(rel / log2(ideal_rank + 1)) AS di,
                          MAX(rel) AS recall
                   FROM ideal GROUP BY query_id"""),
        ("pq", """SELECT query_id, n_hits,
                         round(CASE WHEN di > 0 THEN dl / di ELSE 0.0 END, 9) AS lexical_ndcg,
                         round(CASE WHEN di > 0 THEN dh / di ELSE 0.0 END, 9) AS hybrid_ndcg, recall
                  FROM pq0"""),
    ]


SUMMARY_SQL = """SELECT n_queries, round(l, 9) AS lexical_ndcg, round(h, 9) AS hybrid_ndcg,
       round((h - l) / (l + 1e-9) * 100.0, 6) AS lift_pct, round(r * 100.0, 9) AS recall_pct
FROM (SELECT COUNT(*) AS n_queries, AVG(lexical_ndcg) AS l, AVG(hybrid_ndcg) AS h, AVG(recall) AS r FROM pq) s"""
