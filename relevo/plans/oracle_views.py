"""DuckDB SQL for the derived views of ``relevo.sources.tables``.

The oracle SQL of every registered query starts with the views it needs;
``with_views`` assembles the WITH clause (dependencies first).
"""

from __future__ import annotations

FIRST8 = ("array_to_string(list_slice(list_filter(regexp_split_to_array({x}, '\\s+'), "
          "lambda w: w <> ''), 1, 8), ' ')")
WORDS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "activity": ((), """
        SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS author,
               event_type AS subreddit, CAST(value AS DECIMAL(18,2)) AS score, ts AS created_utc
        FROM events"""),
    "corpus": ((), f"""
        SELECT doc_id AS id, 'u' || CAST(doc_id % 7 AS VARCHAR) AS author, source AS subreddit,
               {FIRST8.format(x='text')} AS title, text AS body, lang
        FROM documents"""),
    "posts": ((), f"""
        SELECT d.doc_id AS id, 'u' || CAST(d.doc_id % 7 AS VARCHAR) AS author, d.source AS subreddit,
               {FIRST8.format(x='d.text')} AS title, d.text AS body, l.quality AS label, d.lang AS lang
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "posts_activity": ((), """
        SELECT CAST(doc_id AS VARCHAR) AS id, 'u' || CAST(doc_id % 7 AS VARCHAR) AS author,
               source AS subreddit, CAST(n_chars % 100 AS DECIMAL(18,2)) AS score,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_utc
        FROM documents"""),
    "post_scores": (("posts",), """
        SELECT *,
          CASE WHEN id % 11 = 0 THEN NULL
               ELSE CAST(((id % 2147483648) * 1103515245 + 12345) % 2147483648 AS DOUBLE) / 2147483648.0
          END AS expertise_score,
          CASE WHEN id % 11 = 5 THEN NULL
               ELSE CAST(((id % 2147483648) * 22695477 + 1) % 2147483648 AS DOUBLE) / 2147483648.0
          END AS utility_score
        FROM posts"""),
    "queries": ((), f"""
        SELECT item_id AS query_id, {FIRST8.format(x='text')} AS query_text FROM benchmark"""),
    "qrels": ((), """
        SELECT b.item_id AS query_id, d.doc_id AS doc_id, 1 AS rel
        FROM benchmark b JOIN documents d ON contains(d.text, b.text)"""),
    "vectors": ((), "SELECT vec_id, embedding, label FROM embeddings"),
    "latency": ((), "SELECT event_id, value AS latency_ms FROM events"),
    "paths": ((), """
        SELECT page_id,
               regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '[?#].*$', '') AS path
        FROM pages"""),
}


def words(x: str) -> str:
    """SQL for the lower-cased word tokens of expression ``x``."""
    return WORDS.format(x=x)


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <views + extra CTEs> <body>``; view dependencies are added first."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            add(d)
        order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n][1]}\n)" for n in order] + [f"{n} AS ({s}\n)" for n, s in (extra or [])]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
