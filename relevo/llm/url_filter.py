"""URL filters (operator 6): rule lookup by host-suffix and path-prefix expressions.

A rule is a host and a path prefix with a verdict. It fits a URL when the
URL's host is the rule's or a subdomain of it and the URL's path starts with
the rule's. Each URL is expanded into the expressions (host suffix + path
prefix) that some rule could have: suffixes of the label counts and prefixes
of the lengths that occur among the rules. Expressions meet rules in an
equi-join on the first 32 bits of their SHA-256; the full digest is then
compared, and the longest fitting rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.llm.common import LOWER, UPPER, ascii_lower, read

#: The contract's rules: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """The rules as a table of literals ``(host, path, verdict)``."""
    if not rules:
        return spark.createDataFrame([], "host string, path string, verdict string")
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({q(h)}, {q(p)}, {q(v)})" for v, h, p in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(host, path, verdict)")


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``(<id_col>, host, path, rule, verdict)``, one row per input row.

    Null URLs and URLs without ``://`` have an empty host and path and get the
    default verdict; an empty path fits no rule whose path starts with ``/``.
    Repeated rows stay repeated. Of equally long fitting rules the one with
    the longer path wins, then a block. An empty rule table gives defaults.
    """
    # what the rules can look like: two short lists of integers (labels in a host, characters in a path)
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\.", -1))).alias("labels"),
                      F.collect_set(F.length("path")).alias("lengths")).first()
    parsed = urls.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col),
        F.coalesce(ascii_lower(F.regexp_extract(url_col, URL, 1)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(url_col, URL, 2), F.lit("")).alias("path"))
    n_labels = F.size(F.split("host", r"\.", -1))
    suffixes = [F.when(n_labels >= k, F.substring_index("host", ".", -k)) for k in sorted(shape["labels"])]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])]
    expressions = F.array_compact(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes])
                                  if suffixes and prefixes else F.array().cast("array<string>"))
    digest = F.sha2("expression", 256)
    probes = (parsed.withColumn("expression", F.explode_outer(F.array_distinct(expressions)))
              .withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 8)))
    known = (rules.select(F.concat("host", "path").alias("rule"), F.length("path").alias("rule_path"), "verdict")
             .withColumn("rule_digest", F.sha2("rule", 256)).withColumn("short", F.substring("rule_digest", 1, 8)))
    fits = F.col("digest") == F.col("rule_digest")
    found = probes.join(known, "short", "left").select(
        "rid", id_col, "host", "path",
        F.when(fits, F.struct(F.length("rule").alias("n"), "rule_path", (F.col("verdict") == "block").alias("block"),
                              "rule")).alias("fit"))
    best = found.groupBy("rid", id_col, "host", "path").agg(F.max("fit").alias("fit"))
    return best.select(
        id_col, "host", "path", F.col("fit.rule").alias("rule"),
        F.when(F.col("fit").isNull(), F.lit(default)).when(F.col("fit.block"), "block").otherwise("allow")
        .alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` against the contract's rules."""
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules_table(spark))


_SQL = f"""
WITH r(verdict, host, path) AS (VALUES {', '.join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
u AS (SELECT row_number() OVER () AS rid, page_id,
             translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
             coalesce(regexp_extract(url, '{URL}', 2), '') AS path
      FROM pages),
f AS (SELECT u.rid, r.verdict, r.host || r.path AS rule,
             row_number() OVER (PARTITION BY u.rid ORDER BY length(r.host || r.path) DESC, length(r.path) DESC,
                                r.verdict DESC) AS k
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN f ON u.rid = f.rid AND f.k = 1
"""

QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {"op6_url_filter": _SQL}
