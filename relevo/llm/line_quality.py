"""Quality rules (operator 2): per-text counts and cross-document line frequency.

A host's boilerplate is found by counting, for every normalised line, the
distinct documents of that host that hold it. Lines above the limits are
removed, and a document that loses too much of its text is rejected as
depleted. Exact copies of one document are one document to this count, so that
a copied document does not make its own lines boilerplate: copies are the
duplicate operators' work. Documents that differ anywhere are different ones,
however much boilerplate they share. DataFrame functions only.

Hot lines: each line is first reduced to one row per (host, line, document)
with map-side combining, so no key is gathered; the table of frequent lines
(at most one in ``min_docs`` lines) meets the lines salted by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.llm.common import LOWER, UPPER, WORD, ascii_lower, fresh, let, read, text_key
from relevo.session import write_shared

#: A line is boilerplate of a host when more documents of it hold the line than either limit.
MIN_DOCS, MAX_SHARE = 10, 0.02
#: A document is depleted when fewer of its words than this share are left.
MIN_LEFT = 0.5
MIN_WORDS, MAX_REPEAT = 50, 50
SALT = 16
SYMBOLS = "#*$%&|<>"


def _repeat_words(hashes: Column) -> Column:
    """Words in three-word windows found twice or more: neighbours in the
    sorted (hash, position) list are repeats; each repeated window adds the
    words that the next one does not cover."""
    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(
            F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        hits = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
                        | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return let(F.array_sort(F.transform(hits, lambda e: e["i"])), covered)

    # most short texts repeat no window: the cheap distinct count decides that
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
        let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated))


def _line(normal: Column) -> Column:
    return F.struct(F.md5(normal).alias("h"),
                    (F.length(normal) - F.length(F.translate(normal, " ", "")) + 1).alias("n"))


def profile(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: its number, key, base counts, content (the text's
    hash, the same for exact copies) and lines ``(h, n)`` (hash of the normalised
    line and the words in it; lines without a word are left out)."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counted(words: Column) -> Column:
        hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.slice(F.transform(
            h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), 1, F.greatest(F.size(h) - 2, F.lit(0))))
        return F.struct(F.size(words).cast("long").alias("n_words"), let(hashes, _repeat_words).alias("n_repeat_words"))

    def lined(lines: Column) -> Column:
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.transform(lines, lambda x: let(normal_line(x), _line)).alias("lines"))

    return docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.col(host_col).alias("host"),
        text_key(F.col(text_col)).alias("text_key"), F.md5(text).alias("content"),
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), counted).alias("w"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lined).alias("l"),
    ).select("rid", "doc_id", "host", "text_key", "content", "w.*", "word_chars", "n_symbols", "l.*")


def normal_line(line: Column) -> Column:
    """A line with A-Z lower-cased and every run of white space as one space, none at the ends."""
    return F.trim(ascii_lower(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def frequent_lines(profiles: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``(host, h, n_docs)`` of the lines above the limits; a null host is a host of its own."""
    seen = (profiles.select("host", "content", F.explode(F.array_distinct("lines.h")).alias("h"))
            .groupBy("host", "h", "content").agg(F.lit(1).alias("one"))
            .groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs))
    hosts = (profiles.groupBy("host", "content").agg(F.lit(1).alias("one"))
             .groupBy(F.col("host").alias("host_")).agg(F.count("*").alias("host_docs")))
    return (seen.join(hosts, F.col("host").eqNullSafe(F.col("host_")))
            .where(F.col("n_docs") > F.col("host_docs") * max_share).select("host", "h", "n_docs"))


def judge(profiles: DataFrame, frequent: DataFrame, min_left: float = MIN_LEFT) -> DataFrame:
    """Counts and verdict of every profiled row, with the hashes of its removed lines."""
    lines = (profiles.select("rid", "host", F.explode("lines").alias("l"))
             .select("rid", "host", F.col("l.h").alias("h"), F.col("l.n").alias("n"),
                     F.pmod("rid", F.lit(SALT)).alias("salt")))
    salted = frequent.select(F.col("host").alias("host_"), F.col("h").alias("h_"),
                             F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt_"))
    lost = (lines.join(salted, F.col("host").eqNullSafe(F.col("host_")) & (F.col("h") == F.col("h_"))
                       & (F.col("salt") == F.col("salt_")))
            .groupBy("rid").agg(F.sum("n").cast("long").alias("removed_words"), F.collect_set("h").alias("removed")))
    removed = F.coalesce("removed_words", F.lit(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return (profiles.drop("lines", "content").join(lost, "rid", "left")
            .withColumns({"removed_words": removed, "base_failed": failed})
            .withColumn("kept", ~F.col("base_failed")
                        & (F.col("n_words") - F.col("removed_words") >= F.col("n_words") * min_left)))


def line_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts and verdict of every document (``doc_id``, a text and a host column; others are ignored).

    A null text is empty and fails the base rules; null hosts are one host;
    repeated rows are judged each, and count as one document for the line
    frequencies. The profile (a row of counts and line hashes per document) is
    written to the shared folder once, and all passes read that.
    """
    profiles = write_shared(profile(docs, text_col, host_col), "line-profiles")
    return judge(profiles, frequent_lines(profiles))


def keep_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The kept documents with their boilerplate lines removed, all columns of ``docs``.

    ``n_chars``, where present, follows the new text. Verdicts meet the
    documents by id, host and text, so no column of ``docs`` can clash.
    """
    d, h, t, r = fresh(docs, "llm_doc", "llm_host", "llm_text", "llm_removed")
    verdicts = (line_quality(docs, text_col, host_col).where("kept")
                .select(F.col("doc_id").alias(d), F.col("host").alias(h), F.col("text_key").alias(t),
                        F.col("removed").alias(r)).dropDuplicates([d, h, t]))
    kept = docs.join(verdicts, F.col("doc_id").eqNullSafe(F.col(d)) & F.col(host_col).eqNullSafe(F.col(h))
                     & (text_key(F.col(text_col)) == F.col(t)))
    text = F.when(F.col(r).isNull(), F.col(text_col)).otherwise(F.concat_ws("\n", F.filter(
        F.split(text_col, "\n", -1),
        lambda x: ~x.rlike(WORD) | ~F.array_contains(F.col(r), F.md5(normal_line(x))))))
    kept = kept.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base verdict and line-frequency verdict of every document."""
    return line_quality(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_words")


_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, i, ws[i] AS w, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g, i <= len(ws) - 2 AS whole
      FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i
            FROM (SELECT rid, regexp_extract_all(text, '{WORD}') AS ws FROM d))),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM w WHERE whole) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
wc AS (SELECT rid, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY rid),
l AS (SELECT rid, x, trim(translate(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), '{UPPER}', '{LOWER}')) AS h
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{WORD}')),
lc AS (SELECT rid, count(*) - count(DISTINCT x) AS dup FROM l GROUP BY rid),
c AS (SELECT rid, host, md5(text) AS content FROM d),
hosts AS (SELECT host, count(DISTINCT content) AS docs FROM c GROUP BY host),
freq AS (SELECT c.host, h FROM l JOIN c USING (rid) JOIN hosts ON hosts.host IS NOT DISTINCT FROM c.host
         GROUP BY c.host, h, hosts.docs
         HAVING count(DISTINCT content) > {MIN_DOCS} AND count(DISTINCT content) > hosts.docs * {MAX_SHARE}),
lost AS (SELECT l.rid, sum(length(l.h) - length(replace(l.h, ' ', '')) + 1) AS n
         FROM l JOIN d USING (rid) JOIN freq ON freq.host IS NOT DISTINCT FROM d.host AND freq.h = l.h GROUP BY l.rid),
a AS (SELECT d.doc_id, coalesce(wc.n, 0)::BIGINT AS n_words, coalesce(wc.chars, 0)::BIGINT AS word_chars,
             (length(d.text) - length(regexp_replace(d.text, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(lc.dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             coalesce(lost.n, 0)::BIGINT AS removed_words
      FROM d LEFT JOIN wc USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN lc USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words)
           AND n_words - removed_words >= n_words * {MIN_LEFT} AS kept,
       removed_words
FROM a
"""

QUERIES = {"op2_line_frequency": op2_line_frequency}
ORACLES = {"op2_line_frequency": _SQL}
