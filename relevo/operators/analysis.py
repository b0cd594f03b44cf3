"""Text analysis over whole corpora (A1-A10).

All analysis is expressed with built-in array/regex functions so it runs
inside whole-stage code generation; tokens are produced per row and only
exploded when a relational step (join, aggregate) needs them.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.functions.fixed import STOPWORDS_EN, SYNONYM_RULES
from relevo.functions.text import keyword_token, whitespace_tokens, word_tokens

MODES = ("word", "whitespace", "keyword")


def token_array(text, mode: str = "word"):
    """Tokens of ``text`` as an array column for the given analysis mode."""
    if mode == "word":
        return word_tokens(text)
    if mode == "whitespace":
        return whitespace_tokens(text)
    if mode == "keyword":
        return F.array(keyword_token(text))
    raise ValueError(f"unknown mode {mode!r}; expected one of {MODES}")


def token_count(text, mode: str = "word"):
    """Number of tokens, counted without materialising the token array."""
    if mode == "word":
        return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}]+"))
    if mode == "whitespace":
        return F.regexp_count(text, F.lit(r"\S+"))
    return F.size(token_array(text, mode))


def analyze(df: DataFrame, id_col: str, text_col: str, mode: str = "word",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per token: ``(id, pos, term)`` with 0-based positions."""
    x = df.select(id_col, *keep, F.posexplode(token_array(F.col(text_col), mode)).alias("pos", "term"))
    return x.withColumn("pos", F.col("pos").cast("long"))


#: Language codes and the names of the lists that come with Spark ML.
STOP_LISTS = {"fr": "french", "de": "german", "es": "spanish"}


@lru_cache(maxsize=1)
def stop_lists() -> tuple[tuple[str, str], ...]:
    """``(lang, term)`` of all languages: the fixed English list, and Spark ML's default lists of the others
    (read from its jar, so no session is needed)."""
    jar = glob.glob(os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))[0]
    out = [("en", w) for w in STOPWORDS_EN]
    with zipfile.ZipFile(jar) as z:
        for lang, name in STOP_LISTS.items():
            text = z.read(f"org/apache/spark/ml/feature/stopwords/{name}.txt").decode()
            out += [(lang, w) for w in sorted({x.strip().lower() for x in text.splitlines() if x.strip()})]
    return tuple(out)


def stopword_table(spark: SparkSession, words=None, lang: str = "en") -> DataFrame:
    """A ``(lang, term)`` stop table; default are the lists of all languages, else ``words`` of ``lang`` (A2)."""
    rows = list(stop_lists()) if words is None else [(lang, w.lower()) for w in words]
    return spark.createDataFrame(rows, "lang string, term string")


def remove_stopwords(tokens: DataFrame, stops: DataFrame, lang_col: str | None = None) -> DataFrame:
    """Drop tokens found in the stop table, ignoring case (A2); with ``lang_col``, in the list of their language.

    Whether the stop table is broadcast is Spark's choice by its size.
    """
    s = stops.select(F.lower("term").alias("_stop"), F.col("lang").alias("_slang")).distinct()
    cond = F.col("term") == F.col("_stop")
    if lang_col:
        cond = cond & (F.col(lang_col) == F.col("_slang"))
    return tokens.join(s, cond, "left_anti")


def parse_synonyms(rules=None) -> list[tuple[str, str]]:
    """Synonym rules to ``(lhs, rhs)`` term pairs, lower-cased (ignoreCase).

    ``a, b, c`` is an equivalence group: each member expands to every member.
    ``a => b c`` replaces ``a`` by the terms on the right (multi-word right
    sides become a bag of terms).
    """
    pairs: list[tuple[str, str]] = []
    for rule in SYNONYM_RULES if rules is None else rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        if "=>" in rule:
            lhs, rhs = rule.split("=>", 1)
            rights = [t for part in rhs.split(",") for t in re.split(r"\s+", part.strip().lower()) if t]
            for left in (x.strip().lower() for x in lhs.split(",")):
                for r in rights:
                    pairs.append((left, r))
        else:
            group = [x.strip().lower() for x in rule.split(",") if x.strip()]
            for left in group:
                for r in group:
                    pairs.append((left, r))
    return sorted(set(pairs))


def synonym_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(parse_synonyms(rules), "lhs string, rhs string")


def expand_synonyms(query_terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Replace each query term by its synonym expansion; unmatched terms stay (A3).

    ``query_terms`` has ``(query_id, term, ...)``; whether the synonym table is
    broadcast is Spark's choice by its size. Rules of several words:
    ``expand_phrases``.
    """
    syn = synonyms.select(F.col("lhs").alias("_lhs"), F.col("rhs").alias("_rhs"))
    joined = query_terms.join(syn, F.col("term") == F.col("_lhs"), "left")
    return (joined.withColumn("term", F.coalesce(F.col("_rhs"), F.col("term")))
            .drop("_lhs", "_rhs"))


def parse_phrases(rules=None) -> dict[tuple[str, ...], list[tuple[str, ...]]]:
    """Synonym rules with whole word sequences: left side -> its alternatives, in the order of the rules.

    ``a b, c`` is an equivalence group; ``a b => c d, e`` replaces the sequence
    ``a b`` by ``c d`` or ``e``. Rules with the same left side add up.
    """
    out: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for rule in SYNONYM_RULES if rules is None else rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        sides = [[tuple(part.lower().split()) for part in side.split(",") if part.strip()] for side in rule.split("=>", 1)]
        for left in sides[0]:
            known = out.setdefault(left, [])
            known += [right for right in sides[-1] if right not in known]
    return out


def _trie(rules: dict) -> dict:
    root: dict = {}
    for left, rights in rules.items():
        node = root
        for word in left:
            node = node.setdefault(word, {})
        node[None] = rights
    return root


#: Rows of one output batch of ``expand_phrases``, and tokens taken out of a batch together.
PHRASE_ROWS, PHRASE_TOKENS = 50_000, 50_000


def _token_slices(batch: pa.RecordBatch, most: int):
    """``(row, tokens)`` of a batch's lists; not more than ``most`` tokens of it, or those of one row, are Python objects at a time."""
    lists = batch["tokens"]
    ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).to_pylist()
    first, before = 0, 0
    for row, end in enumerate(ends):
        if row + 1 == len(ends) or ends[row + 1] - before > most:
            yield from enumerate(lists.slice(first, row + 1 - first).to_pylist(), first)
            first, before = row + 1, end


def expand_phrases(df: DataFrame, rules=None, id_col: str = "query_id", text_col: str = "query_text", mode: str = "word") -> DataFrame:
    """Synonym rules of several words, positions kept (A3): ``(id, pos, span, alt, part, term)``.

    Texts are read from the left; at each token the longest left side that
    matches is taken (a trie over the words of all rules) and the reading goes on after it. A
    match of ``span`` tokens at ``pos`` gives the ``part``-th word of its ``alt``-th
    alternative a row each; another token is its own. Null and empty texts give no row.
    """
    root = _trie(parse_phrases(rules))

    def expand(tokens: list[str]):
        at = 0
        while at < len(tokens):
            node, span, rights, k = root, 1, [(tokens[at],)], at
            while k < len(tokens) and (node := node.get(tokens[k])) is not None:
                k += 1
                if None in node:
                    span, rights = k - at, node[None]
            for alt, right in enumerate(rights):
                for part, term in enumerate(right):
                    yield at, span, alt, part, term
            at += span

    def run(batches):
        names = [id_col, "pos", "span", "alt", "part", "term"]
        for b in batches:
            found = ((row, *x) for row, tokens in _token_slices(b, PHRASE_TOKENS) for x in expand(tokens or []))
            while rows := list(islice(found, PHRASE_ROWS)):
                row, pos, span, alt, part, term = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b[id_col].take(pa.array(row, type=pa.int64())), pa.array(pos, type=pa.int64()), pa.array(span, type=pa.int64()),
                     pa.array(alt, type=pa.int32()), pa.array(part, type=pa.int32()), pa.array(term, type=pa.string())], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, token_array(F.col(text_col), mode).alias("tokens")).mapInArrow(
        run, f"{id_col} {kind}, pos bigint, span bigint, alt int, part int, term string")


def distinct_terms(text, mode: str = "word"):
    """De-duplicated tokens of a text."""
    return F.array_distinct(token_array(text, mode))


def path_ancestors(path):
    """``a/b/c`` -> ``[a, a/b, a/b/c]`` (empty segments ignored)."""
    segs = F.filter(F.split(path, "/"), lambda s: s != F.lit(""))
    return F.transform(F.sequence(F.lit(1), F.size(segs)),
                       lambda i: F.array_join(F.slice(segs, F.lit(1), i), "/"))


def path_rollup(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Count of rows under every path ancestor: ``(ancestor, depth, n)``."""
    exploded = df.select(F.posexplode(path_ancestors(F.col(path_col))).alias("d", "ancestor"))
    return (exploded.groupBy("ancestor").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n"))
            .select("ancestor", (F.col("d").cast("long") + 1).alias("depth"), "n"))


def doc_lengths(docs: DataFrame, id_col: str, text_col: str, mode: str = "word") -> DataFrame:
    """``(doc_id, dl)``: number of tokens per document; computed per row, no shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), token_count(F.col(text_col), mode).alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row ``(n_docs, total_terms, avgdl)`` over documents with at least one token (A10)."""
    # conditional aggregation rather than a filter: a filter on the length
    # would be pushed into the scan and tokenise the text a second time
    return (lengths.agg(F.count_if(F.col("dl") > 0).alias("n_docs"), F.sum("dl").alias("total_terms"))
            .select("n_docs", "total_terms",
                    (F.col("total_terms").cast("double") / F.col("n_docs")).alias("avgdl")))


def term_document_frequency(postings: DataFrame) -> DataFrame:
    """``(term, df)``: number of documents containing each term (A10)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
