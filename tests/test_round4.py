"""Bounded batches and tasks, links of long lines."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from relevo.llm import line_dedup
from relevo.operators import analysis as A
from relevo.operators import lexical as L


def test_phrases_come_in_bounded_batches(spark, monkeypatch):
    texts = ["a b c " * 500] * 30 + [None, "", "a b", "a b c " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string").coalesce(1)
    taken = {}
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: taken.update(run=run) or real(self, run, schema))
    monkeypatch.setattr(A, "PHRASE_ROWS", 1000)
    monkeypatch.setattr(A, "PHRASE_TOKENS", 700)
    rows = A.expand_phrases(df, ["a b => x, y z"]).collect()
    tokens = [t and t.split() or [] for t in texts]
    made = list(taken["run"]([pa.RecordBatch.from_pydict({"query_id": list(range(len(texts))), "tokens": tokens})]))
    assert max(b.num_rows for b in made) <= 1000
    got = [tuple(r.values()) for b in made for r in b.to_pylist()]
    assert sorted(got) == sorted(tuple(r) for r in rows)
    pair = [(0, 2, 0, 0, "x"), (0, 2, 1, 0, "y"), (0, 2, 1, 1, "z")]
    want = [(k, 3 * i + at, *rest) for k, t in enumerate(texts) for i in range((t or "").count("a b"))
            for at, *rest in pair + [(2, 1, 0, 0, "c")] * ("c" in t)]
    assert sorted(got) == sorted(want)


def _words(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 6))) for i in range(400)], "id long, body string")
    asked = spark.createDataFrame([(k, f"w{k % 7} w{(k + 1) % 7} w0") for k in range(30)], "query_id long, query_text string")
    return docs, L.query_terms(asked)


def _largest_task(scored):
    """Rows of the result that the task with most of them has."""
    return scored.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_that_sum_scores_are_bounded_by_their_matching_rows(spark, monkeypatch):
    docs, asked = _words(spark)
    index = L.build_index(docs, "id", "body", vocabulary=asked)
    want = sorted(L.bm25(asked, index).collect())
    monkeypatch.setattr(L, "TASK_ROWS", 200)
    got = L.bm25(asked, index)
    assert sorted(got.collect()) == want and len(want) > 5000
    assert _largest_task(got) < 800


def test_tasks_that_sum_synonym_groups_are_bounded_too(spark, monkeypatch):
    docs, asked = _words(spark)
    rules = spark.createDataFrame([("w0", "w3"), ("w0", "w0"), ("w1", "zz"), ("w2", "w5")], "lhs string, rhs string")
    want = sorted(L.bm25_synonyms(asked, rules, docs).collect())
    monkeypatch.setattr(L, "TASK_ROWS", 200)
    got = L.bm25_synonyms(asked, rules, docs)
    assert sorted(got.collect()) == want and len(want) > 5000
    assert _largest_task(got) < 800


def test_all_lines_within_the_edits_allowed_are_linked():
    rng = random.Random(3)
    for n in (149, 150, 167, 168, 191, 215, 500, 1500):
        for _ in range(40):
            a = "".join(rng.choice("abcdefghijk lmnop") for _ in range(n))
            b, t = list(a), n // 24
            for k in range(t):  # evenly spread, so that no long part is left unedited
                b[(k + 1) * n // (t + 1)] = "#"
            links = line_dedup.linked_lines({1: a, 2: "".join(b)})
            assert len(links) == 1, n


def test_blocks_of_documents_give_the_full_sums_best(spark, monkeypatch):
    docs, asked = _words(spark)
    docs = docs.union(spark.createDataFrame([(None, "w1 w2 w2"), (7, "w0 w5"), (900, ""), (901, None)], docs.schema))
    asked = asked.union(spark.createDataFrame([(None, "w2", 2), (77, "nowhere", 1)], asked.schema))
    index = L.build_index(docs, "id", "body", vocabulary=asked)
    key = lambda r: (str(r["query_id"]), r["lex_rank"])
    for k in (3, 1000):
        want = sorted(L.retrieve(L.bm25(asked, index), k).collect(), key=key)
        for size in (L.BLOCK_POSTINGS, 300):
            with monkeypatch.context() as m:
                m.setattr(L, "BLOCK_POSTINGS", size)
                m.setattr(L, "PRUNE_FROM", 0)
                m.setattr(L, "top_documents", None)  # which makes a row of every pair that its seeds reach
                found = L.search(asked, index, k)
                assert sorted(found.collect(), key=key) == want and sorted(found.columns) == sorted(L.retrieve(L.bm25(asked, index), k).columns)
