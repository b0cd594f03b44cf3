"""Line dedup in rounds by length, pairs told apart where they meet, shuffle files that go with the write; retrieval by blocks in rounds."""

import os
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from relevo.llm import line_dedup
from relevo.operators import features as N
from relevo.operators import lexical as L
from relevo.session import write_shared


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))


def test_rounds_by_length_find_what_one_round_finds(spark, monkeypatch):
    rng, rows = random.Random(70), []
    for k in range(100):
        line = _words(rng, rng.choice((5, 12, 22, 23, 24, 25, 26, 40, 80, 300)))
        x = list(line)
        for i in range(len(x) // 24):  # near copies, longer by up to all edits allowed: many beyond the end of a round
            at = (i + 1) * len(x) // (len(x) // 24 + 1)
            x[at] += "#" if rng.random() < 0.8 else ""
        rows += [(2 * k, line), (2 * k + 1, "".join(x) + "\n" + line)]
    rows += [(1000 + k, "one length only " + _words(rng, 60)[:200]) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(line_dedup.rounds(docs)) == 1
    found = lambda: sorted(map(tuple, line_dedup.duplicate_lines(docs).select("doc_id", "n_lines", "removed", "n_near").collect()))
    want = found()
    for name, value in (("ROUND_KEYS", 800), ("ROUNDS", 12), ("BUCKET_KEYS", 200)):
        monkeypatch.setattr(line_dedup, name, value)
    several = line_dedup.rounds(docs)
    assert len({r[1] for r in several}) > 3 and any(r[4] > 1 for r in several)  # ranges of lengths, and one in shares
    assert several[0][1] == 24 and several[-1][2] is None and any(r[1] == line_dedup.LONG_LINE for r in several)
    assert found() == want and sum(r[3] for r in want) > 60


def test_lines_that_share_a_phrase_by_chance_are_no_rows(monkeypatch):
    rng = random.Random(71)
    phrase = "the same words in the same place of every line here"
    lines = [_words(rng, 20)[:100] + phrase + _words(rng, 40)[:150] for _ in range(60)]
    near = lines[0][:180] + "#" + lines[0][181:]
    sent = pa.Table.from_batches(list(line_dedup._send(0)([pa.record_batch({"text": ["\n".join([*lines, near])]})])))
    for run in (512, 8):  # each pair by itself, and groups of the lines of a key
        monkeypatch.setattr(line_dedup, "RUN", run)
        found = line_dedup._meet(sent).to_pylist()
        assert [(r["a"], r["b"], r["many"]) for r in found] == [(*sorted((line_dedup.line_id(lines[0]), line_dedup.line_id(near))), False)]


def test_sketches_of_lines_beyond_a_block_are_whole(monkeypatch):
    rng = random.Random(72)
    lines = [_words(rng, n) for n in (3, 100, 30, 400, 2)]
    whole = line_dedup._sketches(lines)
    monkeypatch.setattr(line_dedup, "BLOCK", 200)
    assert (line_dedup._sketches(lines) == whole).all() and (whole.sum(axis=1)[:1] == len(lines[0])).all()


def test_what_a_write_has_shuffled_goes_with_its_end(spark):
    dirs = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs())
    files = lambda: {f for d in dirs for _, _, some in os.walk(str(d)) for f in some if f.startswith("shuffle_")}
    before = files()
    got = write_shared(spark.range(20000).groupBy((F.col("id") % 700).alias("k")).count(), "cleanup")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and got.count() == 700
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_pairs_verified_at_once_are_those_verified_one_by_one():
    rng, lines = random.Random(73), []
    for n in (24, 47, 60, 150, 400, 767):
        base = "".join(rng.choice("abcñ日 ") for _ in range(n))
        for edits in range(0, 2 * (n // 24) + 3, 1 + n // 100):
            x = list(base)
            for at in rng.sample(range(n), edits):
                x[at] = rng.choice(["", "#", x[at] + "#"])
            lines.append("".join(x)[:767])
    n = np.array([len(x) for x in lines])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(lines)), np.arange(len(lines))))
    got = line_dedup.near_pairs(line_dedup._padded(lines), n, a, b)
    want = [line_dedup.near(lines[i], lines[j], int(min(n[i], n[j])) // 24) for i, j in zip(a, b)]
    assert got.tolist() == want and len(lines) + 20 < sum(want) < len(want) / 2


def test_later_blocks_return_no_document_below_the_best_so_far(spark, monkeypatch):
    rng = random.Random(74)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(40))) for i in range(3000)], "id long, body string")
    asked = spark.createDataFrame([(q, f"w{t}", 1) for q in range(12) for t in rng.sample(range(40), 4)], "query_id long, term string, qtf long")
    index = L.build_index(docs, "id", "body", vocabulary=asked)
    want = sorted(map(tuple, L.retrieve(L.bm25(asked, index), 5).select("query_id", "doc_id", "score", "matched", "n_query_terms").collect()))
    rows, cut = [], L.retrieve

    def counted(scored, k=50):
        rows.append(scored.count())
        return cut(scored, k)

    for name, value in (("PRUNE_FROM", 0), ("BLOCK_POSTINGS", 500), ("retrieve", counted)):
        monkeypatch.setattr(L, name, value)
    got = L.search(asked, index, 5).select("query_id", "doc_id", "score", "matched", "n_query_terms")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 60
    blocks, first = -(-index.postings.count() // 500), spark.sparkContext.defaultParallelism
    assert blocks > 4 * first and len(rows) >= 3
    assert max(rows) <= first * 60 and rows[-1] < 60 * 5  # k a query and block would be 60 for each of the last round's


def test_tokens_of_other_terms_are_not_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, None), (3, "gamma")], "id long, body string")
    asked = spark.createDataFrame([(1, "beta"), (2, "beta"), (2, None), (2, "none")], "query_id long, term string")
    written, keep = {}, L.write_shared
    monkeypatch.setattr(L, "write_shared", lambda df, name: keep(written.setdefault(name, df), name))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for terms, join in ((L.SENT_TERMS, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(L, "SENT_TERMS", terms)
            written.clear()
            index = L.build_index(docs, "id", "body", vocabulary=asked)
            assert [tuple(r) for r in index.postings.collect()] == [(1, 3, "beta", 2)] and index.stats.first()["n_docs"] == 2
            assert join in written["postings"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_missing_texts_are_dropped_before_a_join(spark):
    left = spark.createDataFrame([(1, "a", 0.5), (2, None, 0.5), (3, "c", None), (4, "d", float("nan"))], "id long, body string, x double")
    df = left.join(spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, None)], "id long, label int"), "id", "left")
    for cols in (("body", "label"), ("body", "x"), ("label",)):
        assert sorted(r["id"] for r in N.drop_incomplete(df, cols).collect()) == sorted(r["id"] for r in df.na.drop(subset=list(cols)).collect())
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = N.drop_incomplete(df).select("x")._jdf.queryExecution().optimizedPlan().toString()
        above = plan[:plan.index("Join")]
        assert "body" not in above and "Filter" not in above
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
