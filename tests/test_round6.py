"""Line dedup: what is sent, and blocks of pairs that can be near. Upsert: rows of keys that do not repeat stay where they are."""

import random

import numpy as np
import pyarrow as pa

from relevo.llm import line_dedup
from relevo.sources import sinks as K


def _text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_keys_take_few_bytes_and_their_pairs_hold_all_near_lines():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    lines = [_text(rng, words, rng.choice((5, 12, 40, 80, 400))) for _ in range(400)]
    near = set()
    for k in range(0, 400, 4):
        x, t = list(lines[k]), len(lines[k]) // 24
        for i in range(t):  # evenly spread, so that no long part is left unedited
            x[(i + 1) * len(x) // (t + 1)] = "#"
        if t:
            near.add(tuple(sorted(line_dedup.line_id(y) for y in (lines[k], "".join(x)))))
        lines.append("".join(x))
    texts = pa.record_batch({"text": pa.array(["\n".join(lines[k::50]) for k in range(50)])})
    for bits in (0, 3):
        sent = pa.Table.from_batches(list(line_dedup._send(bits)([texts])))
        assert sent.nbytes < 3 * sum(map(len, lines))  # 12 bytes a key were more than five times the text
        sizes = [0] * (1 << bits)
        met = set()
        for bucket in sorted(set(sent["bucket"].to_pylist())):
            part = sent.filter(pa.compute.equal(sent["bucket"], bucket))
            sizes[bucket] = sum(len(x) for x in part["hash"].to_pylist())
            found = line_dedup._meet(part).to_pydict()
            met |= set(zip(found["a"], found["b"]))
            assert not any(found["many"])
        assert near <= met and max(sizes) < 1.3 * sum(sizes) / len(sizes)


def test_a_key_of_many_lines_pairs_each_with_the_first(monkeypatch):
    monkeypatch.setattr(line_dedup, "RUN", 4)
    keys, rows = np.array([7] * 6 + [9] * 3), np.array([5, 4, 3, 2, 1, 0, 3, 4, 5])
    a, b, many = line_dedup._pairs(keys, rows, np.array([True] * 6 + [True, False, False]), None, 6)
    assert set(zip(a.tolist(), b.tolist(), many.tolist())) == {(0, k, True) for k in range(1, 6)} | {(3, 4, False), (3, 5, False)}


def test_blocks_with_and_without_keys_have_the_same_links(monkeypatch):
    rng = random.Random(7)
    base = [_text(rng, ["alpha", "beta", "gamma", "delta", "eps"], 12) for _ in range(6)]
    lines = {k: rng.choice(base)[:50 + rng.randint(0, 2)] + rng.choice("xyz") for k in range(60)}
    few = line_dedup.linked_lines(lines)
    monkeypatch.setattr(line_dedup, "FEW", 0)
    groups = lambda links: len(lines) - len(links)  # noqa: E731  a link joins a line not reached before
    assert len(few) > 10 and groups(few) == groups(line_dedup.linked_lines(lines))


def test_upsert_shuffles_only_rows_of_repeated_keys(spark, monkeypatch):
    rows = [(f"k{i % 400}" if i % 50 else None, i // 400, "body " * 20) for i in range(410)]
    new = spark.createDataFrame(rows, "id string, ingest_seq int, body string")
    old = spark.createDataFrame([("k1", 9, "stored"), (None, -1, "stored"), ("only", 0, "stored")], new.schema)
    got = K.upsert_documents(old, new)
    from relevo.sources import sinks

    monkeypatch.setattr(sinks, "FEW_KEYS", -1)
    want = K.upsert_documents(old, new)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert got.columns == want.columns and got.count() == len({(r["id"],) for r in got.collect()})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
