"""Operators that SQL cannot express, against plain Python over the smallest tables, and their odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from relevo.llm import alignment, ctw, line_dedup, packing, piece_codec, prefix_join, ranked_search, sketch, token_store
from relevo.llm.components import components
from relevo.llm.hashing import span_hashes
from relevo.llm.registry import QUERIES
from relevo.llm.tokens import BYTE_BPE
from tests.conftest import SF_SMALL
from tests.llm.helpers import ODD, Groups, documents, odd_docs, removed_lines, set_components, shingles


@pytest.fixture(scope="module")
def docs():
    return documents()


@pytest.fixture(scope="module")
def bpe():
    t = Tokenizer.from_file(BYTE_BPE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# op3

def pieces_by_library(pairs):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.PIECE_MODEL)
    out = []
    for i, t in pairs:
        ids = sp.encode(t or "")
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    return out


def test_piece_codec(spark, docs):
    got = QUERIES["op3_piece_codec"](spark, SF_SMALL)
    assert sorted(rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == pieces_by_library(docs)


def test_piece_codec_odd(spark):
    got = {}
    for r in piece_codec.encode_pieces(odd_docs(spark)).collect():
        got[r["doc_id"], tuple(r["ids"])] = r
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.PIECE_MODEL)
    assert set(got) == {(r[0], tuple(sp.encode(r[1] or ""))) for r in ODD}
    for r in ODD:
        spans = got[r[0], tuple(sp.encode(r[1] or ""))]
        if r[1]:
            assert spans["begins"][0] == 0 and spans["ends"][-1] == len(r[1].encode()) and spans["begins"][1:] == spans["ends"][:-1]
    assert piece_codec.encode_pieces(odd_docs(spark, [])).count() == 0


# op4

def check_packing(got, expected):
    """``got``: rows of pieces with places; ``expected``: Counter of (doc_id, piece, start, length, crc)."""
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 1024
    least = -(-sum(r["length"] for r in got) // 1024)
    assert len(bins) <= max(least + 2, least * 1.03)


def cut(pairs, bpe):
    out = Counter()
    for i, t in pairs:
        ids = bpe(t) + [2]
        first = (len(ids) - 1) % 1024 + 1
        for k, e in enumerate(range(first, len(ids) + 1, 1024)):
            s = max(0, e - 1024) if k else 0
            out[i, k, s, e - s, crc(ids[s:e])] += 1
    return out


def test_packing(spark, docs, bpe):
    check_packing(QUERIES["op4_best_fit_packing"](spark, SF_SMALL).collect(), cut(docs, bpe))


def test_packing_odd(spark, bpe):
    check_packing(packing.pack_documents(odd_docs(spark)).collect(), cut([r[:2] for r in ODD], bpe))
    assert packing.pack_documents(odd_docs(spark, [])).count() == 0
    same = odd_docs(spark, [(i, "same text", "en", "s", 9) for i in range(900)])
    check_packing(packing.pack_documents(same).collect(), cut([(i, "same text") for i in range(900)], bpe))


# op5

def stored(pairs, bpe):
    at, out = 0, []
    for i, t in pairs:
        ids = bpe(t) + [0]
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_token_store(spark, docs, bpe):
    got = QUERIES["op5_token_store"](spark, SF_SMALL)
    assert sorted(rows(got, "doc_id", "start", "n_tokens", "ids_crc32")) == stored(docs, bpe)


def test_token_store_odd(spark, bpe, tmp_path):
    path = str(tmp_path / "tokens")
    token_store.write_tokens(odd_docs(spark), path)
    files = spark.read.parquet(path)
    got = sorted(rows(token_store.read_digests(files), "start", "n_tokens", "doc_id"))
    assert [n for _, n, _ in got] and [s for s, _, _ in got] == [sum(n for _, n, _ in got[:i]) for i in range(len(got))]
    assert [d for _, _, d in got] == sorted((r[0] for r in ODD), key=lambda x: (x is not None, x or 0))
    assert Counter((d, n) for _, n, d in got) == Counter((r[0], len(bpe(r[1])) + 1) for r in ODD)
    one = files.where("doc_id = 5").first()
    assert one["tokens"] == bpe(ODD[5][1]) + [0]
    token_store.write_tokens(odd_docs(spark, []), path + "-empty")
    assert token_store.read_digests(spark.read.schema(files.schema).parquet(path + "-empty")).count() == 0


# op8

def edits(pairs):
    out = []
    for k, (i, t) in enumerate(pairs):
        n = len(t) // 4
        out.append((i, len(t), sha(t[:len(t) - n] + pairs[(k + 1) % len(pairs)][1][:n])))
    return out


def test_sketches(spark, docs):
    got = QUERIES["op8_scaled_sketch"](spark, SF_SMALL)
    assert sorted(rows(got, "doc_id", "n_chars", "edited_sha256")) == edits(docs)
    texts = dict(docs)
    for r in got.collect():
        s = sketch.sketch(texts[r["doc_id"]])
        assert r["fingerprint"] == sketch.fingerprint(s) and 0 <= r["near_edited"] <= 1
        assert r["near_edited"] == sketch.resemblance(s, sketch.parse(r["edited_fingerprint"]))


def test_sketches_over_many_shards(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sketch.compare_edits(frame, rows_per_shard=7)
    assert sorted(rows(got, "doc_id", "n_chars", "edited_sha256")) == edits(docs)


def test_sketches_estimate_the_jaccard_similarity_of_shingles(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op8_scaled_sketch"](spark, SF_SMALL).collect()}

    def shingles(t):
        ws = (t or "").encode().split()
        return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    def similar(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    wrong = 0
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        for have, other in ((got[i]["near_next"], after), (got[i]["near_edited"], edited)):
            n = max(1, len(shingles(t) | shingles(other)) / sketch.FRACTION)
            want = similar(t, other)
            wrong += abs(have - want) > 4 * math.sqrt(max(want * (1 - want), 0.02) / n) + 1 / n
        assert got[i]["near_next"] == (1.0 if t == after else got[i]["near_next"])
    assert wrong <= len(docs) // 50


@pytest.mark.parametrize("most", [sketch.MAX_SHARDS, 5])
def test_a_repeated_id_is_dealt_to_many_shards(spark, monkeypatch, most):
    monkeypatch.setattr(sketch, "MAX_SHARDS", most)
    pairs = [(i, f"first {i} of them") for i in range(40)] + [(50, f"copy {i} of an id " * (1 + i % 3)) for i in range(3000)]
    pairs += [(60 + i, f"last {i} of them") for i in range(500)]
    frame = spark.createDataFrame(pairs, "doc_id long, text string").coalesce(1)
    keyed = frame.select(F.col("doc_id").alias("key"), F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    sizes = [r["count"] for r in sketch._follow(keyed, 100).groupBy("shard").count().collect()]
    assert len(sizes) <= most and max(sizes) < 3 * len(pairs) / len(sizes)
    assert sorted(rows(sketch.compare_edits(frame, rows_per_shard=100), "doc_id", "n_chars", "edited_sha256")) == sorted(edits(pairs))


def test_sketches_odd(spark):
    frame = odd_docs(spark).repartition(1)
    got = rows(sketch.compare_edits(frame, rows_per_shard=3), "doc_id", "n_chars")
    assert Counter(got) == Counter((r[0], len(r[1] or "")) for r in ODD)
    assert sketch.compare_edits(odd_docs(spark, [])).count() == 0
    one = sketch.compare_edits(odd_docs(spark, ODD[3:4])).first()
    assert one["near_next"] == 1.0 and one["near_edited"] == 0.0 and one["edited_sha256"] == sha("WorW")


# op9

def test_set_join(spark, docs):
    got = QUERIES["op9_prefix_tree_join"](spark, SF_SMALL)
    root = set_components(docs)
    assert sorted(rows(got, "doc_id", "n_shingles", "component_id")) == [(i, len(shingles(t)), root[i]) for i, t in docs]


def near_texts(n=90):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            words[at] = f"e{rng.integers(0, 1000)}"
        out.append((i, " ".join(words) if i % 3 else " ".join(words).upper()))
    return out + [(n + i, " ".join(f"own{i}x{j}" for j in range(80))) for i in range(40)]


def test_set_join_in_parts(spark, monkeypatch):
    pairs = near_texts()
    frame = spark.createDataFrame(pairs, "doc_id long, text string")
    root = set_components(pairs)
    assert len(set(root.values())) < 100
    for most, chunk in ((10**6, 10**6), (1500, 20)):
        monkeypatch.setattr(prefix_join, "PART_ELEMENTS", most)
        monkeypatch.setattr(prefix_join, "CHUNK_DOCS", chunk)
        got = rows(prefix_join.near_duplicates(frame), "doc_id", "component_id")
        assert sorted(got) == sorted(root.items())


def test_set_join_odd(spark):
    frame = odd_docs(spark)
    got = Counter(rows(prefix_join.near_duplicates(frame), "doc_id", "n_shingles", "component_id"))
    n = {k: len(shingles(t)) for k, t, *_ in ODD}
    assert got[4, 1, 4] == 2 and got[5, n[5], 5] == 1 and got[6, n[6], 5] == 1 and got[10, n[10], 5] == 1
    assert got[1, 0, 1] == got[2, 0, 2] == got[3, 0, 3] == 1 and got[None, 0, None] == 1 and got[7, n[7], 7] == 1
    kept = prefix_join.keep_one(frame)
    assert kept.columns == frame.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter([1, 2, 3, 4, 4, 5, 7, 8, None, None, -9])
    assert prefix_join.near_duplicates(odd_docs(spark, [])).count() == 0


def test_stage_joins_five_word_sets_from_four_fifths(spark):
    words = [f"w{i}" for i in range(200)]
    edited = lambda at: " ".join("new" + w if i in at else w for i, w in enumerate(words))
    block = lambda name, n: " ".join(words[:100] + [f"{name}{i}" for i in range(n)] + words[100:])
    alone = " ".join(f"alone{i}" for i in range(200))
    pairs = [(1, " ".join(words)), (2, edited({40, 80, 120, 160})), (3, block("in", 40)), (4, block("more", 52)), (5, alone)]
    similar = lambda a, b, size: len(shingles(a, size) & shingles(b, size)) / len(shingles(a, size) | shingles(b, size))
    for _, t in pairs[1:3]:
        assert similar(pairs[0][1], t, 5) >= 0.8 and similar(pairs[0][1], t, 4) < 0.85
    assert 0.75 < similar(pairs[0][1], pairs[3][1], 5) < 0.8
    frame = odd_docs(spark, [(*p, "en", "s", 1) for p in pairs])
    stage = dict(corpus_pipeline.STAGES)["ngram_join"]
    assert sorted(r["doc_id"] for r in stage(spark, frame, SF_SMALL).collect()) == [1, 4, 5]
    root = set_components(pairs)
    assert sorted(rows(prefix_join.near_duplicates(frame), "doc_id", "component_id")) == sorted(root.items())


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    whole = Groups({x for e in links for x in e})
    for a, b in links:
        whole.join(a, b)
    frame = spark.createDataFrame(links + [(None, 5), (7, 7)], "a long, b long")
    got = dict(rows(components(frame), "node", "root"))
    assert got == {x: whole.find(x) for x in whole.up if whole.find(x) != x}
    assert components(frame.limit(0)).count() == 0


# op1

def allowed(n):
    return int(line_dedup.edits_allowed(n))


@lru_cache(maxsize=None)
def selected(line):
    """Places of each selected substring: the least by its hash of every ``WINDOW`` in a row."""
    grams = [line[k:k + line_dedup.GRAM] for k in range(len(line) - line_dedup.GRAM + 1)]
    value = {g: int(span_hashes(np.frombuffer(g.encode("utf-32-le"), "<u4"), np.array([0]), np.array([len(g)]))[0]) for g in grams}
    out = defaultdict(set)
    for k in range(len(grams) - line_dedup.WINDOW + 1):
        window = grams[k:k + line_dedup.WINDOW]
        least = min(value[g] >> 32 for g in window)
        for at, g in enumerate(window, k):
            if value[g] >> 32 == least:
                out[g].add(at)
    return out


def bands(line, at, n, t):
    """Bands of length and place that ``t`` edits can reach from the place ``at`` of a line of ``n`` characters."""
    return {(b, cell) for m in range(max(line_dedup.LONG_LINE, n - t), n + 1)
            for b in [int(np.searchsorted(line_dedup.BANDS, m, side="right")) - 1]
            for cell in {max(0, at + d) // int(line_dedup.PLACES[b]) for d in range(-t, t + 1)}}


def meet(a, b):
    """Whether lines of which ``a`` is no longer than ``b`` share a key: below ``LONG_LINE`` all near copies do."""
    if len(a) < line_dedup.LONG_LINE:
        return True
    x, y = selected(a), selected(b)

    def probes(one, other, p, q):
        return any(bands(one, at, len(one), 0) & bands(other, k, len(other), allowed(len(other)))
                   for g in p.keys() & q.keys() for at in p[g] for k in q[g])
    return probes(a, b, x, y) or probes(b, a, y, x)


def test_line_dedup(spark, docs):
    got = QUERIES["op1_segment_edit_join"](spark, SF_SMALL)
    want = removed_lines(docs, allowed, meet)
    assert sorted(rows(got, "doc_id", "n_lines", "removed")) == [
        (i, len([x for x in t.split("\n") if x.split()]), ",".join(map(str, want[i]))) for i, t in docs]


def near_lines():
    rng = np.random.default_rng(9)
    base = ["".join(rng.choice(list("abc dñ"), n)) for n in (30, 47, 48, 60, 90, 149, 151, 240, 400)]
    out = []
    for i in range(60):
        lines = []
        for _ in range(4):
            x = list(base[rng.integers(len(base))])
            for at in rng.integers(0, len(x), rng.integers(0, max(4, len(x) // 16))):
                x[at] = ["", "z", "ñ"][rng.integers(3)]
            lines.append("".join(x))
        out.append((i, "\n".join(lines)))
    return out


def test_line_dedup_in_parts(spark, monkeypatch):
    pairs = near_lines()
    frame = spark.createDataFrame(pairs, "doc_id long, text string")
    want = {i: v for i, v in removed_lines(pairs, allowed, meet).items()}
    for most, chunk in ((10**6, 10**6), (2000, 10)):
        monkeypatch.setattr(line_dedup, "PART_CHARS", most)
        monkeypatch.setattr(line_dedup, "CHUNK_DOCS", chunk)
        got = line_dedup.duplicate_lines(frame)
        assert {r["doc_id"]: r["removed"] for r in got.collect()} == want
        assert got.agg({"n_near": "sum"}).first()[0] > 20


def test_line_dedup_odd(spark):
    frame = odd_docs(spark)
    left = line_dedup.dedup_lines(frame)
    assert left.columns == frame.columns
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    keep = [r for r in ODD if r[0] not in (6, 10)]  # 6 repeats 5; 10 is five edits from it
    want = Counter((r[0], r[1]) for r in keep)
    del want[7, ODD[7][1]], want[8, ODD[8][1]]
    want[7, "wOrd\nsame line of text that is long enough here\n"] = 1
    want[8, "ñandú €uro 日本語 😀 x\x00y"] = 1
    assert got == want
    assert line_dedup.dedup_lines(odd_docs(spark, [])).count() == 0


# op7

def plain_tree(texts, depth=ctw.DEPTH):
    """log10 probability of a text under context-tree weighting, by recursion over contexts."""
    nodes, below = defaultdict(lambda: [0, 0]), defaultdict(set)

    def bits(t):
        seq = b"\0" * depth + b" ".join((t or "").encode().lower().split()) + b"\0"
        for k in range(depth, len(seq)):
            node = 1
            for j in range(7, -1, -1):
                bit = seq[k] >> j & 1
                yield seq[k - depth:k], node, bit
                node = node * 2 + bit

    for t in texts:
        for context, node, bit in bits(t):
            for d in range(depth + 1):
                nodes[context[depth - d:], node][bit] += 1
                if d:
                    below[context[depth - d + 1:], node].add(context[depth - d:])
    memo = {}

    def estimate(c, n):
        a, b = nodes.get((c, n), (0, 0))
        return math.lgamma(a + .5) + math.lgamma(b + .5) - 2 * math.lgamma(.5) - math.lgamma(a + b + 1)

    def weighted(c, n):
        if (c, n) not in memo:
            e = estimate(c, n)
            memo[c, n] = e if len(c) == depth else float(np.logaddexp(
                math.log(.5) + e, math.log(.5) + sum(weighted(x, n) for x in below.get((c, n), ()))))
        return memo[c, n]

    def probability(c, n, bit, whole):
        ab = nodes.get((c, n), (0, 0))
        kt = (ab[bit] + .5) / (sum(ab) + 1)
        if len(c) == depth:
            return kt
        g = math.exp(math.log(.5) + estimate(c, n) - weighted(c, n))
        return g * kt + (1 - g) * probability(whole[depth - len(c) - 1:], n, bit, whole)

    return lambda t: sum(math.log10(probability(b"", n, bit, c)) for c, n, bit in bits(t))


def base_scores(pairs, held):
    tokens = [(t or "").encode().lower().split() + [None] for _, t in pairs]
    c = Counter(x for ts, h in zip(tokens, held) if not h for x in ts)
    unit = math.log10(sum(c.values()) + len(c) + 1)
    return [(len(ts), sum(c[x] > 0 for x in ts), sum(c.values()), sum(math.log10(c[x] + 1) - unit for x in ts)) for ts in tokens]


@pytest.mark.parametrize("docs_each, bytes_each", [(3, ctw.CHUNK_BYTES), (ctw.CHUNK_DOCS, 60)])
def test_context_tree(spark, monkeypatch, docs_each, bytes_each):
    monkeypatch.setattr(ctw, "CHUNK_DOCS", docs_each)
    monkeypatch.setattr(ctw, "CHUNK_BYTES", bytes_each)
    pairs = [(r[0], r[1]) for r in ODD if len(r[1] or "") < 1000] + [(50 + i, f"the thing {i % 3} and the rest ñ") for i in range(8)]
    held = [i % 4 == 1 for i in range(len(pairs))]
    frame = spark.createDataFrame([(*p, h, "clash") for p, h in zip(pairs, held)], "doc_id long, text string, held_out boolean, kind string")
    got = ctw.score_texts(frame).collect()
    tree = plain_tree([t for (_, t), h in zip(pairs, held) if not h])
    key = lambda r: (str(r[0]), *(round(x, 6) for x in r[1:]))
    size = lambda t: len(b" ".join((t or "").encode().split())) + 1
    want = sorted(key((i, *b, tree(t), -tree(t) / math.log10(2) / size(t))) for (i, t), b in zip(pairs, base_scores(pairs, held)))
    have = sorted(key(tuple(r[c] for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")))
                  for r in got)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-6, atol=1e-6)


def test_context_tree_without_training_texts(spark):
    frame = spark.createDataFrame([(1, "ab", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    got = {r["doc_id"]: r for r in ctw.score_texts(frame).collect()}
    assert got[1]["base_score"] == 0 and abs(got[1]["score"] - 24 * math.log10(.5)) < 1e-9
    assert got[2]["n_tokens"] == 1 and got[2]["n_known"] == 0 and got[2]["train_tokens"] == 0
    assert ctw.score_texts(frame.limit(0)).count() == 0


def test_context_tree_query(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op7_context_tree"](spark, SF_SMALL).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    for (i, _), h, b in zip(docs, held, base_scores(docs, held)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, *b[:3])
        assert abs(r["base_score"] - b[3]) < 1e-6 * max(1, abs(b[3])) and r["score"] < 0
    # held-out text is told from text of other statistics
    bits = [-r["score"] / math.log10(2) / r["n_tokens"] for r in got.values() if r["held_out"]]
    assert np.median(bits) < 20
    assert np.median([r["bits_per_byte"] for r in got.values() if r["held_out"]]) < 4


# pipeline

def test_pipeline(spark, duck, docs, bpe):
    from relevo.llm import line_quality

    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({line_quality.ORACLES['op2_line_frequency']}) WHERE kept").fetchall()}
    stage = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = stage.columns
    stage = corpus_pipeline.STAGES[0][1](spark, stage, SF_SMALL)
    assert stage.columns == columns
    first = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert set(first) == kept
    gone = removed_lines(list(first.items()), allowed)
    second = {}
    for i, t in first.items():
        lines = t.split("\n")
        if len(gone[i]) < len([x for x in lines if x.split()]):
            second[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone[i])
    root = set_components(list(second.items()))
    third = [(i, t) for i, t in second.items() if root[i] == i]
    assert len(corpus_pipeline.STAGES) == 4
    check_packing(corpus_pipeline.run(spark, SF_SMALL).collect(), cut(third, bpe))


def test_stages_return_the_columns_of_documents(spark):
    frame = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, SF_SMALL).columns == frame.columns
        assert stage(spark, odd_docs(spark, []), SF_SMALL).count() == 0


def test_line_texts_are_filtered_before_they_are_shuffled(spark):
    docs = odd_docs(spark).select("doc_id", "text")
    member = spark.createDataFrame([(1, 1)], "node bigint, root bigint")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = line_dedup.member_lines(docs, member)._jdf.queryExecution().executedPlan().toString()
        texts = [x for x in plan.splitlines() if "content" in x or "getbit" in x]
        first = next(i for i, x in enumerate(texts) if "getbit" in x)  # the tree is printed from its root
        assert any("Exchange" in x for x in plan.splitlines()[:plan.splitlines().index(texts[first])])
        assert "SortMergeJoin" not in plan and not any("Exchange" in x for x in texts[first:])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# op13

def aligned_by_library(pairs):
    """Counts, links and group texts of each ``(id, text)`` from the libraries' own tokens, one at a time."""
    a_lib = Tokenizer.from_file(BYTE_BPE)
    a_lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.PIECE_MODEL)
    shown = alignment.byte_level_bytes(BYTE_BPE)
    a_bytes = lambda i: bytes(shown[0][shown[1][i]:shown[1][i] + shown[2][i]])
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, linked_ids = [], Counter()
    for i, text in pairs:
        whole = (" " + (text or "")).encode()
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        ends = lambda ids, size: [sum(map(len, map(size, ids[:1])))] if len(ids) == 1 else list(np.cumsum([len(size(x)) for x in ids]))
        a_ends, b_ends = ends(a, a_bytes), ends(b, b_bytes)
        at = {e: k for k, e in enumerate(b_ends)}
        cut = [(k, at[e]) for k, e in enumerate(a_ends) if e in at]
        groups, p, q = [], 0, 0
        for x, y in cut:
            groups.append(",".join(map(str, a[p:x + 1])) + "|" + ",".join(map(str, b[q:y + 1])))
            p, q = x + 1, y + 1
        links = [(a[x], b[y]) for x, y in cut]
        linked_ids.update(links)
        docs.append((i, len(a), len(b), links, ";".join(groups)))
    top = Counter()
    for (_, y), n in linked_ids.items():
        top[y] = max(top[y], n)
    return [(i, n_a, n_b, len(links), len(links), sum(linked_ids[p] == top[p[1]] for p in links), sum(linked_ids[p] for p in links),
             sha(g) if n_a else "") for i, n_a, n_b, links, g in docs]


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment(spark, docs):
    assert sorted(rows(QUERIES["op13_galloping_alignment"](spark, SF_SMALL), *ALIGNED)) == aligned_by_library(docs)


def test_alignment_of_odd_rows(spark, monkeypatch):
    got = Counter(rows(alignment.alignment_report(odd_docs(spark)), *ALIGNED))
    assert got == Counter(aligned_by_library([r[:2] for r in ODD]))
    assert alignment.alignment_report(odd_docs(spark, [])).count() == 0
    full = {r["doc_id"]: r for r in alignment.align_tokens(odd_docs(spark)).where("doc_id IN (1, 4, 8)").collect()}
    assert full[1]["a_ids"] == [] and full[1]["ends"] == []
    text = " " + next(t for i, t, *_ in ODD if i == 8)
    assert full[8]["a_stops"][-1] == len(full[8]["a_ids"]) and full[8]["b_stops"][-1] == len(full[8]["b_ids"])
    assert full[8]["ends"][-1] == len(text.encode()) and len(full[4]["ends"]) == len(full[4]["b_stops"])


def test_pairs_are_counted_over_all_chunks(spark, docs, monkeypatch):
    rows_of = [d for d in docs if len(d[1]) < 400][:60] + [(10**6 + k, "the same words again.") for k in range(40)]
    frame = spark.createDataFrame(rows_of, "doc_id bigint, text string").repartition(5)
    assert sorted(rows(alignment.alignment_report(frame), *ALIGNED)) == sorted(aligned_by_library(rows_of))


def test_galloping_finds_what_sets_find():
    rng = np.random.default_rng(3)
    for lane in (1, 2, 64):
        alignment.LANE, before = lane, alignment.LANE
        for _ in range(40):
            lists = [[np.unique(rng.integers(0, rng.integers(1, 900), rng.integers(0, 300))) for _ in range(7)] for _ in "ab"]
            flat = [np.concatenate(x) for x in lists]
            edges = [np.concatenate([[0], np.cumsum([len(y) for y in x])]) for x in lists]
            ia, ib = alignment.common_ends(flat[0], edges[0], flat[1], edges[1])
            want = [(edges[0][k] + i, edges[1][k] + j) for k, (x, y) in enumerate(zip(*lists))
                    for i, v in enumerate(x) for j in np.flatnonzero(y == v)]
            assert list(zip(ia, ib)) == want
        alignment.LANE = before


# op11

def ranked_by_scoring_all(docs, items, k=50):
    """Best documents of each item by scoring every document, one at a time."""
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    terms = {n: Counter(re.findall(ranked_search.TERM, lower(t))) for n, (_, t) in enumerate(docs)}
    n_docs, n_terms = sum(1 for c in terms.values() if c), sum(sum(c.values()) for c in terms.values())
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                   for t in set(re.findall(ranked_search.TERM, lower(text))) if (df := sum(t in c for c in terms.values()))}
        scores = []
        for n, c in terms.items():
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            s = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c)
            if s > 0:
                scores.append((-s, docs[n][0] is None, docs[n][0] or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_ranked_search_of_odd_rows(spark, monkeypatch):
    items = [(1, "Word same line; of text"), (2, None), (3, "..."), (4, "ñandú 日本語 and5 word3 nowhere"), (1, "Word same line; of text"),
             (None, "tail id")]
    asked = spark.createDataFrame([(*i, "clash", 1) for i in items], "item_id long, text string, doc_id string, number int")
    want = Counter(ranked_by_scoring_all([r[:2] for r in ODD], items, 5))
    for block in (200_000, 3):
        monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
        assert Counter(rows(ranked_search.rank_documents(odd_docs(spark), asked, 5), "item_id", "rank", "doc_id", "score")) == want
    assert ranked_search.rank_documents(odd_docs(spark, []), asked).count() == 0
    assert ranked_search.rank_documents(odd_docs(spark), asked.limit(0)).count() == 0


def test_ranked_search_of_ties_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 37)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"t{min(40, int(x))}" for x in rng.zipf(1.5, rng.integers(0, 30))) for _ in range(60)]
    pairs = [(int(i), texts[rng.integers(0, 60)]) for i in rng.permutation(400)]
    items = [(k, " ".join(f"t{x}" for x in rng.integers(1, 42, 6))) for k in range(15)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    got = ranked_search.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string"), 20)
    assert sorted(rows(got, "item_id", "rank", "doc_id", "score")) == sorted(ranked_by_scoring_all(pairs, items, 20))


def test_search_scores_far_fewer_than_all():
    rng = np.random.default_rng(5)
    docs = [np.flatnonzero(rng.random(5000) < p) for p in (0.9, 0.5, 0.02, 0.01, 0.0004)]
    sizes = np.array([len(d) for d in docs])
    impacts = rng.integers(1, 1000, sizes.sum())
    shard = ranked_search.Shard(np.concatenate(docs), impacts, np.cumsum(sizes) - sizes, sizes)
    weights = np.array([10, 300, 4000, 5000, 9000])
    full, at = np.zeros(5000, dtype=np.int64), 0
    for d, w in zip(docs, weights):
        full[d] += impacts[at:at + len(d)] * w
        at += len(d)
    taken, find = [], shard.find
    shard.find = lambda low, high, doc: taken.append(len(doc)) or find(low, high, doc)
    for batch in (1, 2, 5, 7, 64):
        taken.clear()
        scores, places = shard.search(np.arange(5), weights, 10, batch)
        order = np.lexsort((np.arange(5000), -full))[:10]
        assert scores.tolist() == full[order].tolist() and places.tolist() == order.tolist() and sum(taken) < 1200
