"""LM scoring (operator 7): context-tree weighting over bytes.

Every byte is eight binary decisions. In the context of the last d bytes,
d = 0 to ``DEPTH``, each decision has a node with the zeros and ones counted
over the training texts and their Krichevsky-Trofimov probability P_e. A node
of full depth has P_w = P_e, any other P_w = (P_e + product of P_w over the
contexts one byte longer) / 2. A byte is coded with the counts as trained: at
each node the probability of a bit is the KT estimate with the posterior
weight P_e / (2 P_w), and that of the longer context with the rest.

The text that is scored is its lower-cased words with one space between them
and an end byte; it starts in a context of zero bytes.

On Spark: tasks count windows of ``DEPTH`` + 1 bytes and word hashes and send
them, packed, to hash buckets, which add them up. Windows whose context ends
in the same two bytes hold a whole subtree, so the trees are weighted per byte
pair; only the two top levels (at most 257 x 255 nodes) are put together on
the driver. Each distinct window then has one code length. For scoring,
chunks of documents ask the buckets for their windows' code lengths and
their words' counts, and the answers meet the documents again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.llm.common import read
from relevo.llm.hashing import mix, word_hashes
from relevo.llm.tokens import text_blocks
from relevo.session import write_shared

DEPTH = 5
#: Documents, and bytes of their texts, that are scored together on average.
CHUNK_DOCS, CHUNK_BYTES = 6000, 24 << 20
HALF = math.log(0.5)
_TABLE = 256
_LG_HALF = np.array([math.lgamma(n + 0.5) - math.lgamma(0.5) for n in range(_TABLE)])
_LG_ONE = np.array([math.lgamma(n + 1.0) for n in range(_TABLE)])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)


def _rising(n: np.ndarray, table: np.ndarray, start: float) -> np.ndarray:
    """log Gamma(n + start) - log Gamma(start) of counts."""
    big = n >= _TABLE
    out = table[np.where(big, 0, n).astype(np.int64)]
    out[big] = _stirling(n[big] + start) - math.lgamma(start)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log probability of a sequence with ``a`` zeros and ``b`` ones under the Krichevsky-Trofimov estimator."""
    return _rising(a, _LG_HALF, 0.5) + _rising(b, _LG_HALF, 0.5) - _rising(a + b, _LG_ONE, 1.0)


def windows(texts: list[str | None], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The windows (context and byte, most recent byte lowest) of each byte of the texts, and bytes per text."""
    parts = [b" ".join((t or "").encode().lower().split()) + b"\0" for t in texts]
    n = np.array([len(p) for p in parts], dtype=np.int64)
    pad = b"\0" * depth
    data = np.frombuffer(pad + pad.join(parts), dtype=np.uint8).astype(np.uint64)
    size = len(data) - depth
    keys = np.zeros(max(size, 0), dtype=np.uint64)
    for i in range(depth + 1):
        keys = keys << np.uint64(8) | data[i:size + i]
    begin = np.cumsum(n + depth) - (n + depth)
    use = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return keys[use], n


class Counter:
    """Sorted distinct keys with counts, added to part by part."""

    def __init__(self):
        self.parts, self.size, self.floor = [], 0, 1 << 20

    def add(self, keys: np.ndarray, weight: int) -> None:
        keys, n = np.unique(keys, return_counts=True)
        self.parts.append((keys, n * weight))
        self.size += len(keys)
        if self.size > self.floor:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])
            self.floor = 2 * self.size + (1 << 20)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return add_up(self.parts)


def add_up(parts) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _ordered(keys: np.ndarray, bits: int):
    """Order of the keys by bucket and hash, the buckets there are and where each begins and ends."""
    h = mix(keys)
    order = np.argsort(h)
    edges = np.searchsorted(h[order] >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(keys)])
    return order, np.flatnonzero(np.diff(edges)), edges


def _binary(values) -> pa.Array:
    return pa.array([v.tobytes() for v in values], type=pa.binary())


WINDOWS, WORDS = 0, 1


def _count(bits: int):
    """Windows and words of every chunk of documents by bucket; those of held-out texts with count 0."""
    def pack(kind: int, counter: Counter):
        keys, n = counter.total()
        order, used, edges = _ordered(keys, bits)
        keys, n = keys[order], n[order]
        k = [keys[edges[b]:edges[b + 1]] for b in used]
        c = [n[edges[b]:edges[b + 1]].astype("<i8") for b in used]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(used), kind, dtype=np.int32)), pa.array(used.astype(np.int32)), _binary(k), _binary(c)],
            names=["kind", "bucket", "keys", "counts"])

    def run(batches):
        counters, docs = (Counter(), Counter()), 0
        for b in text_blocks(batches):
            texts, held = b["text"].to_pylist(), b["held_out"].to_pylist()
            for weight in (0, 1):
                some = [t for t, h in zip(texts, held) if h == (not weight)]
                if some:
                    counters[WINDOWS].add(windows(some)[0], weight)
                    counters[WORDS].add(np.concatenate([word_hashes(t) for t in some]), weight)
            docs += len(texts)
            if docs >= CHUNK_DOCS:
                yield from (pack(k, c) for k, c in enumerate(counters))
                counters, docs = (Counter(), Counter()), 0
        if docs:
            yield from (pack(k, c) for k, c in enumerate(counters))
    return run


def _blobs(rows: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for x in rows[name].to_pylist()]


def _merge(rows: pa.Table) -> pa.Table:
    """A bucket's counts added up: windows by the two bytes before the last, words in one row with their totals."""
    kind, bucket = rows["kind"][0].as_py(), rows["bucket"][0].as_py()
    keys, n = add_up(list(zip(_blobs(rows, "keys", "<u8"), _blobs(rows, "counts", "<i8"))))
    if kind == WORDS:
        groups = [(0, keys, n)]
        tokens, distinct = int(n.sum()), int((n > 0).sum())
    else:
        pair = (keys >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)
        order = np.argsort(pair, kind="stable")
        keys, n, pair = keys[order], n[order], pair[order]
        at = np.concatenate([[0], np.flatnonzero(np.diff(pair)) + 1, [len(pair)]])
        groups = [(int(pair[s]), keys[s:e], n[s:e]) for s, e in zip(at[:-1], at[1:])]
        tokens = distinct = 0
    p, k, c = zip(*groups)
    size = len(groups)
    return pa.table({"kind": pa.array([kind] * size, type=pa.int32()), "bucket": pa.array([bucket] * size, type=pa.int32()),
                     "pair": pa.array(p, type=pa.int32()), "keys": _binary(k), "counts": _binary(c),
                     "tokens": pa.array([tokens] + [0] * (size - 1), type=pa.int64()),
                     "distinct": pa.array([distinct] + [0] * (size - 1), type=pa.int64())})


class Subtree:
    """Nodes at depths ``DEPTH`` to 2 for the windows of one byte pair, weighted from the deepest up."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH):
        byte = (keys & np.uint64(255)).astype(np.int64)[:, None]
        shift = np.arange(8)[None, :]
        # decision j of a byte: the node its first j bits lead to, and its bit
        self.node = (1 << shift | byte >> 8 - shift)
        self.bit = byte >> 7 - shift & 1
        context = (keys >> np.uint64(8)).astype(np.int64)[:, None]
        weight = np.broadcast_to(counts[:, None], self.node.shape).ravel()
        one = weight * self.bit.ravel()
        self.levels = []
        longer = None
        for d in range(depth, 1, -1):
            ids, inverse = np.unique(((context & (1 << 8 * d) - 1) << 8 | self.node).ravel(), return_inverse=True)
            b = np.bincount(inverse, weights=one)
            a = np.bincount(inverse, weights=weight) - b
            estimate = log_kt(a, b)
            if longer is None:
                total, gamma = estimate, np.ones(len(ids))
            else:
                below, p = longer
                parent = np.searchsorted(ids, (below >> 8 & (1 << 8 * d) - 1) << 8 | below & 255)
                split = np.bincount(parent, weights=p, minlength=len(ids))
                total = np.logaddexp(HALF + estimate, HALF + split)
                gamma = np.exp(HALF + estimate - total)
            self.levels.append((inverse.reshape(self.node.shape), a, b, gamma))
            self.ids, self.total, longer = ids, total, (ids, total)

    def probabilities(self) -> np.ndarray:
        """Probability of every bit of every window by the contexts of two bytes and more."""
        p = None
        for inverse, a, b, gamma in self.levels:
            kt = (np.where(self.bit == 1, b[inverse], a[inverse]) + 0.5) / (a[inverse] + b[inverse] + 1)
            p = kt if p is None else gamma[inverse] * kt + (1 - gamma[inverse]) * p
        return p


def _top(rows: pa.Table) -> pa.Table:
    """Nodes of one byte pair at depth 2: the last byte, the decision, counts and log P_w."""
    t = Subtree(np.concatenate(_blobs(rows, "keys", "<u8")), np.concatenate(_blobs(rows, "counts", "<i8")))
    _, a, b, _ = t.levels[-1]
    return pa.table({"last": pa.array((t.ids >> 8 & 255).astype(np.int32)), "node": pa.array((t.ids & 255).astype(np.int32)),
                     "a": pa.array(a), "b": pa.array(b), "total": pa.array(t.total)})


def _top_levels(rows) -> tuple:
    """KT counts and weights of depths 1 and 0 from summed depth-2 nodes."""
    a, b, split = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for r in rows:
        a[r["last"], r["node"]], b[r["last"], r["node"]], split[r["last"], r["node"]] = r["a"], r["b"], r["total"]
    estimate = log_kt(a, b)
    total = np.logaddexp(HALF + estimate, HALF + split)
    root_a, root_b = a.sum(axis=0), b.sum(axis=0)
    root = log_kt(root_a, root_b)
    root_total = np.logaddexp(HALF + root, HALF + total.sum(axis=0))
    return a, b, np.exp(HALF + estimate - total), root_a, root_b, np.exp(HALF + root - root_total)


def _lengths(top: tuple, bits: int):
    """log10 probability of every window of a byte pair, by bucket."""
    a, b, gamma, root_a, root_b, root_gamma = top

    def run(rows: pa.Table) -> pa.Table:
        keys = np.concatenate(_blobs(rows, "keys", "<u8"))
        t = Subtree(keys, np.concatenate(_blobs(rows, "counts", "<i8")))
        last = (keys >> np.uint64(8) & np.uint64(255)).astype(np.int64)[:, None]
        pick = lambda x, y, at: (np.where(t.bit == 1, y[at], x[at]) + 0.5) / (x[at] + y[at] + 1)
        g = gamma[last, t.node]
        p = g * pick(a, b, (last, t.node)) + (1 - g) * t.probabilities()
        g = root_gamma[t.node]
        p = g * pick(root_a, root_b, t.node) + (1 - g) * p
        value = np.log10(p).sum(axis=1).astype("<f8")
        order, used, edges = _ordered(keys, bits)
        keys, value = keys[order], value[order]
        cut = lambda x: _binary([x[edges[i]:edges[i + 1]] for i in used])
        return pa.table({"kind": pa.array([WINDOWS] * len(used), type=pa.int32()), "bucket": pa.array(used.astype(np.int32)),
                         "keys": cut(keys), "found": cut(value)})
    return run


def _chunk_keys(texts: list[str | None], bits: int):
    """Distinct windows and words of a chunk in bucket order, with the buckets and their bounds."""
    out = []
    for one in (lambda ts: windows(ts)[0], lambda ts: np.concatenate([word_hashes(t) for t in ts])):
        counter = Counter()
        for i in range(0, len(texts), 128):
            counter.add(one(texts[i:i + 128]), 1)
        keys = counter.total()[0]
        order, used, edges = _ordered(keys, bits)
        out.append((keys[order], used, edges))
    return out


def _ask(bits: int):
    def run(chunk: pa.Table) -> pa.Table:
        rows = [(kind, b, keys[edges[b]:edges[b + 1]].tobytes())
                for kind, (keys, used, edges) in enumerate(_chunk_keys(chunk["text"].to_pylist(), bits)) for b in used.tolist()]
        kind, bucket, keys = zip(*rows) if rows else ((), (), ())
        return pa.table({"kind": pa.array(kind, type=pa.int32()), "bucket": pa.array(bucket, type=pa.int32()),
                         "chunk": pa.array([chunk["chunk"][0].as_py()] * len(rows), type=pa.int32()),
                         "keys": pa.array(keys, type=pa.binary())})
    return run


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For each chunk's keys of a bucket, in their order, what is known of them (every key is known)."""
    if not asked.num_rows:
        return pa.table({"chunk": pa.array([], type=pa.int32()), "kind": pa.array([], type=pa.int32()),
                         "bucket": pa.array([], type=pa.int32()), "found": pa.array([], type=pa.binary())})
    kind = asked["kind"][0].as_py()
    keys, values = np.concatenate(_blobs(known, "keys", "<u8")), np.concatenate(_blobs(known, "found", "<f8"))
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    found = [values[np.searchsorted(keys, k)].astype("<f8") for k in _blobs(asked, "keys", "<u8")]
    return pa.table({"chunk": asked["chunk"], "kind": pa.array([kind] * len(found), type=pa.int32()),
                     "bucket": asked["bucket"], "found": _binary(found)})


def _look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of the asked keys; searched in ascending order, in which neighbours lie close together in memory."""
    order = np.argsort(asked)
    out = np.empty(len(asked))
    out[order] = values[np.searchsorted(keys, asked[order])]
    return out


def _score(tokens: int, distinct: int, docs: int, bits: int):
    """Scores of a chunk's documents. ``tokens`` and ``distinct`` are of the training words, ``docs`` the training texts."""
    total = tokens + docs
    unit = math.log10(total + distinct + bool(docs) + 1)

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        texts = chunk["text"].to_pylist()
        found = []
        for kind, (keys, _, _) in enumerate(_chunk_keys(texts, bits)):
            mine = answers.filter(pa.compute.equal(answers["kind"], kind)).sort_by("bucket")
            values = np.concatenate([*_blobs(mine, "found", "<f8"), np.zeros(0)])
            order = np.argsort(keys)
            found.append((keys[order], values[order]))
        (w_keys, w_values), (t_keys, t_values) = found
        end = math.log10(docs + 1) - unit
        rows = []
        for i in range(0, len(texts), 128):
            keys, n = windows(texts[i:i + 128])
            scores = np.add.reduceat(_look_up(w_keys, w_values, keys), np.cumsum(n) - n)
            words = [word_hashes(t) for t in texts[i:i + 128]]
            counts = np.split(_look_up(t_keys, t_values, np.concatenate(words)), np.cumsum([len(w) for w in words[:-1]]))
            for c, s, size in zip(counts, scores.tolist(), n.tolist()):
                rows.append((len(c) + 1, int((c > 0).sum()) + bool(docs),
                             float(np.log10(c + 1).sum() - len(c) * unit) + end, s, -s / math.log10(2) / size))
        n, known, base, score, length = zip(*rows)
        return pa.table({"doc_id": chunk["doc_id"], "held_out": chunk["held_out"], "n_tokens": pa.array(n, type=pa.int64()),
                         "n_known": pa.array(known, type=pa.int64()), "train_tokens": pa.array([total] * len(rows), type=pa.int64()),
                         "base_score": pa.array(base), "score": pa.array(score), "bits_per_byte": pa.array(length)})
    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """Scores of every row of ``(doc_id, text, held_out)`` by the model of those not held out.

    ``score`` is the log10 probability of the text, ``bits_per_byte`` its code
    length divided by the bytes that are coded, the end byte among them.
    A null text is empty: its only token is its end. Rows that repeat an id
    count and are scored each. Without training texts every bit has
    probability one half. An empty table gives no row.
    """
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    sizes = docs.agg(F.count("*").alias("n"), F.count(F.when(~F.col("held_out"), 1)).alias("train"),
                     F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    chunks = max(1, -(-sizes["n"] // CHUNK_DOCS), -(-sizes["bytes"] // CHUNK_BYTES))
    bits = max(0, (chunks - 1).bit_length())
    counted = docs.select("text", "held_out").mapInArrow(_count(bits), "kind int, bucket int, keys binary, counts binary")
    merged = write_shared(counted.groupBy("kind", "bucket").applyInArrow(
        _merge, "kind int, bucket int, pair int, keys binary, counts binary, tokens bigint, distinct bigint"), "ctw-counts")
    totals = merged.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
                        F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct")).first()
    trees = merged.where(F.col("kind") == WINDOWS).select("pair", "keys", "counts")
    level = trees.groupBy("pair").applyInArrow(_top, "last int, node int, a double, b double, total double")
    top = _top_levels(level.groupBy("last", "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"),
                                                        F.sum("total").alias("total")).collect())
    lengths = trees.groupBy("pair").applyInArrow(_lengths(top, bits), "kind int, bucket int, keys binary, found binary")
    words = merged.where(F.col("kind") == WORDS).select("kind", "bucket", "keys", "counts").mapInArrow(
        _as_double, "kind int, bucket int, keys binary, found binary")
    known = write_shared(lengths.union(words), "ctw-known")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    asked = dealt.groupBy("chunk").applyInArrow(_ask(bits), "kind int, bucket int, chunk int, keys binary")
    answers = asked.groupBy("kind", "bucket").cogroup(known.groupBy("kind", "bucket")).applyInArrow(
        _answer, "chunk int, kind int, bucket int, found binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(totals["tokens"], totals["distinct"], sizes["train"], bits),
        f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
        "score double, bits_per_byte double")


def _as_double(batches):
    for b in batches:
        found = [x.astype("<f8") for x in _blobs(b, "counts", "<i8")]
        yield pa.RecordBatch.from_arrays([b["kind"], b["bucket"], b["keys"], _binary(found)],
                                         names=["kind", "bucket", "keys", "found"])


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learning from those whose crc32 of the id as text leaves another rest by 7 than 2."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return score_texts(read(spark, sf_dir, "documents").select("doc_id", "text", (rest == 2).alias("held_out")))


QUERIES = {"op7_context_tree": op7_context_tree}
ORACLES: dict[str, str] = {}
