"""Secret scans (operator 12): fixed patterns, and a linear-chain conditional random field that tags tokens.

A text is read as tokens: runs of letters, digits, ``_`` and characters beyond
ASCII; every other ASCII sign by itself; every line end. Each is tagged B (a secret
begins), I (goes on) or O (outside). The score of a tag is a sum of weights
of the token's shape (classes of characters and length, changes of class,
share of vowels, whether it stands against the one before), of the three
words before and the one after, and of the file (shares of tokens with digits
and of signs, length); tags in sequence add the weights of transitions.

Training: the texts with the smallest hashes, ``SAMPLE_DOCS`` at most and each
of ``SAMPLE_CHARS`` characters at most, give segments of ``SEGMENT`` tokens. Their
tags come from the fixed patterns (runs of digits alone are no secrets here).
The conditional likelihood of the tags is raised by AdaGrad on gradients from
forward and backward sums. The sample is bounded by these parameters; all
texts are tagged.

Decoding is exact Viterbi on whole texts: the texts of a block are one chain in
which line ends are outside. It is cut into segments; the best score of
every segment between any two end tags is a 3 x 3 matrix, the matrices are
chained, and then each segment is traced between its now known ends.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.llm.common import read
from relevo.llm.hashing import span_hashes
from relevo.llm.tokens import sized_blocks, utf8

SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_WORDS = 2000, 20_000, 4000
SEGMENT, EPOCHS, RATE, DECAY = 64, 30, 0.3, 1e-4
OUTSIDE, BEGIN, INSIDE = range(3)
#: The fixed patterns, and the least characters of the group that is a secret.
ASSIGN = re.compile(r'''((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''')
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
_NEVER = -1e9


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(kind, start, end, start of the secret)`` of the fixed patterns' matches, by start, then kind."""
    out = [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]  # runs are whole, so shorter ones take nothing away
    return sorted(out, key=lambda s: (s[1], s[0]))


def _byte_kinds() -> np.ndarray:
    """Kind of a byte: 0 white, 1 lower case, 2 upper case, 3 digit, 4 underscore, 5 beyond ASCII, 6 sign, 7 line end."""
    kind = np.full(256, 6, dtype=np.uint8)
    kind[[*range(9, 14), 32]] = 0
    kind[97:123], kind[65:91], kind[48:58], kind[95], kind[128:], kind[10] = 1, 2, 3, 4, 5, 7
    return kind


_KIND = _byte_kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VOWEL = np.isin(np.arange(256), list(b"aeiouyAEIOUY"))
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))


@dataclass
class Tokens:
    """Tokens of a block of texts: byte ``begin`` and ``end`` in ``data``, the ``doc`` of each, and its categorical features."""

    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    line_end: np.ndarray
    word: np.ndarray
    features: np.ndarray


#: Values of the token's own features: shape, changes of class by length, share of vowels by length, place against the last token.
_OWN = (512, 64, 64, 16)
#: Values of a file's features.
_FILE = (5, 5, 5)


def _bucket(x: np.ndarray, *edges: float) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


def tokens_of(data: np.ndarray, edges: np.ndarray) -> Tokens:
    kind = _KIND[data]
    wordlike = (kind >= 1) & (kind <= 5)
    starts = (kind == 6) | (kind == 7) | wordlike
    starts[1:] &= ~(wordlike[1:] & wordlike[:-1])
    first = edges[:-1][np.diff(edges) > 0]
    starts[first] = kind[first] != 0
    begin = np.flatnonzero(starts)
    # a word ends where no word byte follows, or its text does
    stops = np.ones(len(data) + 1, dtype=bool)
    stops[1:-1] = ~(wordlike[1:] & wordlike[:-1])
    stops[edges] = True
    places = np.flatnonzero(stops)
    end = places[np.searchsorted(places, begin, side="right")] if len(begin) else begin
    doc = np.searchsorted(edges, begin, side="right") - 1
    count = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    within = lambda flag: (c := count(flag))[end] - c[begin]
    size = end - begin
    lower, upper, digit, wide, hexes, vowels = (within(f) for f in (
        kind == 1, kind == 2, kind == 3, kind == 5, _HEX[data], _VOWEL[data]))
    change = np.zeros(len(data), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    changes = (c := count(change))[end] - c[np.minimum(begin + 1, len(data))]
    length = _bucket(size, 2, 5, 8, 12, 16, 24, 40)
    shape = (((((lower > 0) * 2 + (upper > 0)) * 2 + (digit > 0)) * 2 + (wide > 0)) * 2 + (hexes == size)) * 8 + length
    sign = kind[begin] >= 6 if len(begin) else np.zeros(0, dtype=bool)
    shape = np.where(sign, 256 + data[begin].astype(np.int64), shape) if len(begin) else shape
    glued = np.zeros(len(begin), dtype=bool)
    glued[1:] = (begin[1:] == end[:-1]) & (doc[1:] == doc[:-1])
    after = np.zeros(len(begin), dtype=bool)
    after[:-1] = glued[1:]
    own = np.stack([shape, _bucket(changes, 1, 2, 3, 5, 8, 12, 18) * 8 + length,
                    _bucket(vowels / np.maximum(size, 1), .01, .15, .25, .33, .4, .5, .7) * 8 + length,
                    glued * 8 + after * 4 + sign * 2 + (digit == size)], axis=1).astype(np.int32)
    per_doc = lambda values: np.bincount(doc, weights=values, minlength=len(edges) - 1)
    n = np.maximum(per_doc(np.ones(len(doc))), 1)
    of_file = np.stack([_bucket(per_doc(digit > 0) / n, .001, .01, .05, .2), _bucket(per_doc(sign) / n, .05, .15, .3, .5),
                        _bucket(n, 50, 300, 1500, 6000)], axis=1)
    return Tokens(begin, end, doc, (data[begin] == 10) if len(begin) else sign,
                  span_hashes(_LOWER[data], begin, end), np.concatenate([own, of_file[doc].astype(np.int32)], axis=1))


class Tagger:
    """Weights of a linear-chain conditional random field over tokens."""

    NEAR = (-3, -2, -1, 1)

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)  # hashes of the words that are told apart
        sizes = [*_OWN, *_FILE, *[len(self.words) + 514] * len(self.NEAR)]
        self.starts = np.cumsum([0, *sizes])
        self.weights = np.zeros((self.starts[-1], 3))
        self.steps = np.zeros((3, 3))
        self.steps[OUTSIDE, INSIDE] = _NEVER

    def rows(self, tokens: Tokens) -> np.ndarray:
        """Numbers of the weights that hold for each token: (tokens, features)."""
        at = np.minimum(np.searchsorted(self.words, tokens.word), max(len(self.words) - 1, 0))
        known = self.words[at] == tokens.word if len(self.words) else np.zeros(len(at), dtype=bool)
        near = np.where(known, 514 + at, 2 + tokens.features[:, 0])
        n, out = len(near), [tokens.features + self.starts[:tokens.features.shape[1]]]
        for k, offset in enumerate(self.NEAR):
            seen = np.zeros(n, dtype=np.int64)  # 0: nothing there, 1: another text
            low, high = max(0, -offset), n - max(0, offset)
            if high > low:
                there = near[low + offset:high + offset]
                seen[low:high] = np.where(tokens.doc[low:high] == tokens.doc[low + offset:high + offset], there, 1)
            out.append((seen + self.starts[tokens.features.shape[1] + k])[:, None])
        return np.concatenate([x.astype(np.int32) for x in out], axis=1)

    def scores(self, rows: np.ndarray, line_end: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 3))
        for k in range(rows.shape[1]):
            out += self.weights[rows[:, k]]
        out[line_end] = (0, _NEVER, _NEVER)
        return out

    def fit(self, rows: np.ndarray, line_end: np.ndarray, tags: np.ndarray, before: np.ndarray) -> float:
        """Raise the conditional likelihood of ``tags`` of segments (segments, SEGMENT), given the tag ``before`` each.

        ``rows`` is (segments, SEGMENT, features). Returns the last mean log-likelihood of a token.
        """
        n, size, _ = rows.shape
        given, step_given = np.full_like(self.weights, 1e-6), np.full((3, 3), 1e-6)
        truth = np.eye(3)[tags]
        previous = np.concatenate([before[:, None], tags[:, :-1]], axis=1)
        total = 0.0
        for _ in range(EPOCHS):
            e = self.scores(rows.reshape(n * size, -1), line_end.reshape(-1)).reshape(n, size, 3)
            forward, backward = np.empty((n, size, 3)), np.zeros((n, size, 3))
            add = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
            forward[:, 0] = self.steps[before] + e[:, 0]
            for t in range(1, size):
                forward[:, t] = add(forward[:, t - 1, :, None] + self.steps, 1) + e[:, t]
            for t in range(size - 2, -1, -1):
                backward[:, t] = add(self.steps + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            z = add(forward[:, -1], 1)
            belief = np.exp(forward + backward - z[:, None, None])
            gold = np.take_along_axis(e, tags[..., None], 2).sum() + self.steps[previous, tags].sum()
            total = float((gold - z.sum()) / (n * size))
            gradient = np.zeros_like(self.weights)
            error = (truth - belief).reshape(-1, 3)
            for k in range(rows.shape[2]):
                of = rows[:, :, k].reshape(-1)
                for tag in range(3):
                    gradient[:, tag] += np.bincount(of, weights=error[:, tag], minlength=len(gradient))
            expected = np.zeros((3, 3))
            for t in range(1, size):
                pair = forward[:, t - 1, :, None] + self.steps + (e[:, t] + backward[:, t])[:, None, :]
                expected += np.exp(pair - z[:, None, None]).sum(axis=0)
            first = belief[:, 0]
            for tag in range(3):
                expected[tag] += first[before == tag].sum(axis=0)
            step = np.zeros((3, 3))
            np.add.at(step, (previous.reshape(-1), tags.reshape(-1)), 1)
            for weights, g, sums in ((self.weights, gradient, given), (self.steps, step - expected, step_given)):
                g = g - DECAY * n * np.where(weights <= _NEVER, 0, weights)
                sums += g * g
                weights += RATE * g / np.sqrt(sums)
            self.steps[OUTSIDE, INSIDE] = _NEVER
        return total

    def best(self, e: np.ndarray, size: int = SEGMENT) -> np.ndarray:
        """The tags of the highest score for one chain of tokens with tag scores ``e``."""
        n = len(e)
        if not n:
            return np.zeros(0, dtype=np.int8)
        n_parts = -(-n // size)
        padded = np.zeros((n_parts * size, 3))
        padded[len(padded) - n:] = e  # tokens outside before the first one change nothing
        padded[:len(padded) - n, 1:] = _NEVER
        e = padded.reshape(n_parts, size, 3)
        between = np.where(np.eye(3, dtype=bool), 0.0, 4 * _NEVER)[None].repeat(n_parts, axis=0)
        for t in range(size):  # best score of each part from any tag before it to any tag at its end
            between = np.maximum((between[:, :, :, None] + self.steps).max(axis=2), 4 * _NEVER) + e[:, None, t]
        value, values = [0.0, 4 * _NEVER, 4 * _NEVER], []
        for m in between.tolist():
            values.append(value)
            value = [max(value[0] + m[0][j], value[1] + m[1][j], value[2] + m[2][j]) for j in range(3)]
            top = max(value)
            value = [v - top for v in value]
        tag = value.index(max(value))
        ends, begins = np.empty(n_parts, dtype=np.int64), np.empty(n_parts, dtype=np.int64)
        for part in range(n_parts - 1, -1, -1):
            m, ends[part] = between[part], tag
            reach = [values[part][i] + m[i, tag] for i in range(3)]
            tag = reach.index(max(reach))
            begins[part] = tag
        score, came = np.full((n_parts, 3), 4 * _NEVER), np.empty((size, n_parts, 3), dtype=np.int8)
        score[np.arange(n_parts), begins] = 0
        for t in range(size):
            ways = score[:, :, None] + self.steps
            came[t] = ways.argmax(axis=1)
            score = np.maximum(ways.max(axis=1), 4 * _NEVER) + e[:, t]
        tags = np.empty((size, n_parts), dtype=np.int8)
        at = ends
        for t in range(size - 1, -1, -1):
            tags[t] = at
            at = came[t][np.arange(n_parts), at]
        return tags.T.reshape(-1)[n_parts * size - n:]


def _characters(data: np.ndarray) -> np.ndarray:
    """Code points before each byte and the end."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def train(texts: list[str]) -> Tagger:
    """A tagger fitted to the fixed patterns' secrets in the texts; without any it tags nothing."""
    data, edges = utf8(pa.array(texts, type=pa.string()))
    tokens, chars = tokens_of(data, edges), _characters(data)
    begin, end = chars[tokens.begin], chars[tokens.end]
    tags = np.zeros(len(begin), dtype=np.int64)
    for doc, text in enumerate(texts):
        for _, _, stop, start in base_spans(text):
            if text[start:stop].isdigit():
                continue
            shift = chars[edges[doc]]
            a, b = np.searchsorted(begin, start + shift), np.searchsorted(end, stop + shift, side="right")
            if b > a:
                tags[a:b] = INSIDE
                tags[a] = BEGIN
    secret = np.flatnonzero(tags)
    near = np.unique(np.clip(secret[:, None] + np.array([-3, -2, -1, 1]), 0, max(len(tags) - 1, 0)))
    near = near[tags[near] == OUTSIDE] if len(secret) else near[:0]
    words, times = np.unique(tokens.word[near], return_counts=True)
    common = words[np.lexsort((words, -times))][:SAMPLE_WORDS]
    tagger = Tagger(common[np.isin(common, words[times > 1])])
    whole = len(tags) // SEGMENT * SEGMENT
    if not len(secret) or not whole:
        tagger.weights[:_OWN[0], OUTSIDE] = 1.0
        return tagger
    parts = tags[:whole].reshape(-1, SEGMENT)
    held = parts.any(axis=1)
    others = np.flatnonzero(~held)
    # all segments with a secret, and evenly spaced others, twenty times as many and two thousand at least
    others = others[np.unique(np.linspace(0, len(others) - 1, min(len(others), max(2000, 20 * int(held.sum())))).astype(int))] if len(
        others) else others
    chosen = np.sort(np.concatenate([np.flatnonzero(held), others]))
    before = np.concatenate([[OUTSIDE], tags[SEGMENT - 1:whole - 1:SEGMENT]])[chosen]
    rows = tagger.rows(tokens)[:whole].reshape(len(parts), SEGMENT, -1)[chosen]
    tagger.fit(rows, tokens.line_end[:whole].reshape(-1, SEGMENT)[chosen], parts[chosen], before)
    return tagger


def found_spans(tagger: Tagger, texts: pa.Array) -> list[list[tuple[int, int]]]:
    """Spans (code points) that the tagger finds in each text: a B with the I after it."""
    data, edges = utf8(texts)
    tokens = tokens_of(data, edges)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    tags = tagger.best(tagger.scores(tagger.rows(tokens), tokens.line_end))
    starts = np.flatnonzero(tags == BEGIN)
    if not len(starts):
        return out
    stops = np.flatnonzero(np.append(tags, OUTSIDE) != INSIDE)
    last = stops[np.searchsorted(stops, starts, side="right")] - 1
    chars = _characters(data)
    for a, b in zip(starts.tolist(), last.tolist()):
        doc = int(tokens.doc[a])
        b = a + int((tokens.doc[a:b + 1] == doc).sum()) - 1  # a chain of texts: a span ends with its text
        shift = int(chars[edges[doc]])
        out[doc].append((int(chars[tokens.begin[a]]) - shift, int(chars[tokens.end[b]]) - shift))
    return out


def sample_texts(docs: DataFrame, most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[str]:
    """Different texts with the smallest hashes: at most ``most``, none longer than ``chars``. Only hashes are ordered."""
    hashed = docs.where((F.length("text") > 0) & (F.length("text") <= chars)).select(F.xxhash64("text").alias("h"), "text")
    lowest = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(most).collect()]
    if not lowest:
        return []
    rows = hashed.where(F.col("h") <= lowest[-1]).dropDuplicates(["h"]).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["h"])]


def scan_secrets(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``(doc_id, spans)`` of every row of ``(doc_id, text)``: kind, start and end (code points, end exclusive) of every secret.

    Kinds are the fixed patterns' (``assign``, ``access``, ``hex``) and ``crf``, spans that
    the tagger adds where none of those overlaps; by start, then kind. Null and
    empty texts have none. Rows are independent: repeated rows, null ids and other columns
    do not matter. An empty table gives no row. Without a tagger one is trained on a sample of ``docs``.
    """
    tagger = tagger or train(sample_texts(docs))

    def run(batches):
        for b in sized_blocks(batches):
            added = found_spans(tagger, b["text"])
            rows = []
            for text, more in zip(b["text"].to_pylist(), added):
                base = [(k, s, e) for k, s, e, _ in base_spans(text or "")]
                more = [(3, s, e) for s, e in more if not any(s < y and x < e for _, x, y in base)] if base else [
                    (3, s, e) for s, e in more]
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(base + more, key=lambda x: (x[1], x[0]))])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(rows, type=kind)], names=["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op12_chain_field_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the fixed patterns' secrets and all spans of every document."""
    found = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


QUERIES = {"op12_chain_field_secrets": op12_chain_field_secrets}
ORACLES: dict[str, str] = {}
