"""Parts that need no Spark session."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

from relevo.llm import ctw, line_dedup, packing, piece_codec, sketch, trie
from relevo.llm.hashing import BLOCK, window_hashes, word_hashes
from relevo.llm.tokens import BYTE_BPE, ByteBpe, sized_blocks
from tests.llm.helpers import Groups, edit_distance

SIGNS = ["a", "foo", "The", " ", " ", "\n", "\t", "  ", ".", ",", ". ", ", ", ".\n", "'s", '"', ")", "3", "14", "é", "ß", "日本", "_",
         "\x00", "<|endoftext|>", "<s>", "▁", "́", "\r\n", "…", "-", "don't", "½", "\x1c", "​", "😀"]


def texts(seed, n, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_units_give_the_whole_texts_ids():
    for plain in (False, True):
        bpe, sample = ByteBpe(plain=plain, cache_units=500), [None, "", "<|endoftext|>", "a  <|endoftext|>  b", *texts(1, 6000)]
        library = Tokenizer.from_file(BYTE_BPE)
        library.encode_special_tokens = plain
        for at in range(0, len(sample), 50):
            part = sample[at:at + 50]
            ids, edges = bpe.encode(pa.array(part, type=pa.string()))
            for t, a, b in zip(part, edges, edges[1:]):
                assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids, t
        assert bpe.old and len(bpe.known) < 2000
        assert [len(x) for x in bpe.encode(pa.array([], type=pa.string()))] == [0, 1]


def test_blocks_of_bytes_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["é" * 40, None, "", "a" * 500, "b", "c" * 99]})
    cut = list(sized_blocks([batch, batch.slice(2, 3), batch.slice(0, 0)], 100))
    assert [b.num_rows for b in cut] == [3, 1, 2, 1, 1, 1]
    assert [t for b in cut for t in b["text"].to_pylist()] == batch["text"].to_pylist() + batch["text"].to_pylist()[2:5]


def test_pieces_and_spans():
    codec = piece_codec.PieceCodec(cache_chars=2000)
    assert codec.by_unit
    for t in texts(2, 4000):
        ids = codec.encode(t)
        assert ids.tolist() == codec.sp.encode(t), t
        spans = codec.spans(t, ids)
        raw = t.encode()
        assert (spans[0], spans[-1]) == (0, len(raw)) and (np.diff(spans) >= 0).all()
        if "▁" not in t:
            whole = b"".join(bytes([int(p[3:-1], 16)]) if codec.sp.is_byte(int(i)) else p.replace("▁", " ").encode()
                             for i, p in zip(ids, map(codec.sp.id_to_piece, ids.tolist())))
            assert whole.removeprefix(b" ") == raw or not t


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normaliser_is_the_librarys(rule, squeeze):
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=squeeze,
                                                escape_whitespaces=True)
    own = piece_codec.Normaliser(pb.ModelProto.FromString(lib.serialized_model_proto()).normalizer_spec)
    for t in ["Ａbc  ﬁx ½ ", " a  b ", "x", "", "étude Ünï", "ｶﾞ㍿ 1", "　a\t\nb", "   ", "a​b", "ABC ß", "한국 각"] + [
            t for t in texts(3, 300) if "\x00" not in t]:
        normal, align = own.align(t)
        want, offsets = lib.normalize(t, with_offsets=True)
        assert normal.decode() == want, t
        starts = np.cumsum([0] + [len(c.encode()) for c in want])
        chars = np.cumsum([0] + [len(c.encode()) for c in t])
        if want:
            assert align[starts[:-1]].tolist() == chars[np.array(offsets[:-1])].tolist(), t


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(4000):
        a = "".join(rng.choice("abñ") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "ñ"])
        a, b = sorted((a, "".join(b)), key=len)
        for k in (1, 2, 3):
            if len(b) - len(a) <= k:
                assert line_dedup.within(line_dedup.places(a, k), len(a), b, k) == (edit_distance(a, b) <= k), (a, b, k)
        for k in (1, 9, 14):
            assert line_dedup.near(b, a, k) == (edit_distance(a, b) <= k), (a, b, k)


def test_keys_of_near_lines_meet():
    rng = random.Random(4)
    for n in (24, 47, 48, 61, 100, 149, 150, 153, 156, 200, 300, 1200):
        for _ in range(40):
            a = "".join(rng.choice("ab cñ") for _ in range(n))
            b = list(a)
            for _ in range(line_dedup.edits_certain(n - n // 24 if n >= 150 else n)):
                at = rng.randint(0, len(b))
                b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "ñ"])
            b = "".join(b)
            k = int(line_dedup.edits_allowed(min(len(a), len(b))))
            if a == b or edit_distance(a, b) > k:
                continue
            keys, rows, own = line_dedup._keys([a, b])
            mine = lambda r, o: {x for x, y, z in zip(keys.tolist(), rows.tolist(), own.tolist()) if y == r and z >= o}
            assert mine(0, 1) & mine(1, 0) or mine(1, 1) & mine(0, 0)


def test_very_long_lines_have_the_same_keys_in_slices(monkeypatch):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abc d") for _ in range(n)) for n in (900, 40, 160, 1499)] + ["=" * 700, "ab" * 900]
    shown = lambda found: sorted(zip(*(x.tolist() for x in found)))
    whole = shown(line_dedup._keys(lines))
    monkeypatch.setattr(line_dedup, "BLOCK", 200)
    assert shown(line_dedup._keys(lines)) == whole
    assert len([x for x in whole if x[1] == 4]) < 60  # a line that repeats itself has a key for a place band


def test_long_lines_with_many_scattered_edits_are_found():
    rng = random.Random(12)
    for n in (60, 140, 200, 500, 1500):
        hits = 0
        for _ in range(60):
            a = "".join(rng.choice("abcdefghijk lmnop") for _ in range(n))
            b = list(a)
            for at in rng.sample(range(n), n // 24):
                b[at] = rng.choice(["", "#", b[at] + "#"])
            links = line_dedup.linked_lines({1: a, 2: "".join(b), 3: a[::-1]})
            hits += [tuple(sorted(x)) for x in links] == [(1, 2)]
        assert hits >= 54, (n, hits)


def test_tree_finds_all_components(percent=85):
    rng = random.Random(6)
    for _ in range(60):
        base = [rng.sample(range(200), rng.randint(1, 60)) for _ in range(4)]
        sets = []
        for _ in range(rng.randint(2, 40)):
            s = set(rng.choice(base))
            for _ in range(rng.randint(0, 6)):
                s ^= {rng.randrange(250)}
            sets.append(np.array(sorted(s or {1}), dtype=np.uint64))
        whole, found = Groups(range(len(sets))), Groups(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                o = len(np.intersect1d(a, sets[j]))
                if 100 * o >= percent * (len(a) + len(sets[j]) - o):
                    whole.join(i, j)
        for a, b in trie.linked(np.arange(len(sets)), sets, percent):
            found.join(a, b)
        assert [whole.find(i) for i in whole.up] == [found.find(i) for i in found.up]


def test_packing_of_counts():
    rng = random.Random(7)
    for n in (0, 1, 5, 40, 400, 4000):
        counts = Counter(min(1024, int(rng.lognormvariate(6, 1)) + 1) for _ in range(n))
        plan = packing.pack_counts(counts)
        held = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 1024
            for s in pattern:
                held[s] += times
        assert held == counts
        least = -(-sum(s * c for s, c in counts.items()) // 1024)
        assert sum(t for _, t in plan) <= max(least + 3, least * 1.02)


def test_dominance_is_safe():
    def best(items, room):
        items, least = sorted(items, reverse=True), [len(items)]

        def go(i, bins):
            if len(bins) >= least[0]:
                return
            if i == len(items):
                least[0] = len(bins)
                return
            for k in {b: j for j, b in enumerate(bins)}.values():
                if bins[k] + items[i] <= room:
                    go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1:])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return least[0]

    rng = random.Random(8)
    for _ in range(300):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.reduce_dominated(Counter(items), 20)
        assert sum(t for _, t in fixed) + best(list(rest.elements()), 20) == best(items, 20), items


def test_dominant_pairs_are_fixed_at_once():
    fixed, rest = packing.reduce_dominated(Counter({700: 30_000, 300: 30_001, 990: 5}), 1024)
    assert sum(n for p, n in fixed if p == (700, 300)) == 30_000 and len(fixed) < 10
    assert Counter(x for p, n in fixed for x in p * n) + rest == Counter({700: 30_000, 300: 30_001, 990: 5})


def test_word_hashes_of_long_texts():
    text = "Some wOrds\tand more\n" * 40_000
    assert len(text) > BLOCK
    h = word_hashes(text)
    assert len(h) == 160_000 and len(np.unique(h)) == 4 and (h[:4] == word_hashes("some words and more")).all()
    giant = "x" * (3 * BLOCK)
    assert len(word_hashes(giant + " y")) == 2 and word_hashes(giant)[0] == word_hashes(giant + " y")[0]
    assert not len(word_hashes(None)) and not len(window_hashes(word_hashes(" \n"), 4))
    assert len(window_hashes(word_hashes("a b"), 4)) == 1


def test_sketches_merge_and_estimate():
    a, b = (" ".join(f"w{i}" for i in r) for r in (range(3000), range(1500, 2000)))
    x, y = sketch.sketch(a), sketch.sketch(b)
    assert abs(sketch.containment(y, x) - 1) < 0.05 and sketch.containment(x, y) < 0.25
    assert sketch.merge(x, y).tolist() == np.union1d(x, y).tolist()
    assert sketch.parse(sketch.fingerprint(x)).tolist() == x.tolist() and sketch.fingerprint(sketch.sketch(None)) == ""
    assert sketch.resemblance(sketch.sketch(""), sketch.sketch(" \n")) == 1 and sketch.resemblance(sketch.sketch("a"), sketch.sketch("")) == 0
    assert len(sketch.sketch("one")) == 1 and abs(len(x) / 2996 - 1 / sketch.FRACTION) < 0.05


def test_kt_probability():
    for a, b in ((0, 0), (3, 1), (300, 5000), (0, 255), (256, 256)):
        want = math.lgamma(a + .5) + math.lgamma(b + .5) - 2 * math.lgamma(.5) - math.lgamma(a + b + 1)
        assert abs(ctw.log_kt(np.array([a * 1.0]), np.array([b * 1.0]))[0] - want) < 1e-9 * max(1, abs(want))


def test_many_lines_that_share_a_segment_are_told_apart_quickly():
    rng = random.Random(9)
    lines = {k: "https://example.org/page" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(16)) for k in range(6000)}
    lines |= {10_000 + k: lines[k][:30] + "#" + lines[k][31:] for k in range(0, 6000, 100)}
    began = time.process_time()
    links = line_dedup.linked_lines(lines)
    assert sorted(tuple(sorted(x)) for x in links) == [(k, 10_000 + k) for k in range(0, 6000, 100)]
    assert time.process_time() - began < 30
