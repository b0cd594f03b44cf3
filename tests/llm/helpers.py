"""Small inputs and plain Python versions the operators are held against."""

from collections import defaultdict

import numpy as np

import duckdb

from tests.conftest import SF_SMALL

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
#: doc_id, text, lang, source, n_chars and columns whose names operators use themselves.
ODD = [
    (1, None, "en", "s1", 0), (2, "", "en", "s1", 0), (3, " \n\t\r \x0b", "en", None, 5), (4, "Word", None, "s2", 4),
    (4, "Word", None, "s2", 4), (5, LONG, "en", "s1", len(LONG)), (6, LONG, "en", "s2", len(LONG)),
    (7, "wOrd\nsame line of text that is long enough here\n\nsame line of text that is long enough here", "fr", "s1", 1),
    (8, "same line of text that is long enough herE\nñandú €uro 日本語 😀 x\x00y", "es", "s1", 1),
    (None, "no id but a text of some words\n", "en", "s1", 1), (None, None, None, None, None),
    (-9, "a  b   c\t\td\r\n e ▁f <s> <|endoftext|> don't, stop.,;", "en", "s1", 1), (10, LONG + " tail", "en", "s1", 1),
]
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, sid string, node int, "
          "shard string, llm_doc string, key string, r string")


def odd_docs(spark, rows=None):
    rows = ODD if rows is None else rows
    return spark.createDataFrame([(*r, *("clash",) * 2, 7, *("clash",) * 4) for r in rows], SCHEMA)


def documents():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF_SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def removed_lines(docs, allowed, found=lambda a, b: True):
    """Numbers of the lines of each ``(id, text)`` that repeat an earlier one, by comparing all pairs of lines;
    ``found``: whether a pair of near copies, the shorter first, is one that the method promises."""
    at = [(i, k, s) for i, t in sorted(docs, key=lambda d: d[0]) for k, x in enumerate((t or "").split("\n"))
          if (s := x.strip(" \t\n\v\f\r"))]
    texts = sorted({s for _, _, s in at})
    groups = Groups(texts)
    counts = np.zeros((len(texts), 256), dtype=np.int32)  # characters by their last bits: a bound on the distance
    for row, x in zip(counts, texts):
        np.add.at(row, np.frombuffer(x.encode("utf-32-le"), "<u4") % counts.shape[1], 1)
    for i, a in enumerate(texts):
        far = np.abs(counts[:i] - counts[i]).sum(axis=1).tolist()
        for b, f in zip(texts, far):
            k = allowed(min(len(a), len(b)))
            if k and f <= 2 * k and groups.find(a) != groups.find(b) and found(*sorted((a, b), key=len)):
                if edit_distance(a, b) <= k:
                    groups.join(a, b)
    seen, out = set(), defaultdict(list)
    for i, k, s in at:
        out[i] += [k] if groups.find(s) in seen else []
        seen.add(groups.find(s))
    return out


def shingles(text, size=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def set_components(docs, percent=85):
    """Smallest id reachable of each ``(id, text)``, by comparing all pairs of sets."""
    sets = {i: shingles(t) for i, t in docs}
    groups, ids = Groups(sets), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                groups.join(a, b)
    return {i: groups.find(i) for i in ids}
