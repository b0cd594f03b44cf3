"""Prefix tree of ordered sets and the similarity search over it, for one task's block of sets."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

#: Below so many children a node's edges are looked at one by one, else all at once.
FEW = 8


class PrefixTree:
    """Path-compressed trie over ascending integer arrays, with what is left below each node.

    ``sizes`` are the sets' full sizes (their arrays may lack elements that no
    other set has). Sets can be removed; empty subtrees are not entered.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sizes = sizes
        self.segments: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        self.depth, self.parent, self.children, self.members = [0], [-1], [[]], [[]]
        self.home = [0] * len(sets)
        stack, last = [0], np.zeros(0, dtype=np.int64)
        for i in sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()):
            s = sets[i]
            n = min(len(s), len(last))
            differ = np.flatnonzero(s[:n] != last[:n])
            common = int(differ[0]) if len(differ) else n
            top = -1
            while self.depth[stack[-1]] > common:
                top = stack.pop()
            if self.depth[stack[-1]] < common:  # the shared part ends inside an edge: cut it there
                up, cut = stack[-1], common - self.depth[stack[-1]]
                mid = self._node(up, self.segments[top][:cut], common)
                self.children[up].remove(top)
                self.children[mid].append(top)
                self.parent[top], self.segments[top] = mid, self.segments[top][cut:]
                stack.append(mid)
            if len(s) > common:
                stack.append(self._node(stack[-1], s[common:], len(s)))
            self.members[stack[-1]].append(i)
            self.home[i] = stack[-1]
            last = s
        k = len(self.depth)
        self.alive, self.longest = np.zeros(k, dtype=np.int64), np.array(self.depth)
        self.least = np.full(k, 1 << 60)
        for v in sorted(range(k), key=self.depth.__getitem__, reverse=True):
            self.alive[v] += len(self.members[v])
            self.least[v] = min([int(self.least[v]), *(sizes[i] for i in self.members[v])])
            if (p := self.parent[v]) >= 0:
                self.alive[p] += self.alive[v]
                self.longest[p] = max(self.longest[p], self.longest[v])
                self.least[p] = min(self.least[p], self.least[v])
        self.packed: dict[int, tuple] = {}
        # plain lists for nodes with few children
        self.room = (self.longest - np.array(self.depth)).tolist()
        self.smallest = self.least.tolist()
        self.final = [int(e[-1]) if len(e) else -1 for e in self.segments]

    def _node(self, parent: int, segment: np.ndarray, depth: int) -> int:
        for column, value in ((self.segments, segment), (self.depth, depth), (self.parent, parent), (self.children, []),
                              (self.members, [])):
            column.append(value)
        self.children[parent].append(len(self.depth) - 1)
        return len(self.depth) - 1

    def remove(self, i: int) -> None:
        v = self.home[i]
        self.members[v].remove(i)
        while v >= 0:
            self.alive[v] -= 1
            v = self.parent[v]

    def _below(self, v: int) -> tuple:
        """Children with something left, their edges in one array, where each begins, its last element, what is
        longest below its end and the smallest set below. Made anew when half of the children are empty."""
        have = self.packed.get(v)
        if have is not None and 2 * np.count_nonzero(self.alive[have[0]]) >= len(have[0]):
            return have
        kids = np.array([c for c in self.children[v] if self.alive[c]], dtype=np.int64)
        edges = [self.segments[c] for c in kids]
        flat = np.concatenate(edges) if edges else np.zeros(0, dtype=np.int64)
        ends = np.cumsum([len(e) for e in edges], dtype=np.int64)
        depth = np.array([self.depth[c] for c in kids], dtype=np.int64)
        self.packed[v] = have = (kids, flat, np.concatenate([[0], ends[:-1]]), flat[ends - 1] if edges else flat,
                                 self.longest[kids] - depth, self.least[kids])
        return have

    def similar(self, query: np.ndarray, size: int, in_query: np.ndarray, percent: int) -> list[int]:
        """Sets left in the tree whose Jaccard similarity to the query is ``percent`` or more.

        ``in_query`` tells of every element whether the query has it. Overlap
        is carried down the tree, so shared prefixes are counted once, and the
        edges below a node are counted together; a subtree is left when the
        elements that can still match are too few for its smallest set.
        """
        found, stack, order = [], [(0, 0)], query.tolist()
        while stack:
            v, overlap = stack.pop()
            for i in self.members[v]:
                if 100 * overlap >= percent * (size + self.sizes[i] - overlap):
                    found.append(i)
            if len(self.children[v]) < FEW:
                for c in self.children[v]:
                    if self.alive[c]:
                        edge = self.segments[c]
                        got = overlap + int(np.count_nonzero(in_query[edge]))
                        left = min(self.room[c], len(query) - bisect_right(order, self.final[c]))
                        if (100 + percent) * (got + left) >= percent * (size + self.smallest[c]):
                            stack.append((c, got))
                continue
            kids, flat, starts, last, longest, least = self._below(v)
            if not len(kids):
                continue
            got = overlap + np.add.reduceat(in_query[flat], starts, dtype=np.int64)
            left = np.minimum(longest, len(query) - np.searchsorted(query, last, side="right"))
            # overlap o suffices when (100 + percent) o >= percent (size + other)
            go = ((100 + percent) * (got + left) >= percent * (size + least)) & (self.alive[kids] > 0)
            stack.extend(zip(kids[go].tolist(), got[go].tolist()))
        return found


def linked(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join every pair of sets of ``percent`` similarity or more into one component.

    Elements are ranked by how many of these sets hold them, fewest first;
    elements of one set alone only count towards its size. From each set not yet reached, the search spreads
    over all sets similar to one reached, each of which leaves the tree.
    """
    sizes = [len(s) for s in sets]
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.lexsort((values, counts))] = np.arange(len(values))
    ranks, common = rank[inverse], counts[inverse] > 1
    ends = np.cumsum(sizes)
    short = [np.sort(ranks[e - n:e][common[e - n:e]]) for e, n in zip(ends, sizes)]
    able = [i for i in range(len(sets)) if 100 * len(short[i]) >= percent * sizes[i]]
    tree = PrefixTree([short[i] for i in able], [sizes[i] for i in able])
    mask, links, reached = np.zeros(len(values), dtype=bool), [], [False] * len(able)
    for seed in range(len(able)):
        if reached[seed]:
            continue
        tree.remove(seed)
        reached[seed], queue = True, [seed]
        while queue:
            i = queue.pop()
            query = short[able[i]]
            mask[query] = True
            for j in tree.similar(query, sizes[able[i]], mask, percent):
                tree.remove(j)
                reached[j] = True
                queue.append(j)
                links.append((int(ids[able[i]]), int(ids[able[j]])))
            mask[query] = False
    return links
