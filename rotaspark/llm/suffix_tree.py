"""Suffix trees of sequences of small integers, and longest common extensions in constant time.

A tree is built by Ukkonen's algorithm, in time linear in the sequence. Its Euler tour, of which only the visits of
leaves and the shallowest node between two of them are kept, turns the lowest common ancestor of two leaves into a
range minimum; a sparse table answers many of them at once.
"""

from __future__ import annotations

import numpy as np


class SuffixTree:
    """The suffix tree of symbols (positive integers) and an end mark, which is the symbol 0."""

    def __init__(self, symbols: list[int]) -> None:
        self.size = len(symbols)
        self._width = max(symbols, default=0) + 1
        self._build([*symbols, 0])
        children: dict[int, list[int]] = {}
        for key in sorted(self._edges):
            children.setdefault(key // self._width, []).append(self._edges[key])
        self._children = children
        del self._edges

    def _build(self, s: list[int]) -> None:
        n, width = len(s), self._width
        start, stop, link, leaf, edges = [0], [0], [0], [-1], {}
        node = at = length = rest = suffix = 0
        for i, symbol in enumerate(s):
            rest += 1
            last = 0
            while rest:
                if not length:
                    at = i
                key = node * width + s[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    first = start[child]
                    size = stop[child] - first
                    if length >= size:
                        at += size
                        length -= size
                        node = child
                        continue
                    if s[first + length] == symbol:
                        if last:
                            link[last] = node
                        length += 1
                        break
                    split = len(start)
                    edges[key] = split
                    start.append(first)
                    stop.append(first + length)
                    link.append(0)
                    leaf.append(-1)
                    start[child] = first + length
                    edges[split * width + s[first + length]] = child
                    edges[split * width + symbol] = split + 1
                    if last:
                        link[last] = split
                    last = split
                start.append(i)
                stop.append(n)
                link.append(0)
                leaf.append(suffix)
                suffix += 1
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - rest + 1
        self._start, self._stop, self._leaf, self._edges = start, stop, leaf, edges

    def tour(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in the order of leaves, depth of the shallowest node since the leaf before).

        Children go by ascending or descending symbol; a suffix comes before those that it is a prefix of either way.
        """
        start, stop, leaf, children = self._start, self._stop, self._leaf, self._children
        n = self.size + 1
        order, least = [], []
        stack = [(0, 0, 0)]
        while stack:
            node, depth, between = stack.pop()
            if leaf[node] >= 0:
                order.append(leaf[node])
                least.append(between)
                continue
            kids = children[node]
            if descending:
                kids = kids[::-1]
                if stop[kids[-1]] == n and start[kids[-1]] == n - 1:
                    kids = [kids[-1], *kids[:-1]]
            for child in kids[:0:-1]:
                stack.append((child, depth + stop[child] - start[child], depth))
            child = kids[0]
            stack.append((child, depth + stop[child] - start[child], between))
        return np.array(order, np.int64), np.array(least, np.int32)


class Extensions:
    """Longest common extensions of pairs of suffixes, from a tour's leaves and the depths between them."""

    def __init__(self, order: np.ndarray, least: np.ndarray) -> None:
        self.rank = np.empty(order.size, np.int64)
        self.rank[order] = np.arange(order.size)
        self._tables = [least]
        while 2 << (len(self._tables) - 1) <= least.size:
            below, reach = self._tables[-1], 1 << (len(self._tables) - 1)
            self._tables.append(np.minimum(below[:-reach], below[reach:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of suffixes i and j; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(low.size, np.int64)
        for k in np.unique(level):
            mine = level == k
            table = self._tables[k]
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << int(k))])
        return out
