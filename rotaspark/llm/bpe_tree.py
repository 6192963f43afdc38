"""BPE merges by a segment tree over adjacent pair ranks, for many pieces at a time.

Each piece has a tree whose leaf i holds rank * width + i of the pair that starts at symbol i. The root is the
leftmost pair of lowest rank. A merge changes three leaves, each in log2(width) steps; a piece is done when its root
holds no pair. Pieces of equal tree width form the rows of one array, so one array operation is one step of all.
Few pieces of a width are worked on one by one instead, in flat arrays of numbers, where a step costs less than a call.
"""

from __future__ import annotations

import json
from array import array

import numpy as np

from rotaspark.llm.pretokens import PieceEncoder

_NONE = np.int64(1) << np.int64(62)
_CELLS = 1 << 21
#: Fewer rows than this are merged one by one.
_FEW = 12


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE files (fixed rule of that format)."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class TreeBpe:
    """Merge table and byte values of a byte-level BPE file (`tokenizer.json`)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        chars = byte_characters()
        value = {c: b for b, c in enumerate(chars)}
        self.byte_ids = np.array([vocab[c] for c in chars], np.int64)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self._known: dict[int, tuple[int, int]] = {}
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs; rank _NONE where no merge is known or a side is missing (-1)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], _NONE), self.results[at]

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.array([len(b) for b in raw])
        width = 1 << np.maximum(0, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            step = max(1, _CELLS // int(w))
            for at in range(0, rows.size, step):
                chosen = rows[at : at + step]
                if chosen.size < _FEW:
                    for i in chosen.tolist():
                        out[i] = self._merge_one(raw[i], int(w))
                    continue
                for i, ids in zip(chosen, self._merge([raw[j] for j in chosen], int(w))):
                    out[i] = ids
        for i, p in enumerate(pieces):
            if p in self.special:
                out[i] = (self.special[p],)
        return out

    def _merge(self, raw: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = len(raw)
        length = np.array([len(b) for b in raw])
        sym = np.full((n, width), -1, np.int64)
        inside = np.arange(width) < length[:, None]
        sym[inside] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        place = np.arange(width, dtype=np.int64)
        after = np.where(place + 1 < length[:, None], place + 1, -1)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, np.int64)
        if width > 1:
            rank, _ = self._pairs(sym[:, :-1], sym[:, 1:])
            tree[:, width : 2 * width - 1] = np.where(rank < _NONE, rank * width + place[:-1], _NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        rows = np.flatnonzero(tree[:, 1] < _NONE) if width > 1 else np.empty(0, np.int64)
        while rows.size:
            i = tree[rows, 1] % width
            j = after[rows, i]
            _, made = self._pairs(sym[rows, i], sym[rows, j])
            k = after[rows, j]
            sym[rows, i], sym[rows, j], after[rows, i] = made, -1, k
            more = k >= 0
            before[rows[more], k[more]] = i[more]
            self._point(tree, rows, j, np.full(rows.size, _NONE), width)
            rank, _ = self._pairs(made, np.where(more, sym[rows, np.maximum(k, 0)], -1))
            self._point(tree, rows, i, np.where(rank < _NONE, rank * width + i, _NONE), width)
            h = before[rows, i]
            some = h >= 0
            if some.any():
                r, h = rows[some], h[some]
                rank, _ = self._pairs(sym[r, h], made[some])
                self._point(tree, r, h, np.where(rank < _NONE, rank * width + h, _NONE), width)
            rows = rows[tree[rows, 1] < _NONE]
        left = sym >= 0
        flat = sym[left].tolist()
        ends = np.cumsum(left.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends)]

    def _merge_one(self, raw: bytes, width: int) -> tuple[int, ...]:
        """The same tree for one piece: a point update ends where a node keeps its value."""
        n, none, size = len(raw), int(_NONE), self.size
        start = self.byte_ids[np.frombuffer(raw, np.uint8)]
        if n < 2:
            return tuple(start.tolist())
        if not self._known:
            self._known = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.results.tolist())))
        known = self._known
        leaves = np.full(2 * width, _NONE, np.int64)
        rank, _ = self._pairs(start[:-1], start[1:])
        leaves[width : width + n - 1] = np.where(rank < _NONE, rank * width + np.arange(n - 1), _NONE)
        level = width
        while level > 1:
            leaves[level // 2 : level] = np.minimum(leaves[level : 2 * level : 2], leaves[level + 1 : 2 * level : 2])
            level //= 2
        tree, sym = array("q", leaves.tobytes()), array("q", start.tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        del leaves, start, rank

        def point(at: int, value: int) -> None:
            at += width
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    return
                tree[at] = value

        while (least := tree[1]) < none:
            i = least % width
            j = after[i]
            made = known[sym[i] * size + sym[j]][1]
            k = after[j]
            sym[i], sym[j], after[i] = made, -1, k
            point(j, none)
            value = none
            if k < n:
                before[k] = i
                if (pair := known.get(made * size + sym[k])) is not None:
                    value = pair[0] * width + i
            point(i, value)
            h = before[i]
            if h >= 0:
                pair = known.get(sym[h] * size + made)
                point(h, none if pair is None else pair[0] * width + h)
        return tuple(x for x in sym if x >= 0)

    @staticmethod
    def _point(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        at = leaf + width
        tree[rows, at] = value
        while width > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            width >>= 1

    def encoder(self, split, as_code=None, memo_pieces: int = 500_000) -> PieceEncoder:
        """A batch encoder with this table; as_code turns the ids of a piece into what `encode` returns for it."""
        codes = self.encode_pieces if as_code is None else lambda p: [as_code(x) for x in self.encode_pieces(p)]
        return PieceEncoder(split, codes, self.special, memo_pieces)
