"""Byte-level BPE over batches of texts: pieces are found by array operations, each distinct piece is encoded once.

`PieceEncoder` follows the fixed split pattern of byte-level BPE files (contractions; letters, digits or other
characters with one space in front; white space). Character classes are not taken from a table of Python's own
Unicode version: each code point seen is classified by the tokenizer's own pre-tokenizer, once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np

#: Code points encoded at once.
GROUP_POINTS = 1 << 20
_SAFE = re.compile("[A-Za-z](?= [A-Za-z])|\\S\n(?=\\S)")
LETTER, DIGIT, BLANK, OTHER, NEW = 0, 1, 2, 3, 255
_STEP = 0xD1342543DE82EF95
_UNSTEP = pow(_STEP, -1, 1 << 64)
_SALT = np.uint64(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.size < n:
            n = max(n, 1 << 16)
            self.up, self.down = (self._series(x, n) for x in (_STEP, _UNSTEP))
        return self.up, self.down

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


POWERS = _Powers()


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of points[start:end] for every span, from one running sum."""
    up, down = POWERS.reach(points.size + 1)
    value = (points.astype(np.uint64) + np.uint64(1)) * _SALT
    value ^= value >> np.uint64(31)
    value *= up[: points.size]
    total = np.zeros(points.size + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    out = (total[ends] - total[starts]) * down[starts]
    out += (ends - starts).astype(np.uint64) * _SALT
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all spans, one span after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in order of the keys, and the number of its key for every place.

    `np.unique` would give the first place and sort stably for it, which costs twice as much.
    """
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(keys.size, bool)
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    number = np.empty(keys.size, np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


class Group:
    """The codes of the distinct pieces of some texts; `tables` is free for what a reader derives from them."""

    def __init__(self, codes: list) -> None:
        self.codes, self.tables = codes, None


class PieceEncoder:
    """Encodes texts; `encode_pieces` gives the ids of each of a list of distinct pieces.

    memo_pieces bounds the memory: a fuller memo is emptied, which costs time only.
    """

    def __init__(
        self,
        split: Callable[[str], Sequence],
        encode_pieces: Callable[[list[str]], list],
        special: dict[str, int],
        memo_pieces: int = 500_000,
    ) -> None:
        self.split, self.encode_pieces, self.special, self.memo_pieces = split, encode_pieces, special, memo_pieces
        self.classes = np.full(0x110000, NEW, np.uint8)
        self.memo: dict[str, object] = {}

    def _classify(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if (found == NEW).any():
            for c in np.unique(points[found == NEW]):
                x = chr(c)
                kinds = [k for k, mate in ((LETTER, "x"), (DIGIT, "7"), (OTHER, "!")) if len(self.split(mate + x)) == 1]
                self.classes[c] = kinds[0] if kinds else BLANK
            found = self.classes[points]
        return found

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """True where a piece starts. first: where the texts start (never empty texts)."""
        n = points.size
        kind = self._classify(points)
        fresh = np.zeros(n + 1, bool)
        fresh[first] = fresh[n] = True
        cut = fresh.copy()
        cut[1:n] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(cut)
        head, tail = run[:-1], run[1:]
        solid = kind[head] != BLANK
        inner = ~fresh[head]
        start = cut.copy()
        glued = solid & inner & (points[np.maximum(head - 1, 0)] == 32)
        start[head[glued]] = False
        start[head[glued] - 1] = True
        followed = ~solid & ~fresh[tail]
        start[tail[followed] - 1] = True
        self._contractions(points, kind, head, tail, glued, fresh, start)
        return start[:n]

    @staticmethod
    def _contractions(points, kind, head, tail, glued, fresh, start) -> None:
        lone = np.flatnonzero((points[head] == 39) & (tail - head == 1) & ~glued & ~fresh[tail])
        lone = lone[kind[head[np.minimum(lone + 1, head.size - 1)]] == LETTER] if lone.size else lone
        for i in lone:
            at, end = int(tail[i]), int(tail[i + 1])
            a = chr(points[at])
            b = a + (chr(points[at + 1]) if end - at > 1 else "")
            size = 1 if a in "stmd" else 2 if b in ("re", "ve", "ll") else 0
            if size:
                start[at] = False
                start[at + size] = True

    def parts(self, texts: Sequence[str | None]) -> Iterator[tuple[int, Group, np.ndarray]]:
        """(text number, group, piece numbers within the group) for each part of each text, in order.

        A group is what was encoded at once: about GROUP_POINTS code points, whatever the batch holds. Long texts are
        cut into parts where a piece starts for certain: at a space between two ASCII letters, or behind a single line
        feed. Without such a place a text is one part, so memory follows the longest stretch without one. A special
        token is a part of its own. Empty texts have no part.
        """
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in self._cut(text or ""):
                held.append((i, part))
                size += len(part)
                if size >= GROUP_POINTS:
                    yield from self._group(held)
                    held, size = [], 0
        if held:
            yield from self._group(held)

    def encode(self, text: str | None) -> list:
        """The codes of one text, in order."""
        return [group.codes[x] for _, group, number in self.parts([text]) for x in number.tolist()]

    def _group(self, held: list[tuple[int, str]]) -> Iterator[tuple[int, Group, np.ndarray]]:
        codes, number, cuts = self._grouped(held)
        group = Group(codes)
        for k, (i, _) in enumerate(held):
            yield i, group, number[cuts[k] : cuts[k + 1]]

    def _grouped(self, held: list[tuple[int, str]]) -> tuple:
        """The codes of the distinct pieces, the number of its code for every piece, and where each part's pieces start."""
        whole = "".join(p for _, p in held)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) for _, p in held])
        first = np.concatenate(([0], ends[:-1]))
        start = self.starts(points, first)
        for (_, p), a, b in zip(held, first, ends):
            if p in self.special:
                start[a + 1 : b] = False
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], points.size)
        hashes = span_hashes(points, begin, end)
        where, number = distinct(hashes)
        length = end - begin
        model = spread(begin[where][number], length)
        keys = hashes[where]
        if (length != length[where][number]).any() or (points != points[model]).any():  # two pieces share a hash
            seen: dict[str, int] = {}
            number = np.array([seen.setdefault(whole[a:b], len(seen)) for a, b in zip(begin.tolist(), end.tolist())], np.int64)
            where, keys = np.unique(number, return_index=True)[1], None
        codes = self._coded(whole, points, begin[where], end[where], keys)
        return codes, number, np.append(np.searchsorted(begin, first), begin.size).tolist()

    def _coded(self, whole: str, points: np.ndarray, begin: np.ndarray, end: np.ndarray, keys: np.ndarray | None):
        """The codes of distinct pieces. keys: their hashes in ascending order, None if two pieces share one."""
        return self._codes([whole[a:b] for a, b in zip(begin.tolist(), end.tolist())])

    def _cut(self, text: str) -> Iterator[str]:
        parts = [text]
        for s in self.special:
            if s in text:
                parts = [y for p in parts for y in ([p] if p in self.special else _around(p, s))]
        for part in parts:
            at = 0
            while len(part) - at > GROUP_POINTS and (gap := _SAFE.search(part, at + GROUP_POINTS // 2)):
                yield part[at : gap.end()]
                at = gap.end()
            if at < len(part):
                yield part[at:] if at else part

    def _codes(self, pieces: list[str]) -> list:
        memo = self.memo
        if len(memo) > self.memo_pieces:
            memo.clear()
        new = [p for p in pieces if p not in memo]
        if new:
            memo.update(zip(new, self.encode_pieces(new)))
        return [memo[p] for p in pieces]


class _Grown:
    """An array that grows at its end. Views taken before stay valid."""

    def __init__(self, kind: type) -> None:
        self.room, self.n = np.empty(1 << 10, kind), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + values.size
        if n > self.room.size:
            room = np.empty(max(n, 2 * self.room.size), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : n] = values
        self.n = n


class _Known:
    """Ids of pieces by the pieces' hashes, in flat arrays; code points tell pieces of the same hash apart."""

    def __init__(self) -> None:
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.points, self.ids = _Grown(np.uint32), _Grown(np.uint32)
        self.begin, self.length, self.first, self.size = (_Grown(np.int64) for _ in range(4))

    def find(self, points: np.ndarray, begin: np.ndarray, length: np.ndarray, keys: np.ndarray):
        """The place of each piece, -1 if it is new, and where its key belongs; None if another piece has its hash."""
        at = np.searchsorted(self.keys, keys)
        place = np.full(keys.size, -1)
        hit = np.flatnonzero(at < self.keys.size)
        hit = hit[self.keys[at[hit]] == keys[hit]]
        place[hit] = old = self.place[at[hit]]
        if (self.length.room[old] != length[hit]).any():
            return None
        same = self.points.room[spread(self.begin.room[old], length[hit])] == points[spread(begin[hit], length[hit])]
        return (place, at) if same.all() else None

    def add(self, points: np.ndarray, length: np.ndarray, keys: np.ndarray, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        """Adds new pieces, points and ids one piece after another, and gives their places."""
        place = self.begin.n + np.arange(keys.size)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, place)
        self.begin.add(self.points.n + np.cumsum(length) - length)
        self.first.add(self.ids.n + np.cumsum(sizes) - sizes)
        self.length.add(length)
        self.size.add(sizes)
        self.points.add(points)
        self.ids.add(ids)
        return place


class IdEncoder(PieceEncoder):
    """Encodes texts into uint32 ids with a byte-level BPE tokenizer of the tokenizers library.

    Pieces of one space and what follows it are encoded many at once, as one text: it splits at the spaces again, and
    no other byte of such a piece is a space, so a piece's ids start where an id's bytes do with one. memo_pieces bounds
    the memory as before, and so do 32 code points for each of them.
    """

    #: Pieces in one text given to the library.
    JOINED = 128

    def __init__(self, tokenizer, memo_pieces: int = 500_000) -> None:
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        super().__init__(tokenizer.pre_tokenizer.pre_tokenize_str, self._library, special, memo_pieces)
        self.tokenizer, self.known = tokenizer, _Known()
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.spaced = np.zeros(max([*vocabulary.values(), *special.values()], default=0) + 1, bool)
        if not any(" " in s for s in special):
            self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def parts(self, texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(text number, ids) for each part of each text, in order; empty texts have no part."""
        return super().parts(texts)

    def encode(self, text: str | None) -> list[int]:
        return [x for _, ids in self.parts([text]) for x in ids.tolist()]

    def _group(self, held: list[tuple[int, str]]) -> Iterator[tuple[int, np.ndarray]]:
        (ids, first, sizes), number, cuts = self._grouped(held)
        sizes = sizes[number]
        ids = ids[spread(first[number], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[cuts].tolist()
        for (i, _), a, b in zip(held, ends, ends[1:]):
            yield i, ids[a:b]

    def _coded(self, whole, points, begin, end, keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where the ids of each piece start and how many they are."""
        if self.known.keys.size > self.memo_pieces or self.known.points.n > 32 * self.memo_pieces:
            self.known = _Known()
        known, length = self.known, end - begin
        found = None if keys is None else known.find(points, begin, length, keys)
        if found is None:
            ids, sizes = self._ids(points[spread(begin, length)], length)
            return ids, np.cumsum(sizes) - sizes, sizes
        place, at = found
        new = np.flatnonzero(place < 0)
        if new.size:
            mine = points[spread(begin[new], length[new])]
            place[new] = known.add(mine, length[new], keys[new], at[new], *self._ids(mine, length[new]))
        return known.ids.room, known.first.room[place], known.size.room[place]

    def _ids(self, points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one piece after another, and how many each has."""
        begin = np.cumsum(length) - length
        second = points[np.minimum(begin + 1, points.size - 1)]
        joined = (points[begin] == 32) & (length > 1) & (self._classify(second) != BLANK)
        ids, sizes = self._joined(points, begin[joined], length[joined])
        if ids is None:
            joined[:] = False
            ids, sizes = np.empty(0, np.uint32), np.empty(0, np.int64)
        alone = np.flatnonzero(~joined)
        text = _text(points)
        codes = self._library([text[a : a + n] for a, n in zip(begin[alone].tolist(), length[alone].tolist())])
        all_sizes = np.empty(length.size, np.int64)
        all_sizes[joined] = sizes
        all_sizes[alone] = [c.size for c in codes]
        first = np.cumsum(all_sizes) - all_sizes
        out = np.empty(int(all_sizes.sum()), np.uint32)
        out[spread(first[joined], sizes)] = ids
        out[spread(first[alone], all_sizes[alone])] = np.concatenate([*codes, np.empty(0, np.uint32)])
        return out, all_sizes

    def _joined(self, points: np.ndarray, begin: np.ndarray, length: np.ndarray):
        """The ids of pieces that start with their only space; None, None if the ids do not show the spaces."""
        texts = [
            _text(points[spread(begin[a : a + self.JOINED], length[a : a + self.JOINED])]) for a in range(0, begin.size, self.JOINED)
        ]
        ids = np.concatenate([*self._library(texts), np.empty(0, np.uint32)])
        first = np.flatnonzero(self.spaced[ids])
        if first.size != begin.size or (first.size and first[0]):
            return None, None
        return ids, np.diff(np.append(first, ids.size))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _text(points: np.ndarray) -> str:
    return points.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")


def _around(text: str, mark: str) -> list[str]:
    out: list[str] = []
    for i, part in enumerate(text.split(mark)):
        out += [mark] * (i > 0) + [part]
    return out
