"""Texts split into a vocabulary's pieces, and the pieces' values looked up, for many texts at a time in numpy.

Pieces of letters of ASCII and of U+00C0 to U+00FF, of digits and of other ASCII signs are told apart by classes of
bytes. Words with any other letters, with an apostrophe that can begin a contraction, or longer than LONGEST bytes
are hard: they go to a function one by one. A worker holds the values of pieces it has seen in arrays of a fixed
size; which of them are held changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np

from isotherm.llm.bpe import BatchDP

SPACE, LETTER, DIGIT, OTHER, HARD, BORDER = range(6)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 255)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[255] = BORDER  # stands between texts; UTF-8 never has it
#: First bytes of characters beyond U+00FF, and of U+0080 to U+00BF.
_FAR = np.zeros(256, bool)
_FAR[[0xC2, *range(0xC4, 0xFF)]] = True
_LATIN, _SIGNS = 0xC3, (0x97, 0xB7)  # the first byte of U+00C0 to U+00FF, and the second ones of its two signs
_CONTRACTED = np.zeros(256, bool)
_CONTRACTED[list(b"stdmrvl")] = True
_UPPER = bytes(range(65, 91))
_LOWER = np.frombuffer(bytes.maketrans(_UPPER, _UPPER.lower()), np.uint8)
#: Bytes of a window of texts that is worked on at once.
WINDOW = 1 << 19
LONGEST = BatchDP.LONGEST - 1

_VALUE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def spans(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of many[0] places, then those of begin[1], and so on."""
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


def segments(data: bytes) -> list[bytes]:
    """A long text cut before runs of white space, where no piece is cut."""
    if len(data) <= 2 * WINDOW:
        return [data]
    cells = np.frombuffer(data, np.uint8)
    space = _CLASS[cells] == SPACE
    cuts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    out, begin = [], 0
    while begin < len(data):
        k = np.searchsorted(cuts, begin + WINDOW)
        end = int(cuts[k]) if k < len(cuts) else len(data)
        out.append(data[begin:end])
        begin = end
    return out


class Cache:
    """Values by 64-bit hashes of pieces: two places for each hash, and one array that is begun anew when it is full."""

    PLACES, ARENA = 20, 1 << 22  # 2^20 pairs of places; numbers held

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(2 << self.PLACES, np.uint64)
        self.begin, self.many = np.zeros(2 << self.PLACES, np.int32), np.zeros(2 << self.PLACES, np.int32)
        self.arena, self.used = np.empty(self.ARENA, np.uint32), 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and whether they hold these hashes."""
        at = (h >> np.uint64(64 - self.PLACES)).astype(np.int64) * 2
        at += self.hash[at] != h
        return at, self.hash[at] == h

    def room(self, n: int) -> bool:
        """Whether n more numbers fit in; if not, all is forgotten."""
        if self.used + n <= len(self.arena):
            return True
        self.clear()
        if n > len(self.arena):
            self.arena = np.empty(n, np.uint32)
        return False

    def put(self, h: np.ndarray, values: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Where the values of each hash begin. A full pair of places loses one of its two."""
        begin = self.used + np.cumsum(many) - many
        self.arena[self.used : self.used + len(values)] = values
        self.used += len(values)
        at = (h >> np.uint64(64 - self.PLACES)).astype(np.int64) * 2
        at += (self.hash[at] != 0) & ((self.hash[at + 1] == 0) | (h & np.uint64(2) > 0))
        self.hash[at], self.begin[at], self.many[at] = h, begin, many
        return begin


class Window:
    """The pieces of some texts: text, begin and end (in bytes of that text), and their values."""

    def __init__(self, text, begin, end, first, many, arena):
        self.text, self.begin, self.end, self.first, self.many, self.arena = text, begin, end, first, many, arena

    def flat(self) -> np.ndarray:
        return self.arena[spans(self.first, self.many)]


class PieceCoder:
    """Values of all pieces of texts. words: pieces are in lower case, between white space, digits are alone; else as in byte-level patterns.

    batch gives the values of pieces of up to LONGEST bytes, hard those of a hard word (with the blank before it,
    if not words). counts: a piece's values are its token counts at each of its byte prefixes, else its ids.
    """

    def __init__(self, batch: BatchDP, hard: Callable[[bytes], np.ndarray], words: bool = False, counts: bool = False):
        self.batch, self.hard, self.words, self.counts, self.cache = batch, hard, words, counts, Cache()
        self.up, self.back = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def windows(self, texts: list[bytes]) -> Iterator[Window]:
        """Pieces in the order of texts; one text's can be in several windows."""
        part, names, shifts, size = [], [], [], 0
        for k, t in enumerate(texts):
            shift = 0
            for s in segments(t):
                part.append(s)
                names.append(k)
                shifts.append(shift)
                shift, size = shift + len(s), size + len(s) + 1
                if size >= WINDOW:
                    yield self.window(part, names, shifts)
                    part, names, shifts, size = [], [], [], 0
        if part:
            yield self.window(part, names, shifts)

    def classes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the bytes, those of a hard word all being HARD, and the bytes in lower case outside of these."""
        kind, data = _CLASS[raw], _LOWER[raw] if self.words else raw
        latin = np.flatnonzero(raw == _LATIN)
        second = raw[latin + 1]
        marks = [np.flatnonzero(_FAR[raw]), latin[(second == _SIGNS[0]) | (second == _SIGNS[1])]]
        if self.words:
            upper = latin[(second < 0x9F)] + 1
            data[upper] += 0x20
            special = np.flatnonzero(raw == ord("<"))
            marks.append(special[raw[special + 1] == ord("|")])
        quote = np.flatnonzero(raw == ord("'"))
        marks.append(quote[_CONTRACTED[data[quote + 1]]])
        at = np.concatenate(marks)
        if len(at):
            gaps = np.flatnonzero((kind == SPACE) | (kind == BORDER))
            k = np.unique(np.searchsorted(gaps, at))
            begin, end = np.where(k > 0, gaps[k - 1] + 1, 0), gaps[k]
            inside = spans(begin, end - begin)
            kind[inside] = HARD
            if self.words:
                data[inside] = raw[inside]
        return kind, data

    def split(self, raw: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """begin, end and class of the pieces."""
        new = np.empty(len(kind), bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        if self.words:
            new |= kind == DIGIT
        begin = np.flatnonzero(new)
        end, of = np.append(begin[1:], len(kind)), kind[begin]
        if self.words:
            keep = (of != SPACE) & (of != BORDER)
            return begin[keep], end[keep], of[keep]
        # the last sign of white space before a word is apart: a blank belongs to the word
        inner = np.flatnonzero((of[:-1] == SPACE) & (of[1:] != BORDER))
        blank = raw[end[inner] - 1] == 32
        begin = begin.copy()
        begin[inner[blank] + 1] -= 1
        end[inner] -= 1
        alone = inner[~blank]
        begin, end, of = np.concatenate([begin, end[alone]]), np.concatenate([end, end[alone] + 1]), np.concatenate([of, np.full(len(alone), SPACE, np.uint8)])
        keep = (of != BORDER) & (end > begin)
        begin, end, of = begin[keep], end[keep], of[keep]
        order = np.argsort(begin, kind="stable") if len(alone) else slice(None)
        return begin[order], end[order], of[order]

    def window(self, part: list[bytes], names: list[int], shifts: list[int]) -> Window:
        raw = np.frombuffer(b"\xff".join([*part, b""]), np.uint8)
        kind, data = self.classes(raw)
        begin, end, of = self.split(raw, kind)
        size = end - begin
        h = self.hashes(data, begin, size)
        hard = (of == HARD) | (size > LONGEST)
        for k in np.flatnonzero(size > LONGEST).tolist():
            h[k] = int.from_bytes(blake2b(data[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little") | 1
        names_of, where, back = np.unique(h, return_index=True, return_inverse=True)
        at, held = self.cache.find(names_of)
        if not held.all() and not self.cache.room(int(size[where[~held]].sum() + (~held).sum())):
            held[:] = False
            self.cache.room(int(size[where].sum() + len(where)))
        first, many = self.cache.begin[at].astype(np.int64), self.cache.many[at].astype(np.int64)
        fresh = np.flatnonzero(~held)
        if len(fresh):
            arrays, order = self.values(data, begin[where[fresh]], size[where[fresh]], hard[where[fresh]])
            fresh = fresh[order]
            lengths = np.concatenate([n for _, n in arrays])
            first[fresh], many[fresh] = self.cache.put(names_of[fresh], np.concatenate([v for v, _ in arrays]), lengths), lengths
        lead = np.cumsum([0, *(len(p) + 1 for p in part)])
        own = np.searchsorted(lead, begin, side="right") - 1
        shift = np.array(shifts, np.int64) - lead[:-1]
        return Window(np.array(names, np.int64)[own], begin + shift[own], end + shift[own], first[back], many[back], self.cache.arena)

    def hashes(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of the pieces' bytes; those of pieces longer than LONGEST mean nothing."""
        with np.errstate(over="ignore"):
            if len(data) <= 4 * WINDOW:
                if len(self.up) <= len(data):
                    n = max(len(data) + 1, WINDOW + (WINDOW >> 2))
                    self.up, self.back = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(_VALUE[data] * self.up[: len(data)], out=sums[1:])
                h = (sums[begin + size] - sums[begin]) * self.back[begin]
            else:  # a word without end, and few others
                h, up = np.zeros(len(begin), np.uint64), _powers(_BASE, LONGEST)
                for k in range(LONGEST):
                    held = np.flatnonzero(size > k)
                    h[held] += _VALUE[data[begin[held] + k]] * up[k]
            return _mixed(h + size.astype(np.uint64) * _MIX[2]) | np.uint64(1)

    def values(self, data, begin, size, hard) -> tuple[list, np.ndarray]:
        """(values, how many of each piece) of some pieces at a time, and the pieces' order in them."""
        out, orders, tail = [], [], b"\xff" if self.words else b""
        easy = np.flatnonzero(~hard)
        for k in range(0, len(easy), 20_000):
            now = easy[k : k + 20_000]
            n = size[now]
            width = int(n.max())
            cells = data[np.minimum(begin[now][:, None] + np.arange(width + len(tail)), len(data) - 1)]
            cells[np.arange(width + len(tail)) >= n[:, None]] = 0
            if tail:
                cells[np.arange(len(now)), n] = tail[0]
            values, many, order = self.batch.solved(cells, n + len(tail), self.counts)
            out.append((values, many))
            orders.append(now[order])
        for k in np.flatnonzero(hard).tolist():
            v = self.hard(data[begin[k] : begin[k] + size[k]].tobytes())
            out.append((v, np.array([len(v)])))
            orders.append(np.array([k]))
        return out, np.concatenate(orders)

    def of_texts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """begin, end and values (all together) of each text's pieces."""
        held: list = []
        want = 0

        def whole():
            parts, held[:] = list(held), []
            if len(parts) == 1:
                return parts[0]
            return tuple(np.concatenate([p[i] for p in parts]) for i in range(3)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32))

        for w in self.windows(texts):
            flat, ends = w.flat(), np.append(0, np.cumsum(w.many))
            names, first = np.unique(w.text, return_index=True)
            for k, a, b in zip(names.tolist(), first.tolist(), np.append(first, len(w.text))[1:].tolist(), strict=True):
                while want < k:
                    yield whole()
                    want += 1
                held.append((w.begin[a:b], w.end[a:b], flat[ends[a] : ends[b]]))
        while want < len(texts):
            yield whole()
            want += 1
