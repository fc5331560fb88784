"""Words of many texts at once in numpy: runs of ASCII digits and letters and of bytes over 127, only A-Z lower-cased.

In UTF-8 that is the class of characters `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`, as bytes over 127 stand in
characters beyond ASCII only.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: The first so many bytes of a byte string, as a mask of its eight-byte number.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are compared one by one.
LANES = 4


class Split:
    """The words of a column of texts: `begin` and `end` in `cells` (lower-cased UTF-8, all texts together), `row` of each; row r has the words from first[r] to first[r + 1]."""

    def __init__(self, column: pa.Array):
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low:high]
        # room for loads of eight bytes before the first and after the last word
        self.cells = np.zeros(high - low + 16, np.uint8)
        np.take(_LOWER, data, out=self.cells[8 : high - low + 8], mode="clip")
        starts = offsets - low + 8
        inside = _WORD[self.cells]
        begins = np.empty(len(inside), bool)
        begins[0], begins[1:] = False, inside[1:] & ~inside[:-1]
        ends = np.empty(len(inside), bool)
        ends[0], ends[1:] = False, inside[:-1] & ~inside[1:]
        edges = starts[1:-1]  # texts follow each other without a sign between them
        begins[edges] = inside[edges]
        ends[edges] = inside[edges - 1]
        self.begin, self.end = np.flatnonzero(begins).astype(np.int32), np.flatnonzero(ends).astype(np.int32)
        self.first = np.searchsorted(self.begin, starts)
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.begin)

    def word(self, k: int) -> bytes:
        return self.cells[self.begin[k] : self.end[k]].tobytes()


def _lanes(cells: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Words of at most 8 * LANES bytes as LANES numbers, zeros after their ends."""
    eight = np.ndarray(len(cells) - 7, "<u8", cells, strides=(1,))
    out = []
    for k in range(LANES):
        lane = np.zeros(len(begin), np.uint64)
        has = np.flatnonzero(size > 8 * k) if k else slice(None)
        lane[has] = eight[begin[has] + 8 * k] & _HEAD[np.clip(size[has] - 8 * k, 0, 8)]
        out.append(lane)
    return out


def _mixed(lanes: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(lanes[0]), np.uint64)
    for lane in lanes:
        h = (h ^ lane) * _MIX
        h ^= h >> np.uint64(29)
    return h


class Vocabulary:
    """Numbers of known words, found by hash and held against the words' bytes."""

    #: Bits of a hash that choose a place in the table.
    BITS = 16
    STEP = 1 << 17

    def __init__(self, words: Iterable[bytes]):
        self.words = list(words)
        self.long = {w: k for k, w in enumerate(self.words) if len(w) > 8 * LANES}
        own = [k for k, w in enumerate(self.words) if len(w) <= 8 * LANES]
        size = np.array([len(self.words[k]) for k in own], np.int64)
        cells = np.frombuffer(b"".join(self.words[k] for k in own) + bytes(8 * LANES + 8), np.uint8)
        lanes = _lanes(cells, np.cumsum(size) - size, size)
        hashes = _mixed(lanes)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.lanes, self.number = hashes[order], [x[order] for x in lanes], np.array(own, np.int32)[order]
        self.size = size[order]
        # a small table by a hash's first bits says at once that most words are not known
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.words)

    def find(self, split: Split, a: int = 0, b: int | None = None) -> np.ndarray:
        """The number of each of a split's words from a to b, -1 for unknown ones; as many words at a time as keeps arrays small."""
        b = len(split) if b is None else b
        return np.concatenate([np.empty(0, np.int32), *[self._find(split, k, min(k + self.STEP, b)) for k in range(a, b, self.STEP)]])

    def _find(self, split: Split, a: int, b: int) -> np.ndarray:
        begin, end = split.begin[a:b], split.end[a:b]
        out = np.full(len(begin), -1, np.int32)
        if not len(self.words) or not len(begin):
            return out
        size = end - begin
        if len(self.number):
            cells = np.concatenate([split.cells, np.zeros(8 * LANES, np.uint8)]) if len(split.cells) - int(end[-1]) < 8 * LANES else split.cells
            lanes = _lanes(cells, begin, np.minimum(size, 8 * LANES))
            hashes = _mixed(lanes)
            some = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] & (size <= 8 * LANES))
            at = np.searchsorted(self.hashes, hashes[some])
            at[at == len(self.hashes)] = 0
            todo = np.arange(len(some))
            while len(todo):  # more than once only where two known words share a hash
                place = at[todo]
                same = self.hashes[place] == hashes[some[todo]]
                equal = same & (self.size[place] == size[some[todo]])
                for own, lane in zip(self.lanes, lanes, strict=True):
                    equal &= own[place] == lane[some[todo]]
                out[some[todo[equal]]] = self.number[place[equal]]
                todo = todo[same & ~equal & (place + 1 < len(self.hashes))]
                at[todo] += 1
        if self.long:
            for k in np.flatnonzero(size > 8 * LANES):
                out[k] = self.long.get(split.word(a + int(k)), -1)
        return out


# --- crc32 of runs of words -----------------------------------------------------------------------------------


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The register after a byte and k zero bytes; what k zero bytes make of each of a register's four bytes; the same for the register after a space; the crc32 of k zero bytes."""
    import zlib

    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)  # fixed value: the polynomial of crc32
    push = lambda x: one[x & 255] ^ x >> 8
    after = [one]
    for _ in range(Crc.LONG - 1):
        after.append(push(after[-1]))
    cells = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    shifts, space = [cells], [np.uint32(one[32])]
    for _ in range(Crc.LONG + 1):
        shifts.append(push(shifts[-1]))
        space.append(push(space[-1]))
    zeros = np.array([zlib.crc32(bytes(k)) for k in range(3 * Crc.LONG + 3)], np.uint32)
    return np.array(after).ravel(), np.array(shifts).ravel(), np.array(space), zeros


class Crc:
    """crc32 of runs of one to three words joined by a space.

    crc32 is linear: a run's comes from its words' by tables, one for each length. Runs with a word of more than LONG
    bytes go to zlib one by one.
    """

    LONG = 64
    _made: tuple | None = None

    @classmethod
    def runs(cls, split: Split, a: int, b: int) -> list[np.ndarray]:
        """For n of 1, 2 and 3: the crc32 of the n words from each word of a to b on; runs over a row's end mean nothing."""
        import zlib

        if cls._made is None:
            cls._made = _tables()
        after, shifts, space, zeros = cls._made
        stop = min(b + 2, len(split))
        begin, end = split.begin[a:stop], split.end[a:stop]
        size = (end - begin).astype(np.int64)
        long = np.flatnonzero(size > cls.LONG)
        size[long] = 0
        word = np.zeros(stop - a, np.uint32)  # registers that began with 0: zeros before a word do not count
        for k in range(0, int(size.max(initial=0)), 8):
            has = np.flatnonzero(size > k) if k else np.arange(len(size))
            eight = np.ndarray(len(split.cells) - 7, "<u8", split.cells, strides=(1,))[end[has] - (8 + k)]
            eight &= ~_HEAD[8 - np.clip(size[has] - k, 0, 8)]
            cells = eight.view(np.uint8).reshape(-1, 8)
            for j in range(8):
                word[has] ^= after[(k + 7 - j) * 256 + cells[:, j].astype(np.int64)]

        def joined(left: np.ndarray, n: int) -> np.ndarray:
            """Registers of runs of n words, with one more."""
            m = len(word) - n
            far = (size[n:] + 1) * 1024
            out = space[size[n:]] ^ word[n:]
            for j in range(4):
                out ^= shifts[far + j * 256 + (left[:m] >> np.uint32(8 * j) & np.uint32(255)).astype(np.int64)]
            return out

        two = joined(word, 1) if len(word) > 1 else np.empty(0, np.uint32)
        three = joined(two, 2) if len(word) > 2 else np.empty(0, np.uint32)
        out, whole = [], size.copy()
        for n, run in enumerate((word, two, three)):
            if n:
                whole = whole[: len(run)] + size[n : n + len(run)] + 1
            out.append(run ^ zeros[whole[: len(run)]])
        for k in long.tolist():
            for n in (1, 2, 3):
                for i in range(max(0, k - n + 1), min(k + 1, len(out[n - 1]))):
                    out[n - 1][i] = zlib.crc32(b" ".join(split.word(a + i + x) for x in range(n)))
        return [x[: b - a] for x in out]
