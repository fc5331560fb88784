"""Byte-level BPE by prefix dynamic programming (operators 2 and 4).

For every byte prefix of a piece there is exactly one token that can end the prefix's encoding: the one
that leaves a shorter prefix whose own last token forms a valid pair with it. Storing that last token (and
the token count) for each prefix gives exact counts at every prefix, appends that never look back, and
re-encoding that stops as soon as it meets the old pieces again after an edit.

Vocabularies are read from a path parameter and held once per Python worker; they are never shipped.
"""

from __future__ import annotations

import base64
import functools
import json
import re
from array import array

import numpy as np
import regex

#: Fixed value: the white space of Unicode, as the pattern's \s means it (Python's own \s has four more).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | frozenset(map(chr, range(0x2000, 0x200B)))
#: The pattern's contractions of three letters.
CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))
#: Runs that no piece of the pattern crosses: a word with the blank before it, or white space.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The white space beyond ASCII: texts that have it are split into chunks one by one.
ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Entries of a worker's caches; when full they start anew, which changes no result.
CACHE = 200_000


def read_tiktoken(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies in JSON write bytes: printable ones stand for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_json(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks in the order of merging, and the added tokens, of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    ids = {bytes(letters[c] for c in t): k for t, k in spec["model"]["vocab"].items()}
    return ids, {x["content"]: x["id"] for x in spec["added_tokens"]}


class PrefixBPE:
    """Encoder for one vocabulary. ranks: token bytes -> id, ids in the order of merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, k in ranks.items():
            self.tokens[k] = t
        self.special = special or {}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.left, self.right = [-1] * len(self.tokens), [-1] * len(self.tokens)  # a token's last merge; -1 for single bytes
        self.merges: dict[int, int] = {}  # that merge's two ids, packed -> the token
        lengths: dict[bytes, set[int]] = {}
        for t in sorted(ranks, key=ranks.__getitem__):
            lengths.setdefault(t[-3:], set()).add(len(t))
            k = ranks[t]
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None and a < k and b < k and self.fits(a, b):
                    self.left[k], self.right[k] = a, b
                    self.merges[a << 20 | b] = k
                    break
        self.lengths = {tail: tuple(sorted(n, reverse=True)) for tail, n in lengths.items()}  # of tokens with these last three bytes, longest first
        self.pairs: dict[int, bool] = {}
        self.kept: dict[tuple[bytes, bool], np.ndarray] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens can stand side by side: no merge reaches over the border between them.

        The two tokens are taken apart from their last merges backwards, so that the border's neighbours are
        those of each earlier moment. A merge of theirs is impossible if it comes before the merge undone last.
        """
        limit, merge, left, right = 1 << 40, self.merges.get, self.left, self.right
        while True:
            joined = merge(a << 20 | b)
            # twice the rank, plus one on the right: of equal merges the left one comes first
            if joined is not None and 2 * joined < limit:
                return False
            inner_a, inner_b = right[a], left[b]
            if inner_a >= 0 and (inner_b < 0 or a > b):
                limit, a = 2 * a, inner_a
            elif inner_b >= 0:
                limit, b = 2 * b + 1, inner_b
            else:
                return True

    def last_tokens(self, data: bytes, last: array | None = None, counts: array | None = None) -> tuple[array, array]:
        """For each prefix of a piece its last token and its token count; entry 0 is the empty prefix.

        With `last` and `counts` of a shorter prefix of `data` these grow in place: an append.
        """
        last, counts = (array("i", [-1]), array("i", [0])) if last is None else (last, counts)
        rank, lengths, pairs = self.ranks.get, self.lengths.get, self.pairs
        for end in range(len(last), len(data) + 1):
            token = None
            for n in (*lengths(data[end - 3 : end], ()), 2, 1) if end > 2 else (2, 1):
                begin = end - n
                if begin > 0:
                    token = rank(data[begin:end])
                    if token is not None:
                        pair = last[begin] << 20 | token
                        ok = pairs.get(pair)
                        if ok is None:
                            if len(pairs) > CACHE:
                                pairs.clear()
                            ok = pairs[pair] = self.fits(last[begin], token)
                        if ok:
                            break
                elif not begin:
                    token = rank(data[:end])
                    if token is not None:
                        break
            last.append(token)
            counts.append(counts[begin] + 1)
        return last, counts

    def ids_back(self, data_len: int, last: array) -> array:
        out, end = array("i"), data_len
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def hard(self, data: bytes, counts: bool = False) -> np.ndarray:
        """Ids of a chunk (counts: its token counts at each of its byte prefixes), by the dynamic programming."""
        got = self.kept.get((data, counts))
        if got is None:
            out, before = [np.empty(0, np.uint32)], 0
            for p in self.find(data.decode("utf-8", "surrogatepass")):
                piece = p.encode("utf-8", "surrogatepass")
                last, many = self.last_tokens(piece)
                if counts:
                    if len(piece) == 3 and p in CONTRACTIONS:
                        many[2] = 2  # one that is cut is no contraction
                    out.append(np.array(many[1:], np.uint32) + np.uint32(before))
                    before += many[-1]
                else:
                    out.append(np.array(self.ids_back(len(piece), last), np.uint32))
            got = np.concatenate(out)
            if len(data) <= 64:
                if len(self.kept) >= CACHE // 4:
                    self.kept.clear()
                self.kept[data, counts] = got
        return got

    @functools.cached_property
    def batch(self) -> BatchDP:
        return BatchDP(self)

    @functools.cached_property
    def coders(self) -> dict:
        """Splitting and looking up in numpy: of ids, and of counts at prefixes."""
        from isotherm.llm.pieces import PieceCoder

        return {c: PieceCoder(self.batch, functools.partial(self.hard, counts=c), counts=c) for c in (False, True)}

    def segments(self, text: str):
        """(is special, string) in order."""
        at = 0
        if self.at_special and "<" in text:
            for m in self.at_special.finditer(text):
                if m.start() > at:
                    yield False, text[at : m.start()]
                yield True, m[0]
                at = m.end()
        if at < len(text):
            yield False, text[at:] if at else text

    def spread(self, texts: list[str], counts: bool = False):
        """begin and end (in UTF-8) of each text's pieces, and their ids, or counts: token counts at each byte prefix of a piece."""
        plain = [not ODD_SPACE.search(t) and not ("<" in t and self.at_special and self.at_special.search(t)) for t in texts]
        easy = self.coders[counts].of_texts([t.encode("utf-8", "surrogatepass") if x else b"" for t, x in zip(texts, plain, strict=True)])
        for t, x, got in zip(texts, plain, easy, strict=True):
            yield got if x else self.chunked(t, counts)

    def chunked(self, text: str, counts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """spread() of one text, chunk by chunk."""
        sizes, values = [], [np.empty(0, np.uint32)]
        for special, part in self.segments(text):
            for c in [part] if special else CHUNK.findall(part):
                data = c.encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                values.append(self.hard(data, counts) if not special else np.ones(len(data), np.uint32) if counts else np.array([self.special[part]], np.uint32))
        end = np.cumsum(np.array(sizes, np.int64))
        return end - np.array(sizes, np.int64), end, np.concatenate(values)

    def encode(self, text: str) -> list[int]:
        [(_, _, ids)] = self.spread([text])
        return ids.tolist()

    def decode(self, ids) -> bytes:
        names = {v: k.encode() for k, v in self.special.items()}
        tokens = self.tokens
        return b"".join([tokens[i] if i < len(tokens) else names[i] for i in ids])

    def edit(self, text: str, ids: np.ndarray, at: int, removed: int, inserted: str) -> tuple[str, np.ndarray, int]:
        """Replace `removed` characters at `at`; re-encode from the chunk before until the old chunks are met again.

        Returns the new text, its ids and how many characters were encoded anew. For vocabularies without
        special tokens, as an edit can make or break their strings far from it.
        """
        if self.special:
            raise ValueError("edits need a vocabulary without special tokens")
        table = PrefixCounts(self, text)
        begin = table.safe_before(max(0, at - 1))
        new = text[:at] + inserted + text[at + removed :]
        shift, old_ends = len(inserted) - removed, set(table.char_ends.tolist())
        stop, pos = len(new), begin
        for m in CHUNK.finditer(new, begin):
            pos = m.end()
            # after the edit, at a border of chunks in both texts, both go on alike
            if pos >= at + len(inserted) and pos - shift in old_ends:
                stop = pos
                break
        head, tail = table.before(begin), table.before(stop - shift) if stop < len(new) else len(ids)
        middle = np.array(self.encode(new[begin:stop]), "<u4")
        return new, np.concatenate([ids[:head], middle, ids[tail:]]), stop - begin


class BatchDP:
    """The dynamic programming of PrefixBPE.last_tokens over many short pieces at once, in numpy.

    All substrings that end at one place are looked up by a rolling hash in a table of the tokens; of those
    that are tokens, the one that fits the last token before it is the place's last token.
    """

    LONGEST = 40  # bytes; longer pieces go one by one
    BITS, PAIR_BITS = 21, 21

    def __init__(self, bpe: PrefixBPE):
        self.left, self.right = np.array(bpe.left, np.int64), np.array(bpe.right, np.int64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(self.LONGEST + 1, self.base, np.uint64)) * np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
            short = [(t, k) for t, k in bpe.ranks.items() if len(t) <= self.LONGEST]
            self.hashes = np.zeros(len(bpe.tokens), np.uint64)
            cells = np.frombuffer(b"".join([t.ljust(self.LONGEST, b"\0") for t, _ in short]), np.uint8).reshape(len(short), self.LONGEST)
            self.hashes[[k for _, k in short]] = self.prefix_hashes(cells)[np.arange(len(short)), [len(t) for t, _ in short]]
        ids = np.array([k for _, k in short])
        # a place of the table leads to a token, that one to the next with the same place
        self.table, self.next = np.full(1 << self.BITS, -1, np.int32), np.full(len(bpe.tokens), -1, np.int32)
        for k, slot in zip(ids.tolist(), self.slot(self.hashes[ids]).tolist(), strict=True):
            self.next[k], self.table[slot] = self.table[slot], k
        packed = np.array(sorted(bpe.merges), np.int64)
        self.merge_keys, self.merge_ids = packed, np.array([bpe.merges[k] for k in packed.tolist()], np.int64)
        self.pair_keys, self.pair_ok = np.full(1 << self.PAIR_BITS, -1, np.int64), np.zeros(1 << self.PAIR_BITS, bool)

    def slot(self, h):
        with np.errstate(over="ignore"):
            return ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BITS)

    def prefix_hashes(self, cells: np.ndarray) -> np.ndarray:
        """Hash of every prefix, [piece, length], of pieces whose bytes are the rows of cells, zeros behind them."""
        out = np.zeros((len(cells), cells.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(cells.shape[1]):
                out[:, k + 1] = out[:, k] * self.base + cells[:, k] + np.uint64(1)
        return out

    def fit(self, a, b):
        """PrefixBPE.fits for arrays."""
        key = a << 20 | b
        slot = (key.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - self.PAIR_BITS)
        ok = self.pair_ok[slot]
        lost = np.flatnonzero(self.pair_keys[slot] != key)
        if len(lost):
            new, back = np.unique(key[lost], return_inverse=True)
            good, at, limit = np.ones(len(new), bool), np.arange(len(new)), np.full(len(new), 1 << 40)
            x, y = new >> 20, new & (1 << 20) - 1
            while len(at):
                k = np.minimum(np.searchsorted(self.merge_keys, x << 20 | y), len(self.merge_keys) - 1)
                bad = (self.merge_keys[k] == x << 20 | y) & (2 * self.merge_ids[k] < limit)
                good[at[bad]] = False
                inner_x, inner_y = self.right[x], self.left[y]
                go_x = (inner_x >= 0) & ((inner_y < 0) | (x > y))
                go_y = ~go_x & (inner_y >= 0)
                limit = np.where(go_x, 2 * x, 2 * y + 1)
                x, y = np.where(go_x, inner_x, x), np.where(go_y, inner_y, y)
                on = (go_x | go_y) & ~bad
                at, limit, x, y = at[on], limit[on], x[on], y[on]
            ok[lost] = good[back]
            slot = (new.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - self.PAIR_BITS)
            self.pair_keys[slot] = new
            self.pair_ok[slot] = good[np.searchsorted(new, self.pair_keys[slot])]  # of two new pairs with one place the last stays
        return ok

    def solved(self, cells: np.ndarray, size: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (counts: token counts at each prefix) of all pieces, how many each has, and the pieces' order there.

        cells: [piece, byte], with zeros behind a piece's size, which is 1 to LONGEST.
        """
        order = np.argsort(-size, kind="stable")
        cells, size = cells[order], size[order]
        prefix = self.prefix_hashes(cells)
        last, begin_of, tokens = np.full(prefix.shape, -1, np.int64), np.zeros(prefix.shape, np.int64), np.zeros(prefix.shape, np.uint32)
        with np.errstate(over="ignore"):
            for end in range(1, prefix.shape[1]):
                n = int(np.searchsorted(-size, -end, side="right"))  # pieces with that many bytes
                h = prefix[:n, end, None] - prefix[:n, :end] * self.powers[end:0:-1]
                found = self.table[self.slot(h)]
                row, begin = np.nonzero(found >= 0)
                token, h = found[row, begin].astype(np.int64), h[row, begin]
                while len(row):
                    real = self.hashes[token] == h
                    r, t, start = row[real], token[real], begin[real]
                    ok = start == 0
                    inner = np.flatnonzero(~ok)
                    ok[inner] = self.fit(last[r[inner], start[inner]], t[inner])
                    r, t, start = r[ok], t[ok], start[ok]
                    last[r, end], begin_of[r, end], tokens[r, end] = t, start, tokens[r, start] + 1
                    token = self.next[token]
                    on = ~real & (token >= 0)
                    row, begin, token, h = row[on], begin[on], token[on].astype(np.int64), h[on]
        if counts:
            return tokens[:, 1:][np.arange(1, prefix.shape[1]) <= size[:, None]], size, order
        rows, at, many = np.arange(len(size)), size.copy(), tokens[np.arange(len(size)), size].astype(np.int64)
        place = np.cumsum(many) - 1
        flat = np.empty(int(many.sum()), np.uint32)
        while len(rows):
            flat[place[rows]] = last[rows, at]
            place[rows] -= 1
            at = begin_of[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        return flat, many, order

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        flat, many, order = self.solved(np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(len(pieces), width), size)
        data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(many)).tolist()
        out: list[bytes] = [b""] * len(pieces)
        for k, begin, end in zip(order.tolist(), [0, *ends], ends, strict=False):
            out[k] = data[begin:end]
        return out


class PrefixCounts:
    """Exact token counts at every prefix of one text, read from what the dynamic programming stored at each byte.

    A prefix is split as the whole text is, but for the white space that it ends with, which is one piece there: for
    such runs the counts of all their prefixes are made, once.
    """

    def __init__(self, bpe: PrefixBPE, text: str, spread: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        """spread: what bpe.spread(counts=True) gives for this text, if it has been asked."""
        self.bpe, self.text, self.runs = bpe, text, {}
        self.begin, self.end, self.inner = spread if spread is not None else next(iter(bpe.spread([text], counts=True)))
        self.each = self.inner[self.end - 1].astype(np.int64) if len(self.end) else np.zeros(0, np.int64)
        self.sums = np.cumsum(self.each)
        self.total = int(self.sums[-1]) if len(self.sums) else 0

    @functools.cached_property
    def bytes_at(self) -> np.ndarray:
        """Bytes of the first 0, 1, ... characters."""
        data = np.frombuffer(self.text.encode("utf-8", "surrogatepass"), np.uint8)
        return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))

    @functools.cached_property
    def char_ends(self) -> np.ndarray:
        return np.searchsorted(self.bytes_at, self.end)

    @functools.cached_property
    def special_spans(self) -> list[tuple[int, int]]:
        return [m.span() for m in self.bpe.at_special.finditer(self.text)] if self.bpe.at_special and "<" in self.text else []

    def before(self, chars: int) -> int:
        """Tokens of all pieces that end at or before that place."""
        k = int(np.searchsorted(self.char_ends, chars, side="right"))
        return int(self.sums[k - 1]) if k else 0

    def run(self, chars: int) -> tuple[int, int]:
        """The run of white space that ends at that place, up to a special string: where it begins, and how far it goes on."""
        low, high = max([0, *(b for _, b in self.special_spans if b <= chars)]), min([len(self.text), *(a for a, _ in self.special_spans if a >= chars)])
        begin = chars
        while begin > low and self.text[begin - 1] in WHITE:
            begin -= 1
        if begin not in self.runs:
            end = chars
            while end < high and self.text[end] in WHITE:
                end += 1
            data = self.text[begin:end].encode("utf-8", "surrogatepass")
            self.runs[begin] = end, self.bpe.last_tokens(data)[1] if data else [0]
        return begin, self.runs[begin][0]

    def safe_before(self, chars: int) -> int:
        """The last border of pieces at or before `chars`, before any white space there, from which a cut text is split as the whole is."""
        ends = self.char_ends
        k = int(np.searchsorted(ends, chars, side="right"))
        if not k:
            return 0
        begin, _ = self.run(int(ends[k - 1]))
        k = int(np.searchsorted(ends, begin, side="right"))
        return int(ends[k - 1]) if k else 0

    def at(self, chars: int) -> int:
        """Tokens of text[:chars], as encoding that prefix alone would give."""
        if chars >= len(self.text):
            return self.total
        if chars <= 0:
            return 0
        for a, b in self.special_spans:
            if a < chars < b:  # a special string that is cut is plain text
                begin = self.safe_before(a)
                k = int(np.searchsorted(self.char_ends, begin))
                if begin and begin not in [z for _, z in self.special_spans]:  # its signs may go with the piece before
                    begin = int(np.searchsorted(self.bytes_at, self.begin[k]))
                return self.before(begin) + sum(len(self.bpe.hard(c.encode("utf-8", "surrogatepass"))) for c in CHUNK.findall(self.text[begin:chars]))
        if self.text[chars - 1] in WHITE and not any(b == chars for _, b in self.special_spans):
            begin, _ = self.run(chars)
            return self.before(begin) + self.runs[begin][1][int(self.bytes_at[chars] - self.bytes_at[begin])]
        at = int(self.bytes_at[chars])
        k = int(np.searchsorted(self.begin, at - 1, side="right")) - 1
        return int(self.sums[k] - self.each[k] + self.inner[at - 1])

    def every(self) -> np.ndarray:
        """Token counts of text[:0], text[:1], ... and of the whole text."""
        out = np.zeros(len(self.text) + 1, np.int64)
        out[1:] = (np.repeat(self.sums - self.each, self.end - self.begin) + self.inner)[self.bytes_at[1:] - 1] if len(self.text) else 0
        for m in re.finditer(f"[{SPACE}]+", self.text):
            for c in range(m.start() + 1, m.end() + 1):
                out[c] = self.at(c)
        for a, b in self.special_spans:
            for c in range(a + 1, b + 1):
                out[c] = self.at(c)
        return out

    def fits(self, budget: int) -> bool:
        return self.total <= budget

    def cut(self, budget: int) -> int:
        """The most characters whose prefix has at most `budget` tokens.

        They end in the first piece with which the tokens are more than that, in the white space there, or before.
        """
        if self.total <= budget:
            return len(self.text)
        k = int(np.searchsorted(self.sums, budget, side="right"))
        first, last = int(np.searchsorted(self.bytes_at, self.begin[k])), int(self.char_ends[k])
        last = max(last, self.run(last)[1]) if self.text[last - 1] in WHITE else last - 1
        low, high = self.bytes_at[first + 1 : last + 1], int(self.end[k])
        plain = low <= high
        good = np.zeros(len(low), bool)
        good[plain] = self.sums[k] - self.each[k] + self.inner[low[plain] - 1] <= budget
        special = any(a <= first < b for a, b in self.special_spans)
        for c in range(last, first, -1):
            odd = special or self.text[c - 1] in WHITE
            if self.at(c) <= budget if odd else good[c - first - 1]:
                return c
        return first if self.at(first) <= budget else self.safe_before(first)


@functools.lru_cache(maxsize=4)
def load(path: str, pattern: str) -> PrefixBPE:
    """One encoder per worker. path: a tokenizers .json or a .tiktoken file."""
    if path.endswith(".json"):
        ranks, special = read_json(path)
        return PrefixBPE(ranks, pattern, special)
    return PrefixBPE(read_tiktoken(path), pattern)
