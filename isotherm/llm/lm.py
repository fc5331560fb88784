"""Operator 10: masked pseudo-likelihood. A window network in numpy predicts every word from both sides.

The network tells the corpus's most frequent words apart, by counts over all documents, and all others by how often
they occur. A word that is not among the most frequent ones has its own share of all words that occur so often, from
the table of all words' counts, which grows with the corpus; counts leave the scored document out. A word that
occurs in no other document is spelled, at a fixed price a byte. Partitions train copies of one network on their own
documents, each place of which is masked and predicted once in the two rounds, and the copies' mean, by words
trained on, is the next round's network. A document's score is the sum over all its words of the logarithm of the
word's probability given its neighbours on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import batches_of, clear, key_text, mark, materialize, per_batch, slabs, texts, tree_sum, type_of
from isotherm.llm.jaccard import words_in

CLASSES, EACH = 32, 32
VOCABULARY = CLASSES * EACH  # of which the last RARE are words by their number of occurrences
RARE = 32
COMMON = 16  # occurrences that a word of its own has at least
SPELLED = float(np.log(64))  # a byte of a word that occurs nowhere else
SIDE = 2  # neighbours on each side
HIDDEN = 24
ROUNDS = 2  # each place is a target in one of them
STEP = 8192  # targets in a step of training
RATE = 0.5
PLACES = 1 << 16  # scored at a time
GROUP = 16 << 20  # characters of texts that share a dictionary


@dataclass
class Network:
    """Hidden units of the neighbours' rows, one table for each distance; then a class, then a word of that class."""

    near: np.ndarray  # [2 * SIDE, VOCABULARY + 1, HIDDEN]; the last row stands beyond the text's ends
    bias: np.ndarray  # [HIDDEN]
    classes: np.ndarray  # [HIDDEN + 1, CLASSES]
    words: np.ndarray  # [CLASSES, HIDDEN + 1, EACH]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.near, self.bias, self.classes, self.words)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        shapes, at, out = [(2 * SIDE, VOCABULARY + 1, HIDDEN), (HIDDEN,), (HIDDEN + 1, CLASSES), (CLASSES, HIDDEN + 1, EACH)], 0, []
        for s in shapes:
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s).copy())
            at += n
        return cls(*out)

    @classmethod
    def new(cls, counts: np.ndarray) -> Network:
        """Small random rows, and the words' shares as the first guess."""
        rng = np.random.default_rng(5)
        by = (counts + 1.0).reshape(EACH, CLASSES).T  # word w is of class w % CLASSES
        near = rng.normal(0, 0.1, (2 * SIDE, VOCABULARY + 1, HIDDEN))
        classes, words = rng.normal(0, 0.05, (HIDDEN + 1, CLASSES)), rng.normal(0, 0.05, (CLASSES, HIDDEN + 1, EACH))
        classes[-1], words[:, -1, :] = np.log(by.sum(axis=1) / by.sum()), np.log(by / by.sum(axis=1, keepdims=True))
        return cls(near, np.zeros(HIDDEN), classes, words)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """around: [places, 2 * SIDE] words."""
        h = np.ones((len(around), HIDDEN + 1), self.bias.dtype)
        h[:, :HIDDEN] = self.bias
        for k in range(2 * SIDE):
            h[:, :HIDDEN] += self.near[k][around[:, k]]
        np.tanh(h[:, :HIDDEN], out=h[:, :HIDDEN])
        return h

    def log_probabilities(self, word: np.ndarray, around: np.ndarray) -> np.ndarray:
        kind = word % CLASSES
        order, ends = by_class(kind)
        h, nth, out = self.hidden(around[order]), (word // CLASSES)[order], np.empty(len(word), self.bias.dtype)
        rows = np.arange(len(word))
        x = h @ self.classes
        p = x[rows, kind[order]] - np.log(total(exponents(x)))
        for c, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            if b > a:
                x = h[a:b] @ self.words[c]
                p[a:b] += x[rows[: b - a], nth[a:b]] - np.log(total(exponents(x)))
        out[order] = p
        return out

    def learn(self, word: np.ndarray, around: np.ndarray, rate: float) -> None:
        """A step of gradient ascent on the mean log probability."""
        n, kind = len(word), word % CLASSES
        order, ends = by_class(kind)
        around, nth, rows = around[order], (word // CLASSES)[order], np.arange(n)
        h = self.hidden(around)
        g = exponents(h @ self.classes)
        g /= -total(g)[:, None]
        g[rows, kind[order]] += 1
        back = g @ self.classes.T
        up = h.T @ g
        for c, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            if b > a:
                own = h[a:b]
                g = exponents(own @ self.words[c])
                g /= -total(g)[:, None]
                g[rows[: b - a], nth[a:b]] += 1
                back[a:b] += g @ self.words[c].T
                self.words[c] += rate / max(32, b - a) * (own.T @ g)
        self.classes += rate / n * up
        back = back[:, :HIDDEN] * (1 - h[:, :HIDDEN] ** 2)
        self.bias += rate * back.mean(axis=0)
        for k in range(2 * SIDE):
            # the sum of each word's gradients, over the root of how often it stands here
            names = around[:, k].astype(np.uint16)
            order = np.argsort(names, kind="stable")
            names = names[order]
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            scale = 0.1 * rate / np.sqrt(np.diff(np.append(first, n)))
            self.near[k][names[first]] += np.add.reduceat(back[order], first) * scale[:, None].astype(back.dtype)


#: Exponents are cut off here, so that none is infinite in 32 bits.
HIGHEST = 60.0


def by_class(kind: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The order by classes, and where each class ends in it."""
    return np.argsort(kind.astype(np.uint8), kind="stable"), np.cumsum(np.bincount(kind, minlength=CLASSES)).tolist()


def exponents(x: np.ndarray) -> np.ndarray:
    """In place."""
    return np.exp(np.minimum(x, HIGHEST, out=x), out=x)


def total(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def level(count: np.ndarray) -> np.ndarray:
    """Which of the RARE kinds a word is that occurs so often elsewhere: 0 for never, then two kinds for each doubling."""
    return np.where(count > 0, np.minimum(RARE - 1, np.ceil(2 * np.log2(np.maximum(count, 1))) + 1), 0).astype(np.int64)


def surroundings(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words of some texts, and the words around each, [places, 2 * SIDE]: before it from far to near, then after it."""
    gap = np.full(SIDE, VOCABULARY, np.int32)
    line = np.concatenate([x for r in rows for x in (gap, r)] + [gap])
    places = np.flatnonzero(line != VOCABULARY)
    around = np.stack([line[places + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)
    return line[places], around


def packed(x: np.ndarray, many: np.ndarray) -> list[bytes]:
    """Numbers in seven bits a byte, the last byte of each with its eighth bit set, cut into runs of many[0], many[1], ... numbers."""
    size = 1 + (x >= 1 << 7).astype(np.int64) + (x >= 1 << 14) + (x >= 1 << 21)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(x) else 0, np.uint8)
    for k in range(4):
        held = size > k
        out[end[held] - 1 - k] = (x[held] >> 7 * k) & 127
    out[end - 1] |= 128
    ends = np.append(0, end)[np.cumsum(many)].tolist()
    data = out.tobytes()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw >> 7)
    begin = np.append(0, end[:-1] + 1) if len(end) else end
    out = np.zeros(len(end), np.int64)
    for k in range(4):
        held = end - k >= begin
        out[held] |= (raw[end[held] - k].astype(np.int64) & 127) << 7 * k
    return out


LOCAL = "part long, kind int, at int, word long, n long, data binary"


def local_words(own: DataFrame) -> DataFrame:
    """Documents as numbers of words in a dictionary of their part, some megabytes of texts of one task.

    kind 0: a part's dictionary: how often each word occurs (32 bits each), then its bytes (16 bits each). kind 1: a
    word of it, with its place, hash and count. kind 2: a document (key) with its words' places, most frequent first.
    """

    def rows(many, **cols):
        return {c: cols.get(c, [None] * many) for c in ("key", "part", "kind", "at", "word", "n", "data")}

    def work(batches):
        from pyspark import TaskContext

        part, keys, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in (*batches, None):
            if b is not None:
                for key, t in zip(b.column("key").to_pylist(), texts(b), strict=True):
                    keys.append(key)
                    held.append(words_in(t) if t else (np.empty(0, np.uint64), np.empty(0, np.int64)))
                    size += len(t)
            if keys and (size > GROUP or b is None):
                many = np.array([len(h) for h, _ in held])
                names, first, back, n = np.unique(np.concatenate([h for h, _ in held]), return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                length = np.concatenate([x for _, x in held])[first[order]]
                yield rows(1, part=[part], kind=[0], data=[n[order].astype("<u4").tobytes() + length.astype("<u4").tobytes()])
                for k in range(0, len(order), 50_000):
                    now = order[k : k + 50_000]
                    yield rows(len(now), part=np.full(len(now), part), kind=np.full(len(now), 1), at=np.arange(k, k + len(now)), word=names[now].view(np.int64), n=n[now])
                data = packed(place[back], many)
                for k in range(0, len(keys), 2000):
                    now = keys[k : k + 2000]
                    yield rows(len(now), key=now, part=[part] * len(now), kind=[2] * len(now), data=data[k : k + 2000])
                part, keys, held, size = part + 1, [], [], 0

    return batches_of(own, work, f"key {type_of(own, 'key')}, {LOCAL}")


def whole_words(local: DataFrame) -> DataFrame:
    """Counts over all parts. kind 1: a part's word that other parts have, too, or that is frequent there, with its count in all.

    kind 3: the most frequent words of each task. kind 4: tokens and words of each level (at), by words' counts. Rows
    are sorted by word and read as a stream; a word has as many rows as there are parts.
    """

    def work(batches):
        mass, best = np.zeros((2, RARE)), [np.empty(0, np.int64), np.empty(0, np.int64)]
        rest = [np.empty(0, np.int64)] * 4
        for b in (*batches, None):
            now = [np.concatenate([r, b.column(c).to_numpy()]) for r, c in zip(rest, ("word", "n", "part", "at"), strict=True)] if b is not None else rest
            word, n, part, at = now
            # the last word's rows wait for the next batch
            end = len(word) if b is None else int(np.searchsorted(word, word[-1])) if len(word) else 0
            word, n, part, at, rest = word[:end], n[:end], part[:end], at[:end], [x[end:] for x in now]
            if not end:
                continue
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            runs, total = np.diff(np.append(first, end)), np.add.reduceat(n, first)
            for k, weight in ((0, total), (1, None)):
                mass[k] += np.bincount(level(total), weight, RARE)
            names = [np.concatenate([best[0], word[first]]), np.concatenate([best[1], total])]
            top = np.lexsort((names[0], -names[1]))[:VOCABULARY]
            best = [names[0][top], names[1][top]]
            known = np.repeat((runs > 1) | (total >= COMMON), runs)
            if known.any():
                yield {"part": part[known], "kind": np.full(int(known.sum()), 1), "at": at[known], "word": word[known], "n": np.repeat(total, runs)[known], "data": [None] * int(known.sum())}
        for kind, cols in ((3, {"word": best[0], "n": best[1]}), (4, {"at": np.arange(RARE), "n": mass[0].astype(np.int64), "word": mass[1].astype(np.int64)})):
            k = len(next(iter(cols.values())))
            if k:
                yield {c: cols.get(c, [None] * k) for c in ("part", "at", "word", "n", "data")} | {"kind": [kind] * k}

    rows = local.where("kind = 1").select("word", "n", "part", "at")
    return batches_of(rows.repartition("word").sortWithinPartitions("word"), work, LOCAL)


@dataclass
class Words:
    """What scoring knows of the whole corpus: the most frequent words (hashes in ascending order, and names), and each level's tokens."""

    hashes: np.ndarray
    names: np.ndarray
    mass: np.ndarray
    counts: np.ndarray  # of all names, to begin training with


def vocabulary(whole: DataFrame) -> Words:
    """The words with names are as many as the network has, and levels are RARE: both come to the driver."""
    top = whole.where("kind = 3").where(F.col("n") >= COMMON).orderBy(F.desc("n"), "word").limit(VOCABULARY - RARE).collect()
    mass = np.zeros(RARE)
    for r in whole.where("kind = 4").groupBy("at").agg(F.sum("n").alias("n")).collect():
        mass[r["at"]] = r["n"]
    hashes, n = np.array([r["word"] for r in top], np.int64), np.array([r["n"] for r in top], np.int64)
    np.subtract.at(mass, level(n), n)
    counts = np.zeros(VOCABULARY)
    counts[: len(n)], counts[VOCABULARY - RARE :] = n, mass
    order = np.argsort(hashes)
    return Words(hashes[order], order.astype(np.int64), mass, counts)


def named(ids: list[np.ndarray], total: np.ndarray, length: np.ndarray, own: np.ndarray, words: Words) -> tuple[list[np.ndarray], np.ndarray]:
    """Names of each document's words, and the sum of the logarithms of their shares of their names.

    ids: places in a dictionary, which has for each word the count in all documents, the bytes, and the name or -1.
    """
    many = np.array([len(x) for x in ids])
    doc = np.repeat(np.arange(len(ids)), many)
    key, back, n = np.unique(doc << 32 | np.concatenate(ids), return_inverse=True, return_counts=True)
    at, doc = key & 0xFFFFFFFF, key >> 32
    rest = np.maximum(total[at] - n, 0)
    kind = level(rest)
    share = np.where(rest > 0, np.log(np.maximum(rest, 1) / np.maximum(words.mass[kind], np.maximum(rest, 1))), -SPELLED * length[at])
    name = np.where(own[at] >= 0, own[at], VOCABULARY - RARE + kind)
    extra = np.bincount(doc, np.where(own[at] >= 0, 0.0, share) * n, len(ids))
    return np.split(name[back].astype(np.uint16), np.cumsum(many)[:-1]), extra


def names_of(local: DataFrame, whole: DataFrame, words: Words, key_type: str) -> DataFrame:
    """key, ids (binary: 16-bit names of all words) and extra of every document: each part's dictionary, then its documents, as a stream."""
    known = local.sparkSession.sparkContext.broadcast(words)
    columns = ["key", "part", "kind", "at", "word", "n", "data"]

    def work(batches):
        total = length = own = None
        for b in batches:
            if not b.num_rows:
                continue
            part, kind = b.column("part").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                rows = b.slice(begin, end - begin)
                if kind[begin] == 0:
                    data = rows.column("data")[0].as_py()
                    n = len(data) // 8
                    total, length = np.frombuffer(data[: 4 * n], "<u4").astype(np.int64), np.frombuffer(data[4 * n :], "<u4").astype(np.int64)
                    own = np.full(n, -1)
                elif kind[begin] == 1:
                    at, word = rows.column("at").to_numpy(), rows.column("word").to_numpy()
                    total[at] = rows.column("n").to_numpy()
                    if len(known.value.hashes):
                        k = np.minimum(np.searchsorted(known.value.hashes, word), len(known.value.hashes) - 1)
                        own[at] = np.where(known.value.hashes[k] == word, known.value.names[k], -1)
                else:
                    keys, ids = rows.column("key"), [unpacked(x) for x in rows.column("data").to_pylist()]
                    for k in range(0, len(ids), 500):
                        name, extra = named(ids[k : k + 500], total, length, own, known.value)
                        yield {"key": keys.slice(k, len(name)).to_pylist(), "ids": [x.tobytes() for x in name], "extra": extra}

    rows = local.where("kind <> 1").select(columns).unionByName(whole.where("kind = 1"), allowMissingColumns=True).select(columns)
    return batches_of(rows.repartition("part").sortWithinPartitions("part", "kind"), work, f"key {key_type}, ids binary, extra double")


def encoded(own: DataFrame) -> tuple[DataFrame, Words]:
    begun = mark()
    local = materialize(local_words(own), "local-words")
    whole = materialize(whole_words(local), "whole-words")
    words = vocabulary(whole)
    out = materialize(names_of(local, whole, words, type_of(own, "key")), "named-words")
    clear(own.sparkSession, begun, keep=1)
    return out, words


def ids_in(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int32) for x in batch.column("ids").to_pylist()]


def train(docs: DataFrame, words: Words, rounds: int = ROUNDS) -> Network:
    """Rounds over all documents (ids). Each partition trains a copy; their mean by targets is the next network."""
    context = docs.sparkSession.sparkContext
    network = Network.new(words.counts)
    for r in range(rounds):
        now = context.broadcast(network)

        def work(batches, now=now, r=r):
            net, seen = Network.of(now.value.flat().astype(np.float32)), 0

            def learn(rows: list[np.ndarray]) -> int:
                w, a = surroundings(rows)
                w, a = w[r % ROUNDS :: ROUNDS], a[r % ROUNDS :: ROUNDS]
                for k in range(0, len(w), STEP):
                    net.learn(w[k : k + STEP], a[k : k + STEP], RATE / (1 + r))
                return len(w)

            for rows in taken(batches):
                seen += learn(rows)
            # what changed, times the targets seen; then the targets
            if seen:
                yield from slabs(np.append((net.flat().astype(float) - now.value.flat()) * seen, float(seen)))

        size, begun = len(network.flat()), mark()
        trained = materialize(batches_of(docs.select("ids"), work, "part int, slab int, data binary"), "trained")
        total = tree_sum(trained, size + 1, np.float64)
        clear(docs.sparkSession, begun)
        if total[-1]:
            network = Network.of(network.flat() + total[:-1] / total[-1])
    return network


def taken(batches) -> Iterator[list[np.ndarray]]:
    """Documents' names by PLACES and somewhat more at a time; one long document alone is not cut."""
    rows, size = [], 0
    for b in batches:
        for ids in ids_in(b):
            if len(ids):
                rows.append(ids)
                size += len(ids)
                if size >= 2 * PLACES:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def score(docs: DataFrame, network: Network) -> DataFrame:
    single = Network(*(x.astype(np.float32) for x in (network.near, network.bias, network.classes, network.words)))
    net = docs.sparkSession.sparkContext.broadcast(single)

    def work(batch):
        rows = ids_in(batch)
        many = np.array([len(r) for r in rows])
        total = np.zeros(len(rows))
        begin = 0
        while begin < len(rows):
            end, size = begin, 0
            while end < len(rows) and (end == begin or size + many[end] <= PLACES):
                size += many[end]
                end += 1
            if size:
                w, a = surroundings(rows[begin:end])
                # one long text is more than PLACES words, and goes in parts, too
                p = np.concatenate([net.value.log_probabilities(w[k : k + PLACES], a[k : k + PLACES]) for k in range(0, len(w), PLACES)]).astype(float)
                total[begin:end] = np.bincount(np.repeat(np.arange(end - begin), many[begin:end]), p, end - begin)
            begin = end
        total += batch.column("extra").to_numpy()
        return {"key": batch.column("key"), "n_words": many, "log_probability": np.round(total, 3), "mean": [round(float(t / n), 6) if n else None for t, n in zip(total, many, strict=True)]}

    return per_batch(docs, work, f"key {type_of(docs, 'key')}, n_words long, log_probability double, mean double")


def pseudo_likelihood(df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """key, n_words, log_probability (summed over all words) and mean (by word) of every row of df, by a network trained on df.

    Null and empty texts, and texts without words, have 0 words, a sum of 0 and a null mean. Equal texts have equal
    scores within a run; a text that stands in several rows occurs elsewhere for each of them. One row per row of df;
    null and repeated keys are keys like others, other columns are ignored. An empty table gives an empty one.
    """
    docs, words = encoded(key_text(df, key, text))
    return score(docs, train(docs, words, rounds)).withColumnRenamed("key", key)
