"""Operator 8: a quality classifier. Statistics of documents, histogram gradient-boosted trees in numpy, flat arrays to score by."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import key_text, per_batch, small_batches, texts, type_of

#: The most labelled rows that a model is fitted on: those with the smallest hashes of their keys.
SAMPLE = 16_000
BINS = 64
FEATURES = (
    "log_bytes", "letters", "upper", "digits", "spaces", "lines", "punctuation", "symbols", "beyond_ascii", "controls", "entropy", "squeezed", "log_words", "word_bytes", "word_spread", "longest_word",
    "distinct_words", "top_word", "distinct_pairs", "log_lines", "line_bytes", "distinct_lines", "upper_words", "ends_plain", "ends_symbol", "short_words", "bars", "quotes",
)
_CLASS = np.zeros(256, np.int64)  # 0 other punctuation
for _name, _chars in enumerate((b"", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:!?'\"-()", b"#$%&*@^~<>{}[]|\\/=+_`"), 0):
    _CLASS[list(_chars)] = _name
_CLASS[128:] = 8
_CLASS[[*range(9), 11, 12, *range(14, 32), 127]] = 9


def statistics(text: str) -> list[float]:
    """The features of one text; all 0 for an empty one."""
    data = text.encode()
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, counts, 10) / n
    p = counts[counts > 0] / n
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w = max(1, len(words))
    sizes = np.array([len(x) for x in words] or [0])
    seen: dict[str, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 1
    # rates of repetition fall with length; of long texts they are those of 2,000 bytes' blocks on average
    squeezed = sum(len(zlib.compress(data[k : k + 4000], 1)) for k in range(0, n, 4000)) / n
    return [
        np.log1p(n), kinds[1] + kinds[2], kinds[2], kinds[3], kinds[4], kinds[5], kinds[0] + kinds[6], kinds[7], kinds[8], kinds[9], float(-(p * np.log2(p)).sum()), squeezed, np.log1p(len(words)),
        float(sizes.mean()), float(sizes.std()), float(sizes.max()), len(seen) / w, max(seen.values(), default=0) / w, pairs / max(1, len(words) - 1), np.log1p(len(lines)), n / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)), sum(x.isupper() for x in words) / w, sum(x[-1].isalnum() for x in words) / w, sum(x[-1] in "#$%&*!@|~^" for x in words) / w,
        float((sizes <= 2).mean()), counts[124] / n, (counts[34] + counts[39]) / n,
    ]


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf leads to itself."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: rows go down all trees, a level at a time."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            out += self.value[node]
        return np.round(1 / (1 + np.exp(-np.clip(out, -30, 30))), 9)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, smooth: float = 1.0, least: int = 8) -> Trees:
    """Gradient boosting on histograms of at most 64 bins a feature, with the logistic loss.

    Without rows, or with one label only, the model is a constant: the labels' smoothed share (0.5 without rows).
    """
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])  # bin b: edges[b-1] < x <= edges[b]
        at = np.full(len(y), base)
        shift = np.arange(x.shape[1])[:, None] * BINS
        for _ in range(trees):
            p = 1 / (1 + np.exp(-at))
            grad, hess = y - p, p * (1 - p)
            todo, gain_of = [(np.arange(len(y)), 0, len(nodes))], np.zeros(len(y))
            roots.append(len(nodes))
            nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
            while todo:
                rows, level, k = todo.pop()
                g, h = grad[rows], hess[rows]
                value = rate * g.sum() / (h.sum() + smooth)
                best = None
                if level < depth and len(rows) >= 2 * least:
                    cells = (binned[:, rows] + shift).ravel()
                    many = x.shape[1]
                    sums = [np.bincount(cells, np.tile(v, many) if v is not None else None, many * BINS).reshape(many, BINS).cumsum(axis=1) for v in (g, h, None)]
                    gl, hl, nl = (s[:, :-1] for s in sums)
                    gt, ht, nt = g.sum(), h.sum(), len(rows)
                    gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
                    gain[(nl < least) | (nt - nl < least)] = -1
                    for f, e in enumerate(edges):
                        gain[f, len(e) :] = -1
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    best = (f, b) if gain[f, b] > 1e-6 else None
                if best is None:
                    nodes[k] = [0, 0.0, k, k, value]
                    gain_of[rows] = value
                    continue
                f, b = best
                low = binned[f, rows] <= b
                nodes[k] = [int(f), float(edges[f][b]), len(nodes), len(nodes) + 1, 0.0]
                for part, to in ((rows[low], len(nodes)), (rows[~low], len(nodes) + 1)):
                    todo.append((part, level + 1, to))
                nodes += [[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]]
            at += gain_of
    cols = list(zip(*nodes, strict=True)) if nodes else [[], [], [], [], []]
    return Trees(np.array(cols[0], np.int64), np.array(cols[1], float), np.array(cols[2], np.int64), np.array(cols[3], np.int64), np.array(cols[4], float), np.array(roots, np.int64), depth, base)


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the array of FEATURES of every whole text; null and empty texts have zeros."""
    return per_batch(key_text(df, key, text), lambda b: {"key": b.column("key"), "features": [list(map(float, statistics(t))) for t in texts(b)]}, f"key {type_of(df, key)}, features array<double>").withColumnRenamed("key", key)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Trees:
    """Fit on at most `sample` labelled documents, those with the smallest hashes of their keys.

    A key with several labels counts once, with the smallest; null labels and labels without documents do not
    count. The sample, so many rows of some numbers, is all that comes to the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    found = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "k")  # at most `sample` rows of two numbers
    # a repeated key's texts all count: at most a few rows; the order is made the same in every run
    rows = features(found.select(F.struct("k", "y").alias("k"), "text"), "k").select("k.k", "k.y", "features").orderBy(F.xxhash64("k"), "k", "features").limit(sample).toArrow()
    y = np.array(rows.column("y").to_pylist(), float)
    x = np.array(rows.column("features").to_pylist(), float).reshape(len(y), len(FEATURES))
    return fit(x, y)


def score(df: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (probability of label 1) of every row's whole text. Equal texts have equal scores."""

    def work(batch):
        x = np.array([statistics(t) for t in texts(batch)], float)
        return {"key": batch.column("key"), "score": model.score(x)}

    return per_batch(key_text(df, key, text), work, f"key {type_of(df, key)}, score double").withColumnRenamed("key", key)


def filtered(df: DataFrame, model: Trees, least: float, text: str = "text") -> DataFrame:
    """df's rows whose text scores at least `least`, with all their columns; the texts are scored where the rows are."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                good = model.score(np.array([statistics(t) for t in texts(b, text)], float)) >= least
                yield b.filter(pa.array(good))

    small_batches(df)
    return df.mapInArrow(run, df.schema)


def held_out(key: str = "doc_id"):
    """Whether a key belongs to the fold that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
