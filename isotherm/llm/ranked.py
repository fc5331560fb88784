"""Operator 12: ranked lexical search over an inverted index whose posting lists are blocked geometrically.

Documents with like words lie together in shards. In a shard each term's posting list is clustered by the documents'
similarity, and every cluster, a block, has a summary: of each term the largest impact in the block's documents, rounded
up to a byte. Summary times query is a bound that no document of the block is above, so a block is skipped only where
that bound is below the k-th best score so far; all others are scored exactly. The result is that of scoring everything.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.llm.common import batches_of, key_text, materialize, type_of
from isotherm.llm.words import Split, Vocabulary

TOP, SATURATION, LENGTH_SHARE = 10, 8, 75
#: Rows of (item, term) of a batch of items: they, and the terms' numbers, are what tasks get of the query set at once.
QUERY_ROWS = 8192
#: Documents of a block on average, documents of a shard at most, cells (documents x terms) of a shard at most, and numbers of a sketch.
BLOCK, SHARD, CELLS, SKETCH = 96, 4096, 1 << 21, 48
#: Rows of an index are some megabytes: so many bytes of them are written and read at once.
SMALL_GROUPS = {"parquet.block.size": 16 << 20}
#: An impact's unit in summaries: a byte holds the largest one, a million.
UNIT = 4096


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + SATURATION * m)


def lengths(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """A document's m: its number of words against the mean, in hundredths."""
    if int(n.max(initial=0)) * LENGTH_SHARE * docs < 1 << 63:
        return 100 - LENGTH_SHARE + (LENGTH_SHARE * n.astype(np.int64) * docs) // words
    return np.array([100 - LENGTH_SHARE + (LENGTH_SHARE * int(x) * docs) // words for x in n], np.int64)


def term_weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


# --- the query set --------------------------------------------------------------------------------------------


def item_terms(items: DataFrame) -> DataFrame:
    """item, term and n for each distinct term of each item (item, text)."""

    def work(batches):
        for batch in batches:
            split, item = Split(batch.column("text")), batch.column("item").to_pylist()
            for r, key in enumerate(item):
                terms: dict[bytes, int] = {}
                for k in range(split.first[r], split.first[r + 1]):
                    w = split.word(k)
                    terms[w] = terms.get(w, 0) + 1
                if terms:
                    yield {"item": [key] * len(terms), "term": [*terms], "n": [*terms.values()]}

    return batches_of(items, work, "item long, term binary, n long")


# --- the index ------------------------------------------------------------------------------------------------


def forward(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """key, n_words, and the known terms (their numbers, in order) and frequencies of every document with a word; near and nearer are minima of hashes over them."""
    hashes = np.random.default_rng(5).integers(0, 1 << 62, (2, max(1, len(vocabulary))))

    def work(batches):
        for batch in batches:
            split = Split(batch.column("text"))
            ids, n = vocabulary.find(split), np.diff(split.first)
            some = np.flatnonzero(ids >= 0)
            pairs, tf = np.unique(split.row[some].astype(np.int64) * max(1, len(vocabulary)) + ids[some], return_counts=True)
            rows, terms = np.divmod(pairs, max(1, len(vocabulary)))
            at = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            own = np.flatnonzero(n > 0).tolist()
            key = batch.column("key").to_pylist()
            parts = [(terms[at[r] : at[r + 1]], tf[at[r] : at[r + 1]]) for r in own]
            least = [[int(h[t].min()) if len(t) else 0 for t, _ in parts] for h in hashes]
            yield {"key": [key[r] for r in own], "n_words": n[own], "terms": [t.astype("<i4").tobytes() for t, _ in parts], "tf": [x.astype("<i4").tobytes() for _, x in parts], "near": least[0], "nearer": least[1]}

    return batches_of(docs, work, f"key {type_of(docs, 'key')}, n_words long, terms binary, tf binary, near long, nearer long")


def statistics(rows: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Each term's documents, all documents and all words, over all rows of forward()."""

    def work(batches):
        df, docs, words = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            docs, words = docs + batch.num_rows, words + int(np.sum(batch.column("n_words").to_numpy()))
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=terms)
        yield {"term": [-1, -2, *range(terms)], "n": [docs, words, *df.tolist()]}

    got = dict(batches_of(rows.select("n_words", "terms"), work, "term int, n long").groupBy("term").agg(F.sum("n")).collect())
    return np.array([got.get(t, 0) for t in range(terms)], np.int64), got.get(-1, 0), got.get(-2, 0)


class Shard:
    """The documents of a shard, and their posting lists in blocks."""

    def __init__(self, m: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray, width: int):
        self.m, self.counts, self.terms, self.tf, self.width = m, counts, terms, tf, width
        self.doc = np.repeat(np.arange(len(m), dtype=np.int32), counts)

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.m), self.width), np.uint16 if self.tf.max(initial=0) < 1 << 16 else np.int64)
        out[self.doc, self.terms] = self.tf
        return out

    def block(self, weight: np.ndarray, size: int = BLOCK) -> Shard:
        """Cluster every list: its documents go to the one of some of them, evenly taken, that their sketch is most like."""
        impact = impacts(self.tf.astype(np.int64), self.m[self.doc])
        bound = np.zeros((len(self.m), self.width), np.uint8)
        bound[self.doc, self.terms] = -(-impact // UNIT)
        signs = np.random.default_rng(3).choice(np.array([-1, 1], np.float32), (self.width, SKETCH))
        signs *= weight[:, None].astype(np.float32)
        sketch = np.concatenate([bound[k : k + 256].astype(np.float32) @ signs for k in range(0, len(bound), 256)])
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        order = np.argsort(self.terms, kind="stable")
        docs, begin = self.doc[order], np.searchsorted(self.terms[order], np.arange(self.width + 1))
        block_term, block_docs, block_many = [], [], []
        for t in np.flatnonzero(np.diff(begin)).tolist():
            own = docs[begin[t] : begin[t + 1]]
            cuts = np.zeros(1, np.int64)
            if len(own) > size:
                centres = own[:: size]
                nearest = np.argmax(sketch[own] @ sketch[centres].T, axis=1)
                by = np.argsort(nearest, kind="stable")
                own, nearest = own[by], nearest[by]
                # a cluster of many like documents is cut: its blocks stay small, and lose nothing
                inner = np.arange(len(own)) - np.searchsorted(nearest, nearest)
                cuts = np.flatnonzero(inner % (2 * size) == 0)
            block_term += [t] * len(cuts)
            block_docs.append(own)
            block_many.append(np.diff(np.append(cuts, len(own))))
        none = np.empty(0, np.int32)
        self.block_term, self.block_docs = np.array(block_term, np.int32), np.concatenate([none, *block_docs])
        self.block_many = np.concatenate([none, *block_many]).astype(np.int32)
        self.summary = np.empty((len(block_term), self.width), np.uint8)
        at = np.cumsum(self.block_many) - self.block_many
        for b, (begin, many) in enumerate(zip(at.tolist(), self.block_many.tolist(), strict=True)):
            bound[self.block_docs[begin : begin + many]].max(axis=0, out=self.summary[b])
        return self

    ARRAYS = (("m", "<i8"), ("counts", "<i4"), ("terms", "<i4"), ("tf", "<i4"), ("block_term", "<i4"), ("block_docs", "<i4"), ("block_many", "<i4"), ("summary", "u1"))

    def stored(self) -> dict[str, list[bytes]]:
        return {name: [zlib.compress(getattr(self, name).astype(kind).tobytes(), 1)] for name, kind in self.ARRAYS}

    @classmethod
    def read(cls, row: dict, width: int) -> Shard:
        got = {name: np.frombuffer(zlib.decompress(row[name]), kind) for name, kind in cls.ARRAYS}
        out = cls(got["m"], got["counts"], got["terms"], got["tf"], width)
        out.block_term, out.block_docs, out.block_many = got["block_term"], got["block_docs"], got["block_many"]
        out.summary = got["summary"].reshape(-1, width)
        return out

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], floors: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[int, int]]]:
        """For each query (terms, weights): its number, documents and scores, among them all documents of the shard with scores at least `floors` that can be of the best TOP; blocks scored and blocks of its lists."""
        tf = self.dense()
        first = np.searchsorted(self.block_term, np.arange(self.width + 1))
        at = np.cumsum(self.block_many) - self.block_many
        # the most that any document of the shard has of a term
        most = np.zeros(self.width, np.int64)
        np.maximum.at(most, self.block_term, self.summary[np.arange(len(self.block_term)), self.block_term].astype(np.int64) * UNIT)
        for q, ((terms, weight), floor) in enumerate(zip(queries, floors, strict=True)):
            order = np.argsort(-(most[terms] * weight), kind="stable")
            terms, weight = terms[order], weight[order]
            left = np.cumsum((most[terms] * weight)[::-1])[::-1]
            found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            seen = np.zeros(len(self.m), bool)
            best = np.empty(0, np.int64)
            tried, lists = 0, 0
            for k, t in enumerate(terms.tolist()):
                lists += int(first[t + 1] - first[t])
                if left[k] < floor or not left[k]:
                    continue  # nor can any list after it have what is not found yet
                blocks = np.arange(first[t], first[t + 1])
                # what stands in a list before was scored, or is below the floor: only terms from here on count
                bound = self.summary[blocks][:, terms[k:]].astype(np.int64) @ weight[k:] * UNIT
                blocks, bound = blocks[by := np.argsort(-bound, kind="stable")], bound[by]
                step = 1
                while len(blocks) and bound[0] >= floor:
                    step = min(2 * step, 32)
                    now = blocks[:step][bound[:step] >= floor]
                    blocks, bound = blocks[step:], bound[step:]
                    tried += len(now)
                    docs = np.unique(np.concatenate([self.block_docs[at[b] : at[b] + self.block_many[b]] for b in now.tolist()]))
                    docs = docs[~seen[docs]]
                    seen[docs] = True
                    score = impacts(tf[docs[:, None], terms].astype(np.int64), self.m[docs][:, None]) @ weight
                    good = score >= max(floor, 1)
                    found.append(docs[good])
                    scores.append(score[good])
                    best = np.sort(np.append(best, score[good]))[-TOP:]
                    if len(best) == TOP:
                        floor = max(floor, int(best[0]))
            docs, score = np.concatenate(found), np.concatenate(scores)
            yield q, docs[score >= floor], score[score >= floor], (tried, lists)


INDEX = "keys array<{key}>, " + ", ".join(f"{name} binary" for name, _ in Shard.ARRAYS)


def build(rows: DataFrame, weight: np.ndarray, docs: int, words: int) -> DataFrame:
    """Shards of the index, a row each. Rows of forward() are dealt by ranges of their minima, so that like documents, and copies, lie in one shard or in neighbouring ones."""
    width = len(weight)
    most = max(1, min(SHARD, CELLS // max(1, width)))

    def shard(part: list[tuple]) -> dict:
        keys, n, terms, tf = zip(*part, strict=True)
        own = Shard(lengths(np.array(n, np.int64), docs, words), np.array([len(t) // 4 for t in terms], np.int64), np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(tf), "<i4"), width)
        return {"keys": [[*keys]]} | own.block(weight).stored()

    def work(batches):
        part: list[tuple] = []
        for batch in batches:
            part += zip(*[batch.column(c).to_pylist() for c in ("key", "n_words", "terms", "tf")], strict=True)
            while len(part) >= most:
                yield shard(part[:most])
                part = part[most:]
        if part:
            yield shard(part)

    order = ["near", "nearer", "tie"]
    near = rows.where("length(terms) > 0").withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return batches_of(near.select("key", "n_words", "terms", "tf"), work, INDEX.format(key=type_of(rows, "key")))


# --- search ---------------------------------------------------------------------------------------------------


def best_of(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], width: int, top: int = TOP) -> DataFrame:
    """item, key and score of each query's best documents in each partition of the index; ties by key, null keys last."""

    def work(batches):
        best: list[list[tuple]] = [[] for _ in queries]
        asked = [(terms, weight) for _, terms, weight in queries]
        for batch in batches:
            for row in batch.to_pylist():
                own = Shard.read(row, width)
                floors = [-b[-1][0] if len(b) == top else 1 for b in best]
                for q, docs, scores, _ in own.search(asked, floors):
                    if len(docs):
                        new = [(-s, row["keys"][d] is None, row["keys"][d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                        best[q] = sorted(best[q] + new)[:top]
        for (item, _, _), rows in zip(queries, best, strict=True):
            if rows:
                yield {"item": [item] * len(rows), "key": [k for _, _, k in rows], "score": [-s for s, _, _ in rows]}

    kind = index.schema["keys"].dataType.elementType.simpleString()
    return batches_of(index, work, f"item long, key {kind}, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Each item's `top` documents with the highest scores above 0: item, rank (from 1), key and score; equal scores by key, null keys last.

    Terms, weights and scores are whole numbers as in lengths(), term_weights() and impacts(), over all documents with
    a term. Every row of docs is a document and every row of items an item of its own: repeated rows and keys, and null
    ones, count as often as they stand there. Null texts have no terms; items whose terms no document has get no rows,
    and so do all if either table is empty. Other columns are ignored. The index holds the terms that the items have;
    items are searched in batches of about `query_rows` rows of (item, term), and each batch reads the documents once.
    """
    if top > TOP:
        raise ValueError(f"at most {TOP} documents an item")
    named = materialize(key_text(items, item, item_text).withColumn("item", F.monotonically_increasing_id()), "items")
    asked = materialize(item_terms(named.select("item", "text")), "item_terms")
    batches = -(-asked.count() // query_rows)
    out = []
    for b in range(batches):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == b).orderBy("item").collect()  # query_rows on average, as said above
        words = sorted({bytes(r["term"]) for r in part})
        number = {w: k for k, w in enumerate(words)}
        rows = materialize(forward(key_text(docs, key, text), Vocabulary(words)), "forward")
        df, n, total = statistics(rows, len(words))
        weight = term_weights(df, n)
        terms: dict[int, tuple[list, list]] = {}
        for r in part:
            t = number[bytes(r["term"])]
            own = terms.setdefault(r["item"], ([], []))
            own[0].append(t)
            own[1].append(r["n"] * int(weight[t]))
        queries = [(k, np.array(t), np.array(w, np.int64)) for k, (t, w) in terms.items()]
        out.append(best_of(materialize(build(rows, weight, n, total), "index", **SMALL_GROUPS), queries, len(words), top))
    if not out:
        found = key_text(docs, key, text).limit(0).select(F.lit(0).cast("long").alias("item"), "key", F.lit(0).cast("long").alias("score"))
    else:
        found = out[0]
        for more in out[1:]:
            found = found.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(named.select("item", F.col("key").alias("__item")), "item").select(F.col("__item").alias(item), "rank", F.col("key").alias(key), "score")
