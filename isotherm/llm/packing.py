"""Operator 5: lexical retrieval packing. Sequences of a fixed length, each filled with a seed's BM25 neighbours."""

from __future__ import annotations

import functools
import json
import math
import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.bpe import PrefixBPE, byte_letters
from isotherm.llm.common import batches_of, key_text, materialize, slabs, tree_sum, type_of
from isotherm.llm.pieces import PieceCoder

LENGTH = 2048
SHARD = 2_000_000  # tokens in a shard of the inverted index, on average
K1, B = 1.2, 0.75
CELLS = 1 << 23  # numbers of a shard's frequent postings
#: White space, or what could be taken for it, other than the six ASCII ones: such texts are encoded whole.
ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")


class Words:
    """A tokenizers file of the kind with word ends: lower case, white space dropped, so each piece is encoded for itself.

    Pieces are split and looked up in numpy (pieces.py), and new ones encoded many at a time by the prefix dynamic
    programming of bpe.py, a word's end being a byte that UTF-8 never has. Texts with odd white space go to the
    tokenizers library whole, and words with special strings, or that composing may change, one by one.
    """

    END = b"\xff"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = vocabulary_size(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, mark = byte_letters(), spec["model"]["end_of_word_suffix"]
        ranks = {}
        for t, k in spec["model"]["vocab"].items():
            data = bytes(letters[c] for c in t.removesuffix(mark))
            if self.END not in data:
                ranks[data + self.END if t.endswith(mark) else data] = k
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.bpe = PrefixBPE(ranks, pattern)
        self.coder = PieceCoder(self.bpe.batch, self.hard, words=True)

    def hard(self, data: bytes) -> np.ndarray:
        """Ids of a word that is not split by classes of bytes."""
        word = data.decode("utf-8", "surrogatepass")
        if not unicodedata.is_normalized("NFC", word) or "\u03a3" in word or "<|" in word or not unicodedata.is_normalized("NFC", word.lower()):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32)
        pieces = [p.encode() + self.END for p in self.bpe.find(word.lower())]
        return np.concatenate([np.array(self.bpe.ids_back(len(p), self.bpe.last_tokens(p)[0]), np.uint32) for p in pieces] or [np.empty(0, np.uint32)])

    def ids(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text (no special tokens added), then `end`."""
        odd = [ODD_SPACE.search(t) is not None for t in texts]
        out, last = [], np.array([end], np.uint32)
        for t, whole, (_, _, ids) in zip(texts, odd, self.coder.of_texts([b"" if x else t.encode("utf-8", "surrogatepass") for t, x in zip(texts, odd, strict=True)]), strict=True):
            out.append(np.concatenate([self.tokenizer.encode(t, add_special_tokens=False).ids if whole else ids, last]).astype("<u4"))
        return out


@functools.lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path)


def vocabulary_size(path: str) -> int:
    """Ids of a tokenizers file, added tokens included, without loading its coder."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(own: DataFrame, path: str, end: int, length: int) -> DataFrame:
    """Each document's full sequences as pieces, what is left of it with its ids, and the partition's document frequencies.

    kind 0: a piece, a sequence of its own. kind 1: a remainder, with ids (unsigned 16 or 32 bits) and two minima of
    hashes over its distinct ids, which lie near each other for texts with the same words. kind 2: frequencies.
    """
    names = ("kind", "key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "near", "nearer", "part", "slab", "data")

    def rows(n, **cols):
        return {c: cols.get(c, [None] * n) for c in names} | {"kind": cols["kind"]}

    def work(batches):
        from pyspark import TaskContext

        coder, serial = words_of(path), TaskContext.get().partitionId() << 32
        small = coder.vocabulary <= 1 << 16
        salt = np.random.default_rng(11).integers(0, 1 << 62, (2, coder.vocabulary))
        frequency = np.zeros(coder.vocabulary, np.int64)
        for b in batches:
            keys, texts = b.column("key").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for begin in range(0, len(keys), 256):
                out: dict[str, list] = {c: [] for c in names}
                for key, ids in zip(keys[begin : begin + 256], coder.ids(texts[begin : begin + 256], end), strict=True):
                    distinct = np.unique(ids)
                    frequency[distinct] += 1
                    full = len(ids) // length * length
                    for at in range(0, full, length):
                        for c, v in zip(names, (0, key, at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids), 2 * serial + 1, 0, None, None, None, None, None, None), strict=True):
                            out[c].append(v)
                        serial += 1
                    if full < len(ids):
                        rest = ids[full:]
                        near = salt[:, np.unique(rest) if full else distinct].min(axis=1).tolist()
                        for c, v in zip(names, (1, key, full, len(rest), None, len(ids), None, None, rest.astype("<u2" if small else "<u4").tobytes(), *near, None, None, None), strict=True):
                            out[c].append(v)
                yield out
        for x in slabs(frequency):
            yield rows(1, kind=[2], **x)

    schema = f"kind int, key {type_of(own, 'key')}, {PIECE}, ids binary, near long, nearer long, part int, slab int, data binary"
    return batches_of(own, work, schema)


class Shard:
    """An inverted index of remainders. Scores are BM25 with the whole corpus's frequencies."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, docs, weights = [], [], []
        for k, x in enumerate(ids):
            t, tf = np.unique(x, return_counts=True)
            terms.append(t)
            docs.append(np.full(len(t), k))
            weights.append(idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean)))
        self.of = terms
        self.names, flat = np.unique(np.concatenate(terms), return_inverse=True)
        order = np.argsort(flat, kind="stable")
        docs, weights, count = np.concatenate(docs)[order], np.concatenate(weights)[order], np.bincount(flat, minlength=len(self.names))
        # postings of terms that many remainders have stand as whole rows, with zeros, in CELLS numbers at most
        often = count > max(len(ids) / 12, np.sort(count)[-min(len(count), max(1, CELLS // len(ids)))] - 0.5)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        held = np.repeat(often, count)
        self.rows = np.zeros((int(often.sum()), len(ids)), np.float32)
        self.rows[np.repeat(self.row, count)[held], docs[held]] = weights[held]
        self.docs, self.weights, self.count = docs[~held], weights[~held], np.where(often, 0, count)
        self.start = np.cumsum(self.count) - self.count

    def scores(self, k: int) -> np.ndarray:
        """Of all remainders, for the distinct terms of remainder k."""
        t = np.searchsorted(self.names, self.of[k])
        many = self.count[t]
        at = np.repeat(self.start[t] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        rows = self.row[t]
        return np.bincount(self.docs[at], self.weights[at], len(self.of)) + self.rows[rows[rows >= 0]].sum(axis=0)


def fill(ids: list[np.ndarray], idf: np.ndarray, mean: float, length: int):
    """(sequence, offset, document, from, to) of each piece. A seed's unused neighbours, best first, fill its sequence.

    The last one is cut where the sequence is full, and what is left of it is the next seed; else the first unused
    document is. Only the last sequence is not full. Equal scores go by the order of ids.
    """
    if not ids:
        return
    shard = Shard(ids, idf, mean)
    free, begin, nxt, seed, sequence = np.ones(len(ids), bool), [0] * len(ids), 0, None, 0
    while True:
        if seed is None:
            while nxt < len(ids) and not free[nxt]:
                nxt += 1
            if nxt == len(ids):
                return
            seed = nxt
        scores, room, queue, rest = shard.scores(seed), length, [seed], None
        free[seed] = False
        while room:
            if not queue:
                left = np.flatnonzero(free)
                if not len(left):
                    break
                s = scores[left]
                if len(left) > 64:  # the best first; more of them if they do not fill the sequence
                    least = -np.partition(-s, 63)[63]
                    left, s = left[s >= least], s[s >= least]
                queue = left[np.argsort(-s, kind="stable")].tolist()
            k = queue.pop(0)
            free[k] = False
            n = min(room, len(ids[k]) - begin[k])
            yield sequence, length - room, k, begin[k], begin[k] + n
            room, begin[k] = room - n, begin[k] + n
            if begin[k] < len(ids[k]):
                rest = k
        seed, sequence = rest, sequence + 1


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = 1, shard: int = SHARD) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset: every id of every document in one piece of one sequence.

    A document's ids end with `end`, so null and empty texts have one id. Sequences a document fills alone are its
    own; what is left of documents goes to shards of about `shard` tokens, in the order of their words' hashes, keys
    and starts, each with its inverted index. Only a shard's last sequence needs padding. Null keys and repeated rows
    are documents like others; other columns are ignored; an empty table gives an empty one.
    """
    own = key_text(df, key, text)
    parts = materialize(cut(own, path, end, length), "pieces")
    counted = parts.where("kind = 1").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).first()
    documents = parts.where("kind < 2 and start = 0").count()
    size = vocabulary_size(path)
    frequency = tree_sum(parts.where("kind = 2").select("part", "slab", "data"), size, np.int64)
    idf = df.sparkSession.sparkContext.broadcast(np.log1p((documents - frequency + 0.5) / (frequency + 0.5)))  # as many numbers as the vocabulary has ids
    mean, small = (counted["tokens"] or 1) / max(1, counted["n"]), size <= 1 << 16

    def work(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        cols: dict[str, list] = {c: [] for c in ("key", "start", "doc_tokens", "ids")}
        for b in batches:
            for c in cols:
                cols[c] += b.column(c).to_pylist()
        ids = [np.frombuffer(x, "<u2" if small else "<u4").astype("<u4") for x in cols.pop("ids")]
        out: dict[str, list] = {c: [] for c in ("key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        for sequence, offset, k, a, b in fill(ids, idf.value, mean, length):
            for c, v in zip(out, (cols["key"][k], cols["start"][k] + a, b - a, zlib.crc32(ids[k][a:b].tobytes()), cols["doc_tokens"][k], 2 * (first + sequence), offset), strict=True):
                out[c].append(v)
        yield out

    schema = f"key {type_of(own, 'key')}, {PIECE}"
    left = parts.where("kind = 1").select("key", "start", "doc_tokens", "ids", "near", "nearer")
    n = max(1, math.ceil((counted["tokens"] or 0) / shard))
    dealt = left.repartitionByRange(n, "near", "nearer", "key", "start").sortWithinPartitions("near", "nearer", "key", "start", "ids")
    packed = batches_of(dealt, work, schema)
    names = [c.split()[0] for c in schema.split(", ")]
    return parts.where("kind = 0").select(names).unionByName(packed).withColumnRenamed("key", key)
