"""Operators 2 and 4 as Spark jobs: exact token counts at prefixes, and byte-level encoding and decoding."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.bpe import PrefixCounts, load
from isotherm.llm.common import key_text, per_batch, texts, type_of


def token_counts(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", budgets: tuple[int, ...] = (1024,), prefixes: bool = False) -> DataFrame:
    """Exact token counts of every text, from the counts stored at its prefixes.

    Returns key, n_bytes, n_tokens, for each budget b `cut_b` (the most characters, as a prefix, that have at
    most b tokens), and with prefixes=True the array counts: the tokens of the first 0, 1, ... and of all characters.
    A null or empty text has 0 bytes and tokens. Rows are neither added nor lost: repeated and null keys,
    and equal texts, each give a row. Columns other than key and text are ignored. Very long texts, and very long
    runs without white space, take time in proportion to their length.
    """
    schema = f"key {type_of(df, key)}, n_bytes long, n_tokens long" + "".join(f", cut_{b} long" for b in budgets) + ", counts array<long>" * prefixes

    def work(batch):
        bpe, rows = load(path, pattern), texts(batch)
        out = {"key": batch.column("key"), "n_bytes": [], "n_tokens": []} | {f"cut_{b}": [] for b in budgets} | {"counts": []}
        for t, spread in zip(rows, bpe.spread(rows, counts=True), strict=True):
            counts = PrefixCounts(bpe, t, spread)
            out["n_bytes"].append(len(counts.inner))
            out["n_tokens"].append(counts.total)
            for b in budgets:
                out[f"cut_{b}"].append(counts.cut(b))
            if prefixes:
                out["counts"].append(counts.every())
        return out

    return per_batch(key_text(df, key, text), work, schema).withColumnRenamed("key", key)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and ids (binary: little-endian unsigned 32-bit) of every text; null and empty texts have none.

    Special strings inside texts are ordinary text for .tiktoken files. One row per row of df.
    """

    def work(batch):
        rows, ids = texts(batch), []
        for _, _, found in load(path, pattern).spread(rows):
            ids.append(found.astype("<u4").tobytes())
        return {"key": batch.column("key"), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    return per_batch(key_text(df, key, text), work, f"key {type_of(df, key)}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the bytes of every row's ids (binary, as encode() gives them); null ids have no bytes."""

    def work(batch):
        bpe = load(path, pattern)
        return {"key": batch.column("key"), "bytes": [bpe.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]}

    return per_batch(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids")), work, f"key {type_of(df, key)}, bytes binary").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and the digests of a text's ids and of the bytes they decode to, in one pass in which ids stay in the task."""

    def work(batch):
        bpe = load(path, pattern)
        out = {"key": batch.column("key"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for _, _, ids in bpe.spread(texts(batch)):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
        return out

    return per_batch(key_text(df, key, text), work, f"key {type_of(df, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
