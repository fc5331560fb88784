"""Operator 13: importance resampling towards a target distribution of hashed n-grams, drawn by a distributed quickselect.

A run of words is worth what it says for the target: log of the ratio of its bucket's shares there and here. A
document's weight is the sum over its runs, looked up in an array. With Gumbel noise, a hash of the key, the highest
scores are a draw without replacement; the k-th highest is found by counting, and only what lies above it is sorted.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import batches_of, clear, key_text, mark, materialize, per_batch, type_of
from isotherm.llm.words import Crc, Split
from isotherm.operators.numbering import numbered

BUCKETS, SEED, SHARE, LEAST_WORDS = 10_000, 42, 5, 20
#: Words whose runs are hashed at once, and pivots of a round.
STEP, PIVOTS = 1 << 17, 24


def hashed_runs(split: Split, buckets: int):
    """For steps of words: the first and last word, and for n of 1, 2 and 3 the buckets of the runs that begin there, -1 for runs over a row's end."""
    for a in range(0, len(split), STEP):
        b = min(a + STEP, len(split))
        out = []
        for n, crc in enumerate(Crc.runs(split, a, b)):
            bucket = (crc % np.uint32(buckets)).astype(np.int32)
            bucket[split.row[a : a + len(bucket)] != split.row[a + n : a + n + len(bucket)]] = -1
            out.append(bucket)
        yield a, b, out


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features occur in all texts. Partitions' arrays are added up by bucket; the driver gets one number for each bucket."""

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, runs in hashed_runs(Split(batch.column("text")), buckets):
                for r in runs:
                    total += np.bincount(r[r >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield {"bucket": some, "n": total[some]}

    out = np.zeros(buckets, np.int64)
    for bucket, n in batches_of(df.select(F.col(f"`{text}`").cast("string").alias("text")), work, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: 1000 times the log of the ratio of its shares, one feature of each bucket added to both, rounded down."""
    s, t, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((y + 1) * (s + buckets) / ((x + 1) * (t + buckets)))) for x, y in zip(map(float, source), map(float, target), strict=True)], np.int64)


def noise(key: object, seed: int = SEED) -> int:
    """1000 times a Gumbel variate that the key's hash gives, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """key, n_words, n_features, weight and score of every row."""

    def work(batch):
        split = Split(batch.column("text"))
        total = np.zeros(batch.num_rows, np.int64)
        for a, b, runs in hashed_runs(split, len(gain)):
            own = np.zeros(b - a, np.int64)
            for r in runs:
                own[: len(r)] += np.where(r >= 0, gain[r], 0)
            # sums of each row's part of this step
            rows, at = np.unique(split.row[a:b], return_index=True)
            total[rows] += np.add.reduceat(own, at)
        n = np.diff(split.first)
        keys = batch.column("key").to_pylist()
        return {"key": batch.column("key"), "n_words": n, "n_features": n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0), "weight": total, "score": total + np.array([noise(k, seed) for k in keys], np.int64)}

    return per_batch(key_text(df, key, text), work, f"key {type_of(df, key)}, n_words long, n_features long, weight long, score long")


#: The order of the draw: a struct of these is smaller for what is drawn first, and no two rows have the same.
ORDER = ("down", "nameless", "key", "tie")


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest struct of ORDER's columns: its values; None for k below 1. k must not be over the number of rows.

    Each round takes pivots from the rows that are left, those with the smallest hashes, and counts exactly how many
    rows lie between them and on them. The k-th lies on a pivot, which ends the search, or between two, whose rows are
    all that is left. As pivots are rows, each round leaves fewer; at random each leaves a small share.
    """
    if k < 1:
        return None
    kinds, begun, turn = dict(rows.dtypes), mark(), 0
    left = rows.select(*ORDER)
    own = F.struct(*ORDER)

    def fixed(pivot) -> Column:
        return F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(ORDER, pivot, strict=True)])

    while True:
        turn += 1
        taken = left.orderBy(F.xxhash64("tie", F.lit(turn)), "tie").limit(pivots).orderBy(*ORDER).collect()
        steps = [fixed(p) for p in taken]
        below = F.size(F.filter(F.array(*steps), lambda p: p < own))  # pivots under a row
        on = F.exists(F.array(*steps), lambda p: p == own).cast("int")
        counts = dict(left.groupBy((below * 2 + on).alias("part")).count().collect())  # a row for each pivot and gap
        for part in sorted(counts):
            if k <= counts[part]:
                break
            k -= counts[part]
        if part % 2:
            clear(rows.sparkSession, begun)
            return tuple(taken[part // 2])
        at = part // 2
        inside = F.lit(True) if at == 0 else own > steps[at - 1]
        inside = inside if at == len(steps) else inside & (own < steps[at])
        left = materialize(left.where(inside), "between")
        clear(rows.sparkSession, begun, keep=1)


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """key, n_features, weight, score and rank of every row of df; rank is 1, 2, ... for the drawn rows, else null.

    Of the N rows with at least `least_words` words, floor(share x N / 100) are drawn, highest scores first, ties to
    the smaller key, null keys last, then in any order (such rows differ in nothing but their texts). Features are runs
    of one to three words, hashed into buckets that are counted over all rows of df and of target, however many they
    are. Null texts have no words; a text without words weighs 0. A null key's noise is that of an empty text. Rows are
    neither added nor lost. Empty tables give empty ones, an empty target weighs features against an even spread. Other
    columns are ignored.
    """
    gain = gains(bucket_counts(df, text, buckets), bucket_counts(target, target_text, buckets))
    named = weighed(df, gain, key, text, seed).withColumns({"down": -F.col("score"), "nameless": F.col("key").isNull(), "tie": F.monotonically_increasing_id()})
    scored = materialize(named, "scored")
    able = scored.where(F.col("n_words") >= least_words)
    last = kth_key(able, share * able.count() // 100)
    out = [F.col("key").alias(key), "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    bound = F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(ORDER, last, (dict(scored.dtypes)[c] for c in ORDER), strict=True)])
    drawn = (F.col("n_words") >= least_words) & (F.struct(*ORDER) <= bound)
    winners = numbered(scored.where(drawn), [F.col(c) for c in ORDER], "rank").select(*out, F.col("rank").cast("long").alias("rank"))
    return scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(winners)
