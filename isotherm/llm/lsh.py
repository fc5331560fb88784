"""Operator 7: nearest neighbours by multiprobe p-stable hashing, largest inner products first."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import batches_of, materialize, type_of

BLOCK, ASKING = 1024, 4096  # rows of candidates, and of queries, in a task's group
BUCKET = 1200  # vectors in a bucket on average, by the number of hash functions
WIDTH = 1.35  # of a slot, in deviations of a projection
SAMPLE = 20_000  # vectors, and 256 queries among them, that the neighbours' nearness is estimated on
RATIO = math.sqrt(2)  # of the lengths in a class, which has its own scale and hash functions
CLASSES = 24  # of lengths; the last one has all that are shorter
ROUGH = 2e-5  # of both lengths' product: more than products of 32-bit floats are wrong by
PAIRS = 1 << 18  # scored at once
LEAST = 1e-150  # of lengths, against the longest, whose component is about 1: all that are shorter are alike
HELD, FRESH = 1_000_000, 100_000  # answers that a task holds, and new ones before it keeps the best of each query only


class Hashes:
    """Tables of p-stable (Gaussian) hash functions floor((a.x + b) / width) of vectors on the unit sphere.

    For inner products, vectors get one more coordinate that brings all of them to the length of the longest,
    and queries a zero: then the largest inner product is the least distance. `lift` is that coordinate's mean and
    variance, and `near` the inner product of a neighbour, as lifted, with a query.
    """

    def __init__(self, dims: int, longest: float, near: float, functions: int, tables: int, seed: int = 7, lift: tuple[float, float] = (0.0, 0.0), kind: int = 0):
        rng = np.random.default_rng(seed)
        self.longest, self.tables, self.functions, self.lift, self.kind = longest, tables, functions, lift, kind
        self.near = min(near, 0.98 * math.sqrt(max(0.0, 1 - lift[0] ** 2)))
        self.a = rng.standard_normal((tables, dims + 1, functions))
        self.b = rng.uniform(0, WIDTH, (tables, functions))

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        size = np.sqrt((x * x).sum(axis=1))
        if query:
            return np.hstack([x / np.maximum(size, LEAST)[:, None], np.zeros((len(x), 1))])
        return np.hstack([x / self.longest, np.sqrt(np.maximum(0, 1 - (size / self.longest) ** 2))[:, None]])

    def slots(self, x: np.ndarray, table: int) -> np.ndarray:
        return np.floor((self.lifted(x, False) @ self.a[table] + self.b[table]) / WIDTH).astype(np.int64)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        return codes(self.slots(x, table), self.kind)

    def probes(self, q: np.ndarray, table: int, success: float) -> list[np.ndarray]:
        """Each query's buckets in the order of estimated success, until their sum reaches `success`.

        A neighbour with inner product `near` to a query has projections around near times the query's plus what
        the lifting coordinate adds, which is the same function's for all vectors; their variance is what both leave
        of 1, and the lifting coordinate's own. That gives each slot a chance, and each bucket the product of its slots'.
        """
        at, up = self.lifted(q, True) @ self.a[table], self.a[table][-1]
        mean, variance = self.lift
        middle = self.near * at + mean * up + self.b[table]
        spread = np.sqrt(np.maximum(1e-6, 1 - self.near**2 - mean**2 - variance) + up**2 * variance)[:, None]
        reach = math.ceil(4 * spread.max(initial=0) / WIDTH) + 1
        slot = np.floor(middle / WIDTH).astype(np.int64)[:, :, None] + np.arange(-reach, reach + 1)
        edge = (np.concatenate([slot, slot[:, :, -1:] + 1], axis=2) * WIDTH - middle[:, :, None]) / spread
        chance = np.diff(normal(edge), axis=2)
        out = []
        for s, p in zip(slot, chance, strict=True):
            least = 1e-2
            while True:
                code, product = np.zeros((1, 0), np.int64), np.ones(1)
                rest = np.append(np.cumprod(p.max(axis=1)[::-1])[::-1], 1.0)[1:]  # the most that later functions leave
                for k in range(self.functions):
                    both = product[:, None] * p[k]
                    i, j = np.nonzero(both * rest[k] >= least)
                    code, product = np.hstack([code[i], s[k][j][:, None]]), both[i, j]
                if product.sum() >= success or least < 1e-12:
                    break
                least /= 4
            order = np.argsort(-product, kind="stable")
            enough = int(np.searchsorted(np.cumsum(product[order]), success)) + 1
            out.append(codes(code[order[:enough]], self.kind))
        return out


def codes(slots: np.ndarray, kind: int = 0) -> np.ndarray:
    """One number for the slots of a bucket of a class of lengths."""
    out = np.full(len(slots), kind, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(slots.shape[1]):
            out = (out ^ slots[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    y = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - y, y)


def taking_part(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key (long) and v (array of doubles): vectors that are not null, not zero, finite, and as long as most are; keys not null."""
    own = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("key is not null and v is not null")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(finite & F.exists("v", lambda x: x != 0))
    usual = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("v") == (usual["n"] if usual else 0))


def exponent(v: str) -> Column:
    """The power of two in a vector's largest component."""
    return F.floor(F.log2(F.array_max(F.transform(v, lambda x: F.abs(x))))).cast("int")


def length_class(size: np.ndarray, longest: float) -> np.ndarray:
    return np.clip(np.floor(np.log(longest / np.maximum(size, LEAST)) / math.log(RATIO) + 1e-9), 0, CLASSES - 1).astype(np.int64)


class Classes:
    """Hash functions for each class of lengths: a class is lifted to its own longest, so that its buckets tell its vectors apart."""

    def __init__(self, dims: int, longest: float, counts: dict[int, int], sample: np.ndarray, k: int, tables: int):
        size = np.sqrt((sample * sample).sum(axis=1))
        near, kind = nearness(sample, sum(counts.values()), k), length_class(size, longest)
        self.longest, self.of = longest, {}
        for c, n in sorted(counts.items()):
            most = longest / RATIO**c
            lift = np.sqrt(np.maximum(0, 1 - (size[kind == c] / most) ** 2))
            moments = (float(lift.mean()), float(lift.var())) if len(lift) else (0.4, 0.04)
            functions = max(2, math.ceil(math.log(max(1.0, n / BUCKET)) / math.log(3)))
            self.of[c] = Hashes(dims, most, float(np.clip(near / most, 0.0, 0.98)), functions, tables, lift=moments, kind=c)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        kind, out = length_class(np.sqrt((x * x).sum(axis=1)), self.longest), np.zeros(len(x), np.int64)
        for c in np.unique(kind):
            # a length on a border may be in a class that is counted as the next
            out[kind == c] = self.of[min(self.of, key=lambda o: (abs(o - c), o))].buckets(x[kind == c], table)
        return out

    def probes(self, q: np.ndarray, table: int, success: float) -> list[np.ndarray]:
        """Each query's buckets in all classes."""
        found = [h.probes(q, table, success) for h in self.of.values()]
        return [np.concatenate(f) for f in zip(*found, strict=True)]


def nearness(sample: np.ndarray, rows: int, k: int) -> float:
    """A low estimate of the k-th largest inner product with a query of length 1 among `rows` vectors, from a sample of them."""
    if len(sample) < 3:
        return 0.0
    q = sample[: min(256, len(sample))]
    q = q[np.abs(q).max(axis=1) > LEAST]
    if not len(q):
        return 0.0
    s = (q / np.sqrt((q * q).sum(axis=1))[:, None]) @ sample.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    place = min(len(sample) - 2, max(0, math.ceil(k * len(sample) / max(1, rows)) - 1))
    kth = -np.partition(-s, place, axis=1)[:, place]
    return max(0.0, float(np.quantile(kth, 0.1)))


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, tables: int = 2, success: float = 0.82) -> DataFrame:
    """query_id, rank, vec_id, score: for each key divisible by `every` the k largest inner products with other keys' vectors, as found.

    Null, zero and non-finite vectors, vectors of another length than most, and null keys take no part. Equal
    scores go by the smaller key. Rows with one key are one name: their vectors all count, the best score stands.
    Fewer candidates than k give all of them: queries whose buckets had fewer than k, or than there are, probe again
    with a larger success, and those that still have too few are held against all vectors, in blocks. An empty table
    gives an empty one.

    Buckets are dealt out in blocks of candidates and of queries, so that a hot bucket is many small groups; each
    group finds k rows a query, and a task merges those of its groups before they are shuffled. The hash functions are fitted on a bounded sample (SAMPLE); all rows are indexed.
    Vectors are indexed in classes of lengths (RATIO), and every query probes all classes.

    Finite vectors of any size take part: before anything is squared, multiplied or cast, candidates are divided by the
    power of two of the table's largest component, queries by that of their own key's. That is exact, and so are
    scores, which are multiplied back at the end: what a double cannot hold becomes infinite or zero only there, and
    does not change the order.
    """
    own = taking_part(df, key, vector)
    largest_component = own.agg(F.max(exponent("v"))).first()[0]
    if largest_component is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shift = int(largest_component)
    halves = 2.0 ** (-(shift // 2)), 2.0 ** (-(shift - shift // 2))
    length = F.sqrt(F.aggregate(F.transform("v", lambda x: x * halves[0] * halves[1]), F.lit(0.0), lambda a, x: a + x * x))
    size = own.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest"), F.max(F.size("v")).alias("dims")).first()
    if not size["n"]:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = np.array([r["v"] for r in own.orderBy(F.xxhash64("key"), "key", "v").limit(SAMPLE).select("v").collect()], float)
    some = np.ldexp(some, -shift)
    kind = F.least(F.greatest(F.floor(F.log(size["longest"] / F.greatest(length, F.lit(LEAST))) / math.log(RATIO) + 1e-9), F.lit(0)), F.lit(CLASSES - 1)).cast("int")
    counts = {r["kind"]: r["count"] for r in own.groupBy(kind.alias("kind")).count().collect()}
    hashes = df.sparkSession.sparkContext.broadcast(Classes(size["dims"], size["longest"], counts, some, k, tables))
    dims = size["dims"]

    # vectors travel in their own precision
    stored = np.dtype("<f4" if type_of(df, vector) == "array<float>" else "<f8")

    def arrays(batch) -> np.ndarray:
        return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def binary(x: np.ndarray) -> list[bytes]:
        return [r.tobytes() for r in x.astype(stored)]

    def index(batches):
        for b in batches:
            if b.num_rows:
                x, keys = arrays(b), b.column("key").to_pylist()
                data = binary(x)
                x = np.ldexp(x, -shift)
                for t in range(tables):
                    yield {"t": [t] * len(keys), "bucket": hashes.value.buckets(x, t), "key": keys, "data": data}

    def probe(level):
        def work(batches):
            for b in batches:
                x, keys = (np.ldexp(arrays(b), -b.column("scale").to_numpy()[:, None]), b.column("key").to_pylist()) if b.num_rows else ([], [])
                for begin in range(0, len(keys), 256):
                    part = x[begin : begin + 256]
                    for t in range(tables):
                        found = hashes.value.probes(part, t, level)
                        many = [len(f) for f in found]
                        yield {"t": [t] * sum(many), "bucket": np.concatenate(found), "key": np.repeat(keys[begin : begin + 256], many)}

        return work

    def packed(batches):
        for b in batches:
            if b.num_rows:
                yield {c: b.column(c).to_pylist() for c in ("key", "t", "bucket", "scale")} | {"data": binary(arrays(b))}

    index_rows = materialize(batches_of(own, index, "t int, bucket long, key long, data binary"), "lsh-index")
    group = ["t", "bucket", "block", "part"]

    def met(asked: DataFrame, level: float | None) -> DataFrame:
        """Candidates and questions of each group; without a level all vectors are one bucket."""
        if level is None:
            rows, wanted = index_rows.where("t = 0").withColumn("bucket", F.lit(0).cast("long")), asked.select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("bucket"), "key").distinct()
        else:
            rows, wanted = index_rows, materialize(batches_of(asked, probe(level), "t int, bucket long, key long"), "lsh-probes")
        blocks = rows.groupBy("t", "bucket").agg(F.floor((F.count(F.lit(1)) - 1) / BLOCK).cast("int").alias("last"))
        chunks = wanted.groupBy("t", "bucket").agg(F.floor((F.count(F.lit(1)) - 1) / ASKING).cast("int").alias("parts"))
        shape = materialize(blocks.join(chunks, ["t", "bucket"]), "lsh-shapes")
        place = [F.xxhash64("key", "t").alias("own")]
        vectors = asked.select("key", "v", "scale").join(wanted, "key")
        candidates = rows.select("*", *place).join(shape, ["t", "bucket"]).select("t", "bucket", F.pmod("own", F.col("last") + 1).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts"))).alias("part"), "key", F.lit(False).alias("asks"), F.lit(shift).alias("scale"), "data")
        questions = batches_of(vectors.select("key", "t", "bucket", "scale", "v"), packed, "key long, t int, bucket long, scale int, data binary").select("*", *place).join(shape, ["t", "bucket"])
        questions = questions.select("t", "bucket", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), F.pmod("own", F.col("parts") + 1).cast("int").alias("part"), "key", F.lit(True).alias("asks"), "scale", "data")
        return candidates.unionByName(questions).repartition(*group).sortWithinPartitions(*group)

    def largest(q, v, score):
        """The k best keys of each query, each with its best score."""
        order = np.lexsort((-score, v, q))
        q, v, score = q[order], v[order], score[order]
        if len(q):
            once = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))
            q, v, score = q[once], v[once], score[once]
        order = np.lexsort((v, -score, q))
        q, v, score = q[order], v[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], v[keep], score[keep]

    class Best:
        """A task's best answers so far; `least` is each query's k-th score, which new answers have to reach."""

        def __init__(self):
            self.held, self.fresh, self.names, self.kth = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], [], np.empty(0, np.int64), np.empty(0)

        def least(self, q):
            if not len(self.names):
                return np.full(len(q), -np.inf)
            at = np.minimum(np.searchsorted(self.names, q), len(self.names) - 1)
            return np.where(self.names[at] == q, self.kth[at], -np.inf)

        def add(self, *found):
            self.fresh.append(found)
            if sum(len(f[0]) for f in self.fresh) > FRESH:
                self.settle()

        def settle(self):
            self.held = list(largest(*(np.concatenate([self.held[c], *(f[c] for f in self.fresh)]) for c in range(3))))
            self.fresh = []
            self.names, first, many = np.unique(self.held[0], return_index=True, return_counts=True)
            self.kth = np.where(many == k, self.held[2][first + many - 1], -np.inf)

    def answer(best, keys, x, asks):
        """Score a group's queries against its candidates: roughly in 32 bits, and exactly what can be among the k best."""
        q, qk, x, xk = x[asks], keys[asks], x[~asks], keys[~asks]
        if not len(q) or not len(x):
            return
        rough = q.astype(np.float32) @ x.astype(np.float32).T
        own = np.argsort(xk, kind="stable")
        low, high = np.searchsorted(xk[own], qk), np.searchsorted(xk[own], qk, side="right")
        same = np.flatnonzero(high > low)
        for i in same.tolist():
            rough[i, own[low[i] : high[i]]] = -np.inf
        slack = (max(ROUGH, dims * 2.0**-23) * np.sqrt((q * q).sum(axis=1)) * math.sqrt(float((x * x).sum(axis=1).max()))).astype(np.float32)
        least = best.least(qk)
        new = np.flatnonzero(np.isinf(least))
        if len(new) and len(x) > k:
            # a key with several vectors counts once among the k
            first = np.flatnonzero(np.append(True, xk[own][1:] != xk[own][:-1]))
            most = rough[new] if len(first) == len(xk) else np.maximum.reduceat(rough[new][:, own], first, axis=1)
            place = min(k, most.shape[1]) - 1
            least[new] = -np.partition(-most, place, axis=1)[:, place] - slack[new]
        i, j = np.nonzero((rough >= (least - slack).astype(np.float32)[:, None]) & (rough > -np.inf))
        for a in range(0, len(i), PAIRS):
            p, o = i[a : a + PAIRS], j[a : a + PAIRS]
            # the same sum for equal vectors, wherever they stand
            best.add(qk[p], xk[o], (q[p] * x[o]).sum(axis=1))

    def answers(batches):
        best = Best()
        for keys, x, asks in groups(batches):
            answer(best, keys, x, asks)
            if len(best.held[0]) > HELD:
                best.settle()
                yield dict(zip(("query_id", "vec_id", "score"), best.held, strict=True))
                best = Best()
        best.settle()
        if len(best.held[0]):
            yield dict(zip(("query_id", "vec_id", "score"), best.held, strict=True))

    def groups(batches):
        """key, vectors and asks of each group, which are runs of rows."""
        last, parts = None, []

        def whole():
            return tuple(np.concatenate([p[c] for p in parts]) for c in range(3))

        for b in batches:
            if not b.num_rows:
                continue
            of = np.stack([b.column(c).to_numpy().astype(np.int64) for c in group], axis=1)
            column = b.column("data")
            x = np.frombuffer(column.buffers()[2], stored)[column.offset * dims : (column.offset + len(column)) * dims].reshape(-1, dims).astype(float)
            x = np.ldexp(x, -b.column("scale").to_numpy()[:, None])
            keys, asks = b.column("key").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            starts = np.append(0, np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1)
            for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
                now = of[begin].tolist()
                if now != last:
                    if parts:
                        yield whole()
                    last, parts = now, []
                parts.append((keys[begin:end], x[begin:end], asks[begin:end]))
        if parts:
            yield whole()

    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    enough = min(k, own.select("key").distinct().count() - 1)
    asked, out = own.where(F.col("key") % every == 0), None
    scales = materialize(asked.groupBy("key").agg(F.max(exponent("v")).alias("scale")), "lsh-scales")  # one for all vectors of a key
    asked = asked.join(scales, "key")

    def unscaled(found: DataFrame) -> DataFrame:
        """Scores of the vectors as they came: three exact factors, as one could be beyond what a double holds."""
        n = F.col("scale") + shift
        third = F.floor(n / 3).cast("int")
        factor = lambda x: F.pow(F.lit(2.0), x.cast("double"))
        back = F.col("score") * factor(third) * factor(third) * factor(n - third - third)
        return found.join(scales.withColumnRenamed("key", "query_id"), "query_id").select("query_id", "rank", "vec_id", back.alias("score"))

    for level in (success, 1 - (1 - success) / 8, None):
        found = batches_of(met(asked, level), answers, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "lsh-found")
        if level is None:
            break
        whole = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough)
        short = materialize(asked.join(whole, F.col("key") == F.col("query_id"), "left_anti"), "lsh-short")
        done = found.join(whole, "query_id", "left_semi")
        out, asked = done if out is None else out.unionByName(done), short
        if enough <= 0 or short.isEmpty():
            return unscaled(out)
    return unscaled(out.unionByName(found))
