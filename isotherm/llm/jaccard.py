"""Operator 9: documents whose sets of word n-grams have a Jaccard similarity of 0.75 or more, joined by prefix trees.

The plan:

1. Every document gives its set's size and hash; documents with one set go on as one. Counts of all n-grams are
   kept in a table of fixed size, hashed. They order all n-grams globally, rare before frequent.
2. Two sets with that similarity share an n-gram among the first quarter of each. So each set gives the n-grams
   of its first quarter. Of two such sets, the first n-gram that they share is early in one of them: among the first
   seventh, as what follows it must hold six sevenths of the smaller set. Of the sets in which an n-gram is early
   the smallest is its hub, and all pairs meet at some hub. N-grams that are early in no set have none, so what only
   shares a common ending of the order, say notices with some words of their own, doesn't meet.
3. Each set goes to the hub that it shares most with. Sets that a bound from 4,096 parities shows to be similar to no
   other there stay out; of the others a trie finds links that connect what is
   similar, and components are made.
4. At all hubs whose sets are then in more than one component, the early sets outside the largest are joined with
   all, and the other sets outside it with the early ones of the largest. No pair is left out: both of a similar pair
   are at one hub, one of them early there, connected already or looked at here. Early sets that are unlike all the
   same, as n-grams from one pool dealt at random, still meet in blocks of about BLOCK.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import batches_of, key_text, materialize, slabs, tree_sum, type_of
from isotherm.operators.stars import components
from isotherm.llm.trie import linked, trie_join

N = 5
CELLS = 1 << 22  # of the table of counts
BLOCK = 256  # sets in a trie
MEMBERS = 1 << 19  # and their members, on average
BLOOM = 1 << 23  # bits
BITS = 4096  # of a set's parities
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        back = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for k, base in enumerate((_ODD, back)):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def word_hashes(text: str) -> np.ndarray:
    """Hash of each word: runs of bytes other than space and 9 to 13, A-Z lowered."""
    return words_in(text)[0]


def words_in(text: str) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() and the words' bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    up, back = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        return mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * _MIX[2]), end - begin


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The set, as ascending 64-bit hashes: the runs of n words, or all words as one if there are fewer, or nothing."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < n:
            total = np.uint64(len(words))
            for k in range(len(words)):
                total = total + words[k] * _MIX[k % 5] * np.uint64(2 * (k // 5) + 1)
            return mixed(np.array([total]) * np.uint64(3))
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total += words[k : k + len(total)] * (_MIX[k % 5] * np.uint64(2 * (k // 5) + 1))
        return np.unique(mixed(total))


def set_hash(members: np.ndarray) -> int:
    """Of a set; never 0 for one with members."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([np.add.reduce(mixed(members + _MIX[3])) + np.uint64(len(members))]))[0].astype(np.int64)) or 1


def parity_bits(members: np.ndarray) -> bytes:
    """A bit for each of BITS places: whether the set has an odd number of members there."""
    at = ((members >> np.uint64(20)) & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def cell(members: np.ndarray) -> np.ndarray:
    return (members >> np.uint64(42)).astype(np.int64)


def ordered(members: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set in the global order, and its n-grams' levels: by the level of frequency, then by hash."""
    level = levels[cell(members)]
    order = np.argsort(level, kind="stable")
    return members[order], level[order]


def signatures(own: DataFrame, n: int) -> DataFrame:
    """key, n, h and bits of each document (null without words), and rows with slabs of the partition's counts."""

    def work(batches):
        counts = np.zeros(CELLS, np.uint8)
        for b in batches:
            out: dict[str, list] = {"key": b.column("key").to_pylist(), "n": [], "h": [], "bits": []}
            for t in b.column("text").to_pylist():
                s = shingles(t, n)
                out["n"].append(len(s))
                out["h"].append(set_hash(s) if len(s) else None)
                out["bits"].append(parity_bits(s) if len(s) else None)
                at, many = np.unique(cell(s), return_counts=True)
                counts[at] = np.minimum(counts[at].astype(np.int64) + many, 255)
            k = len(out["n"])
            yield out | {"part": [None] * k, "slab": [None] * k, "data": [None] * k}
        for row in slabs(counts.astype(np.int32)):
            yield {"key": [None], "n": [None], "h": [None], "bits": [None]} | row

    return batches_of(own, work, f"key {type_of(own, 'key')}, n long, h long, bits binary, part int, slab int, data binary")


def levels_of(parts: DataFrame) -> tuple[np.ndarray, int]:
    """A level for each cell, and the first level that counts as frequent. As large at every input size: 4 MB.

    Most cells hold n-grams of one document each, and so counts around the mean. Levels tell counts apart by half
    deviations of that, and beyond 30 of them by the logarithm.
    """
    sums = tree_sum(parts, CELLS, np.int32)
    mean = max(1.0, float(np.median(sums)), float(sums.mean()) / 4)

    def level(x):
        x = x.astype(np.float32)
        z = np.maximum((x - mean) / np.sqrt(mean), -5.0)
        return np.minimum(np.where(z <= 30, np.round(2 * z) + 10, 70 + np.ceil(8 * np.log(np.maximum(z, 30) / 30))), 255).astype(np.uint8)

    return np.concatenate([level(x) for x in np.split(sums, 64)]), int(level(np.array([max(32.0, 3 * mean)]))[0])


def prefixes(own: DataFrame, levels, frequent: int, n: int) -> DataFrame:
    """token, h, hot, late: the first quarter of each set, of which similar sets share at least one, and whether it is past the first seventh."""

    def work(batches):
        for b in batches:
            token, h, hot, late, size = [], [], [], [], 0
            for t in b.column("text").to_pylist():
                s = shingles(t, n)
                if not len(s):
                    continue
                members, level = ordered(s, levels.value)
                k = len(s) - (3 * len(s) + 3) // 4 + 1
                token.append(members[:k].view(np.int64))
                h.append(np.full(k, set_hash(s), np.int64))
                hot.append(level[:k] >= frequent)
                late.append(7 * np.arange(k) > len(s))
                size += k
                if size > 200_000:
                    yield {"token": np.concatenate(token), "h": np.concatenate(h), "hot": np.concatenate(hot), "late": np.concatenate(late)}
                    token, h, hot, late, size = [], [], [], [], 0
            if token:
                yield {"token": np.concatenate(token), "h": np.concatenate(h), "hot": np.concatenate(hot), "late": np.concatenate(late)}

    return batches_of(own, work, "token long, h long, hot boolean, late boolean")


def stars(first: DataFrame) -> DataFrame:
    """hub, h, shared, early: the sets that share tokens with the smallest set that has them early, and whether they have one of these early, too.

    Rows are sorted by token, early ones first, and read as a stream. Tokens that the table of counts shows as frequent are dealt over
    many tasks, pass the stream with equal rows made one, and get their hubs by an aggregate joined back, which
    adaptive execution can split.
    """

    def work(batches):
        last = hub = seen = salted = lone = None
        for b in batches:
            token, h, hot, salt, late = (b.column(c).to_numpy(zero_copy_only=False) for c in ("token", "h", "hot", "salt", "late"))
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            new[0] = last is None or token[0] != last or salt[0] != salted
            repeat = np.zeros(len(token), bool)
            repeat[1:] = ~new[1:] & (h[1:] == h[:-1])
            repeat[0] = not new[0] and h[0] == seen
            at = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            hubs = np.where(at >= 0, h[np.maximum(at, 0)], 0 if hub is None else hub)
            none = np.where(at >= 0, late[np.maximum(at, 0)], bool(lone))  # the first row of its token is late
            last, hub, seen, salted, lone = token[-1], hubs[-1], h[-1], salt[-1], none[-1]
            keep = ~repeat & (hot | ((h != hubs) & ~none))
            if keep.any():
                yield {"token": token[keep], "hub": pa.array(hubs[keep], mask=hot[keep]), "h": h[keep], "late": late[keep]}

    salted = first.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("h"), F.lit(64))).otherwise(F.lit(0)).cast("int"))
    streamed = materialize(batches_of(salted.repartition("token", "salt").sortWithinPartitions("token", "salt", "late", "h"), work, "token long, hub long, h long, late boolean"), "tokens")
    hot = streamed.where("hub is null").select("token", "h", "late")
    least = materialize(hot.where("not late").groupBy(F.col("token").alias("t")).agg(F.min("h").alias("hub")), "hubs")
    hot = hot.join(least, hot["token"] == least["t"]).where("h <> hub").select("hub", "h", "late")
    return streamed.where("hub is not null").select("hub", "h", "late").unionByName(hot).groupBy("hub", "h").agg(F.count(F.lit(1)).alias("shared"), F.max(~F.col("late")).alias("early"))


def members_of(own: DataFrame, wanted: DataFrame, levels, n: int) -> DataFrame:
    """h, members (binary: levels and 48 bits of the hashes, in the global order) of the wanted sets, and of a few more.

    The wanted hashes are held in a Bloom filter of fixed size, so that most other sets stay where they are.
    """
    words = wanted.select(F.expr(f"h & {BLOOM - 1}").alias("x")).groupBy(F.expr("cast(x >> 6 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(x & 63 as int)))").alias("bits"))
    bits = np.zeros(BLOOM // 64, np.int64)
    for w, v in words.toLocalIterator():  # at most 131,072 rows
        bits[w] = v
    bloom = own.sparkSession.sparkContext.broadcast(bits)

    def work(batches):
        seen = set()  # a task gives each set once, however many documents have it
        for b in batches:
            h, packed, size = [], [], 0
            for t in b.column("text").to_pylist():
                s = shingles(t, n)
                if not len(s):
                    continue
                k = set_hash(s)
                x = k & (BLOOM - 1)
                if k in seen or not int(bloom.value[x >> 6]) >> (x & 63) & 1:
                    continue
                seen.add(k)
                members, level = ordered(s, levels.value)
                h.append(k)
                packed.append(pack(members, level))
                size += len(packed[-1])
                if size > 4_000_000:
                    yield {"h": h, "members": packed}
                    h, packed, size = [], [], 0
            if h:
                yield {"h": h, "members": packed}

    return batches_of(own, work, "h long, members binary")


def pack(members: np.ndarray, level: np.ndarray) -> bytes:
    """Seven bytes each: the level, then the upper 48 bits of the hash, big-endian."""
    out = np.empty((len(members), 7), np.uint8)
    out[:, 0] = level
    out[:, 1:] = (members >> np.uint64(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 1:] = raw
    return out.view(">u8").ravel().astype(np.int64)


GROUP = ["hub", "block", "part"]


def by_group(groups: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """work on each group's rows (lists of the columns), read as sorted runs: at most two blocks' sets each."""

    def run(batches):
        last, rows = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in (*GROUP, *columns)]
            for row in zip(*cols, strict=True):
                if row[:3] != last:
                    if rows:
                        yield from work(last, rows)
                    last, rows = row[:3], []
                rows.append(row[3:])
        if rows:
            yield from work(last, rows)

    return batches_of(groups.select(*GROUP, *columns).repartition(*GROUP).sortWithinPartitions(*GROUP, "h"), run, schema)


def screened(groups: DataFrame, bits: DataFrame) -> DataFrame:
    """The groups' sets that may be similar to another of their group that they are not connected with.

    The places where two sets' parities differ are no more than the members that only one of them has. That bounds
    the members they share; pairs whose bound is too low are not similar, so nothing is lost.
    """

    def work(key, rows):
        best: dict = {}
        for h, root, minor, n, data in rows:
            best[h] = (root, minor or best.get(h, (0, False))[1], n, data)
        names = list(best)
        n = np.array([best[h][2] for h in names])
        root, minor = np.array([best[h][0] for h in names]), np.array([best[h][1] for h in names])
        words = np.frombuffer(b"".join([best[h][3] for h in names]), np.uint64).reshape(len(names), -1)
        keep = np.zeros(len(names), bool)
        for k in range(len(names)):
            other = np.flatnonzero((root != root[k]) & (minor | minor[k]) & (100 * np.minimum(n, n[k]) >= 75 * np.maximum(n, n[k])))
            if len(other):
                differ = np.bitwise_count(words[other] ^ words[k]).sum(axis=1).astype(np.int64)
                near = linked((n[other] + n[k] - differ) // 2, n[other], n[k])
                keep[k] |= near.any()
        if keep.any():
            at = np.flatnonzero(keep).tolist()
            yield {c: [v] * len(at) for c, v in zip(GROUP, key, strict=True)} | {"h": [names[k] for k in at], "root": root[at], "minor": minor[at]}

    return by_group(groups.join(bits, "h"), ["h", "root", "minor", "n", "bits"], work, "hub long, block int, part int, h long, root long, minor boolean")


def joined(groups: DataFrame) -> DataFrame:
    """Links a, b within each group between sets of different roots, at least one of them minor, by a trie of the group's sets."""

    def work(key, rows):
        best: dict = {}
        for h, root, minor, data in rows:
            best[h] = (root, minor or best.get(h, (0, False))[1], data)
        names = list(best)
        found = trie_join([unpack(best[h][2]) for h in names], [best[h][0] for h in names], np.array([best[h][1] for h in names]))
        if found:
            yield {"a": [max(names[i], names[j]) for i, j in found], "b": [min(names[i], names[j]) for i, j in found]}

    return by_group(groups, ["h", "root", "minor", "members"], work, "a long, b long")


def last_block(sets: Column, members: Column) -> Column:
    """The last block's number, for blocks of about BLOCK sets and MEMBERS members at most."""
    return F.floor(F.greatest((sets - 1) / BLOCK, members / MEMBERS)).cast("int")


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every row of df.

    Null and empty texts, and texts without words, have 0 n-grams and link with nothing: their component is their
    own key. A null key gives its row no name for others: the component is the smallest key that is not null, or
    null. Rows with one key are rows of their own; equal texts link, if they have words. Other columns are ignored.
    Sets are told apart by 64-bit hashes, n-grams within the trie by 48 bits.
    """
    spark = df.sparkSession
    own = key_text(df, key, text)
    parts = materialize(signatures(own, n), "signatures")
    documents = parts.where("slab is null").select("key", "n", "h")
    table, frequent = levels_of(parts.where("slab is not null").select("part", "slab", "data"))
    levels = spark.sparkContext.broadcast(table)
    edges = materialize(stars(prefixes(own, levels, frequent, n)), "stars-of-ngrams")
    wanted = edges.select("h").union(edges.select("hub")).distinct()
    bits = materialize(parts.where("h is not null").select("h", "n", "bits").join(wanted, "h", "left_semi").dropDuplicates(["h"]), "bits")

    def links_of(groups: DataFrame) -> DataFrame:
        near = materialize(screened(groups, bits), "screened")
        sets = members_of(own, near.select("h"), levels, n).dropDuplicates(["h"])
        return materialize(joined(near.join(sets, "h")), "links")

    # each set to the hub that it shares most with; a large hub in blocks, with the hub itself in each
    best = edges.groupBy("h").agg(F.max(F.struct("shared", F.col("hub").alias("at"))).alias("b")).select(F.col("b.at").alias("hub"), "h")
    best = materialize(best.join(bits.select("h", "n"), "h"), "best-hubs")
    blocks = materialize(best.groupBy("hub").agg(last_block(F.count(F.lit(1)) + 1, F.sum("n")).alias("last")), "blocks")
    seats = best.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("h"), F.col("last") + 1).cast("int").alias("block"), "h")
    seats = seats.union(blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), F.col("hub").alias("h")))
    found = links_of(seats.withColumns({"part": F.lit(0), "root": F.col("h"), "minor": F.lit(True)}))
    roots = materialize(components(found), "roots")

    # hubs whose sets are in several components: the early sets outside the largest against all, the late ones outside
    # it against its early ones. A hub that all its sets went to, in one block, has been looked at whole
    open_hubs = edges.groupBy("hub").agg(F.count(F.lit(1)).alias("all")).join(best.groupBy("hub").agg(F.count(F.lit(1)).alias("came")), "hub", "left")
    open_hubs = materialize(open_hubs.where(f"came is null or came < all or came >= {BLOCK}").select("hub"), "open-hubs")
    edges = materialize(edges.join(open_hubs, "hub", "left_semi"), "open-stars")
    at = edges.select("hub", "h", "early").union(edges.select("hub", F.col("hub").alias("h"), F.lit(True)).distinct())
    at = at.join(bits.select("h", "n"), "h").join(roots, at["h"] == roots["node"], "left").select("hub", "h", F.coalesce("root", "h").alias("root"), "early", "n")
    own_early = F.when(F.col("early"), F.col("n")).otherwise(0)
    per_root = at.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("members"), F.count_if("early").alias("early"), F.sum(own_early).alias("early_members"))
    top = F.max(F.struct("many", "root", "members", "early", "early_members")).alias("top")
    sums = [F.sum(c).alias(c) for c in ("many", "members", "early", "early_members")]
    per_hub = per_root.groupBy("hub").agg(F.count(F.lit(1)).alias("roots"), top, *sums).where("roots > 1")
    apart = {c: F.col(c) - F.col(f"top.{c}") for c in ("many", "members", "early", "early_members")}
    shape = per_hub.select(
        "hub",
        F.col("top.root").alias("main"),
        (apart["early"] > 0).alias("first"),
        last_block(F.col("many"), F.col("members")).alias("last"),
        last_block(apart["early"], apart["early_members"]).alias("parts"),
        ((F.col("top.early") > 0) & (apart["many"] > apart["early"])).alias("second"),
        last_block(F.col("top.early"), F.col("top.early_members")).alias("late_last"),
        last_block(apart["many"] - apart["early"], apart["members"] - apart["early_members"]).alias("late_parts"),
    )
    left = materialize(at.drop("n").join(materialize(shape, "shapes"), "hub").withColumn("own", F.xxhash64("h")), "seats")

    def grid(against: DataFrame, minors: DataFrame, last: str, parts: str, block: Column) -> DataFrame:
        """Both sides in all pairs of a block of the one with a part of the other."""
        whole = against.select("hub", F.pmod("own", F.col(last) + 1).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col(parts))).alias("part"), "h", "root", F.lit(False).alias("minor"))
        minors = minors.select("hub", F.explode(F.sequence(F.lit(0), F.col(last))).alias("block"), F.pmod(F.xxhash64("own"), F.col(parts) + 1).cast("int").alias("part"), "h", "root", F.lit(True).alias("minor"))
        return whole.union(minors).withColumn("block", block)

    of_early = grid(left.where("first"), left.where("first and early and root <> main"), "last", "parts", F.col("block"))
    # blocks below zero, so that the two grids' groups are not one
    of_late = grid(left.where("second and early and root = main"), left.where("second and not early and root <> main"), "late_last", "late_parts", -1 - F.col("block"))
    more = links_of(of_early.union(of_late))

    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.join(roots, more["a"] == roots["node"], "left").select(F.coalesce("root", "a").alias("a"), "b"))
    ends = components(links) if not more.isEmpty() else roots
    named = documents.join(ends, documents["h"] == ends["node"], "left").select("key", "n", F.coalesce("root", "h").alias("root"))
    least = materialize(named.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("key").alias("least")), "names")
    return named.join(least, named["root"] == least["r"], "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("component_id"))
