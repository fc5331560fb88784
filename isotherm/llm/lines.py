"""Operator 3: line dedup by winnowing over line hashes."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.llm.common import clear, mark, materialize, per_batch, texts, type_of

#: A repeated run counts if its lines have so many words together.
RUN_WORDS = 50


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shortest_runs(words: list[int], run_words: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs of lines that have run_words words: from each line on, and up to each line.

    Every line of a run with run_words words lies in one of these that is within that run: dropping lines at the run's
    two ends as long as the words suffice leaves the shortest run from its first line on, or that up to its last.
    """
    out = set()
    end, total = 0, 0
    for start in range(len(words)):
        while end < len(words) and total < run_words:
            total += words[end]
            end += 1
        if total < run_words:
            break
        out.add((start, end))
        total -= words[start]
    start, total = 0, 0
    for end, n in enumerate(words, 1):
        total += n
        while total - words[start] >= run_words:
            total -= words[start]
            start += 1
        if total >= run_words:
            out.add((start, end))
    return sorted(out)


def fingerprints(text: str, run_words: int) -> dict[int, tuple[int, list[tuple[int, int, int]]]]:
    """Position -> line hash and windows, of the lines that winnowing selects.

    Lines without words are left out of the count. The windows are the shortest runs of lines that have run_words
    words, from each line on and up to each line. Each window selects its smallest line hash, of equal ones the last,
    so two equal windows select the same place and a repeated run with run_words words always shares a fingerprint.
    The windows that selected a line, as (hash of all their lines, start, end), are what the match can extend over
    before and behind it.
    """
    hashes, words = [], []
    for line in text.split("\n"):
        n = len(line.split())
        if n:
            hashes.append(xxhash.xxh3_64_intdigest(line.strip()))
            words.append(n)
    raw = np.array(hashes, "<u8").tobytes()
    out: dict[int, tuple[int, list[tuple[int, int, int]]]] = {}
    for start, end in shortest_runs(words, run_words):
        own = hashes[end - 1 : start - 1 if start else None : -1]
        low = end - 1 - own.index(min(own))
        out.setdefault(low, (signed(hashes[low]), []))[1].append((signed(xxhash.xxh3_64_intdigest(raw[8 * start : 8 * end])), start, end))
    return out


def repeated_runs(df: DataFrame, key: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """Runs of lines that stood already before: key, th (a hash of the text), start and end, first_key, first_th and first_start.

    Places count the lines that have words. A run is at least run_words words long and stood in a document that comes
    earlier by (key, th), or earlier in its own without overlap. Lines of all such runs, and no others, are in a row here.

    Fingerprints that only one place has are dropped at once. The windows that selected the others reach over their
    matches to both sides, up to the ends of what is repeated: each window's first place is found by partial
    aggregation, so that no place meets all others, and windows that match the same document at the same distance are
    put together as far as they go on both ways. Aggregates are written and read again before they are joined back:
    adaptive execution can then split a hot hash's rows between tasks, which it cannot do where a join shares its
    shuffle with an aggregate.
    """
    own = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))

    def work(batch):
        rows = {c: [] for c in ("key", "th", "fp", "windows")}
        size = 0
        for k, th, t in zip(batch.column("key").to_pylist(), batch.column("th").to_pylist(), texts(batch), strict=True):
            for fp, windows in fingerprints(t, run_words).values():
                rows["key"].append(k)
                rows["th"].append(th)
                rows["fp"].append(fp)
                rows["windows"].append([{"wh": a, "s": b, "e": c} for a, b, c in windows])
                size += len(windows)
            if size > 50_000:
                yield rows
                rows, size = {c: [] for c in rows}, 0
        yield rows

    begun = mark()
    found = materialize(per_batch(own, work, f"key {type_of(own, 'key')}, th long, fp long, windows array<struct<wh:long,s:int,e:int>>"), "fingerprints")
    # windows that are equal, but not one, have their fingerprints at different places
    repeated = materialize(found.groupBy(F.col("fp").alias("r")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r"), "repeated")
    matches = materialize(found.join(repeated, found["fp"] == repeated["r"], "left_semi").select("key", "th", F.inline("windows")), "matches")
    clear(df.sparkSession, begun, keep=1)
    first = matches.groupBy(F.col("wh").alias("f")).agg(F.min(F.struct("key", "th", "s", "e")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = materialize(first, "first-places")
    later = matches.join(first, matches["wh"] == first["f"])
    same = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("th") == F.col("first.th"))
    later = later.where(~same | (F.col("s") >= F.col("first.e")))
    # rows equal in key and text are one document, so their windows fall together
    later = later.select("key", "th", "s", "e", F.col("first.key").alias("first_key"), F.col("first.th").alias("first_th"), (F.col("s") - F.col("first.s")).alias("shift")).distinct()
    beside = Window.partitionBy("key", "th", "first_key", "first_th", "shift").orderBy("s", "e")
    reach = F.max("e").over(beside.rowsBetween(Window.unboundedPreceding, -1))
    joined = later.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(beside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = joined.groupBy("key", "th", "first_key", "first_th", "shift", "run").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return runs.select("key", "th", "start", "end", "first_key", "first_th", (F.col("start") - F.col("shift")).alias("first_start"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """df with the later repeated runs deleted from its texts, and n_lines, n_removed (long, of lines with words).

    Lines without words stay where they are. Null texts stay null, other columns are passed on; columns of df
    that are named n_lines or n_removed are replaced. Rows equal in key and text are one document: the first
    occurrence stays in each of them. Null keys come before all others. An empty table gives an empty one.
    """
    runs = repeated_runs(df, key, text, run_words)
    spans = runs.groupBy(F.col("key").alias("__key"), F.col("th").alias("__th")).agg(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))).alias("__spans"))
    own = df.drop("n_lines", "n_removed").withColumn("__own", F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    joined = own.join(spans, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__th")), "left").drop("__key", "__th", "__own")
    schema = joined.schema
    out = [f.name for f in schema.fields if f.name != "__spans"]

    def work(batch):
        kept, lines, gone = [], [], []
        for t, spans in zip(batch.column(text).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
            if t is None:
                lines.append(0)
            else:
                parts = t.split("\n")
                worded = [k for k, x in enumerate(parts) if x and not x.isspace()]
                lines.append(len(worded))
            if not spans:
                kept.append(t)
                gone.append(0)
                continue
            cut = {worded[k] for x in spans for k in range(x["s"], x["e"])}
            kept.append("\n".join([x for k, x in enumerate(parts) if k not in cut]))
            gone.append(len(cut))
        return {c: batch.column(c) for c in out} | {text: kept, "n_lines": lines, "n_removed": gone}

    from pyspark.sql import types as T

    to = T.StructType([schema[c] for c in out] + [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return per_batch(joined, work, to)
