"""The numbered operators against brute force, libraries and round trips, on small and awkward tables."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from isotherm.llm import bpe, jaccard, lines, lm, lsh, media, packing, quality, tokens, trie, warc
from isotherm.operators.stars import components

DOCS = "doc_id long, text string, key string, n int, h long, spans string, n_lines string, score double, media binary"


def documents(spark, rows):
    """rows of (doc_id, text) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, "x", 1, 2, "s", "l", 0.5, b"m") for k, t in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    long = text(3000)
    rows = [(1, ""), (2, None), (3, " \n\t "), (None, "null key has text"), (4, "same"), (4, "same"), (5, long), (6, long), (7, long + " tail"), (8, "<|endoftext|> x\x1cy 　z"), (9, "a b c"), (10, "A B c"), (11, "ﬁ É ΟΔΟΣ don't 12")]
    base = text(60).split(" ")
    for k in range(20, 40):
        edited = list(base)
        edited[rnd.randrange(60)] = word()
        rows.append((k, " ".join(edited)))
    rows += [(k, text(rnd.randrange(1, 200))) for k in range(40, 60)]
    return documents(spark, rows)


def everything(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_media_round_trip(spark, awkward):
    stored = media.to_media(awkward.select(F.struct("doc_id", "text").alias("doc_id"), "text", "key", "n"))
    rows = media.probe(stored).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        data = (r["doc_id"]["text"] or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or 576 * (not data))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert [c["first_frame"] for c in r["clips"]][0] == 0 and r["clips"][-1]["last_frame"] == r["frames"] - 1
    assert media.clip_rows(media.probe(stored)).count() == sum(len(r["clips"]) for r in rows)
    assert media.probe(stored.limit(0)).count() == 0


def test_media_shots_and_missing_index():
    frames = np.concatenate([np.full((20, 576), 40), np.full((20, 576), 200), np.full((20, 576), 90)]).astype(np.uint8)
    frames[:, 0] = np.arange(60)
    data = media.write_avi(media.encode_frames(frames))
    spans, microseconds = media.read_avi(data)
    walked, _ = media.read_avi(data[: data.rindex(b"idx1")])
    assert spans == walked and len(spans) == 60 and microseconds == 40_000
    read = media.decode_frames([data[a:b] for a, b in spans])
    assert (np.array(read).reshape(60, 576) == frames).all()
    _, new = media.shots(np.array(read), np.zeros(60, int))
    assert np.flatnonzero(new).tolist() == [0, 20, 40]
    for broken in (b"", b"RIFF\0\0\0\0WAVE", data[:100]):
        with pytest.raises((ValueError, struct.error)):
            media.read_avi(broken)


def test_media_random_samples_survive():
    cells = np.random.default_rng(0).integers(0, 256, (300, 576)).astype(np.uint8)
    assert (np.array(media.decode_frames(media.encode_frames(cells))).reshape(300, 576) == cells).all()


def test_media_baseline_frames():
    """A flat baseline frame of two blocks: grey 60 and 180, by direct parts of the DCT only."""
    quant = media.segment(0xDB, bytes([0, 8] + [1] * 63))
    dc = media.segment(0xC4, bytes([0x00] + [0, 0, 0, 9] + [0] * 12 + list(range(9))))
    ac = media.segment(0xC4, bytes([0x10] + [1] + [0] * 15 + [0]))
    frame = media.segment(0xC0, struct.pack(">BHHB3B", 8, 8, 16, 1, 1, 0x11, 0))
    scan = media.segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits = ""
    for d in (60 - 128, 180 - 60):
        n = abs(d).bit_length()
        bits += format(n, "04b") + format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") + "0"
    bits += "1" * (-len(bits) % 8)
    coded = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    [pixels] = media.decode_frames([b"\xff\xd8" + quant + dc + ac + frame + scan + coded + b"\xff\xd9"])
    assert pixels.shape == (8, 16) and (pixels[:, :8] == 60).all() and (pixels[:, 8:] == 180).all()


def test_token_counts(spark, awkward):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = tokens.token_counts(awkward, P.path("byte_bpe_50k.json"), P.PATTERN, budgets=(5,), prefixes=True).collect()
    want = sorted((str(k), len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for k, t in everything(awkward))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["counts"][-1] == r["n_tokens"] for r in out)


def test_counts_at_every_prefix():
    from tokenizers import Tokenizer

    lib, coder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.load(P.path("byte_bpe_50k.json"), P.PATTERN)
    rnd = random.Random(5)
    rows = ["", "a", "  ", "foo   bar\n\n baz's <|endoftext|>  x", "日本 語 'rex", "'ll they'r we're", " \n <|endoftext|> <|endoftext|>a  "]
    rows += ["".join(rnd.choice("ab cdé'stÉ×12.,<| \n日ΣİJ̌̊\xa0Zß  \t　rel") for _ in range(rnd.randrange(50))) for _ in range(200)]
    rows += ["".join(rnd.choice("ab \n\t  '<|endoftext|>") for _ in range(rnd.randrange(20))) + "<|endoftext|>" * rnd.randrange(2) for _ in range(100)]
    for text, spread in zip(rows, coder.spread(rows, counts=True), strict=True):
        counts = bpe.PrefixCounts(coder, text, spread)
        want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert [counts.at(k) for k in range(len(text) + 1)] == counts.every().tolist() == want
        for budget in (0, 1, 3, 8):
            assert counts.cut(budget) == max(k for k, n in enumerate(want) if n <= budget)


@pytest.mark.parametrize("unit", ["abcdefghij", "日本語天地"])
def test_counts_of_a_long_run_without_white_space(unit):
    from tokenizers import Tokenizer

    lib, coder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.load(P.path("byte_bpe_50k.json"), P.PATTERN)
    text = unit * (1_000_000 // len(unit))
    counts = bpe.PrefixCounts(coder, text)
    n = counts.cut(1024)
    assert counts.at(n) <= 1024 < counts.at(n + 1)
    for k in (1, 17, n, n + 1, 4000):
        assert counts.at(k) == len(lib.encode(text[:k], add_special_tokens=False).ids)
    assert not coder.kept.get((text.encode(), True))
    # with words around it, and again in a window of its own
    around = "some words before " * 3 + text * 3 + " and after it's end"
    [(_, _, ids)] = coder.spread([around])
    assert ids.tolist() == lib.encode(around, add_special_tokens=False).ids and len(coder.coders[False].up) < 5 << 19


def test_pieces_are_the_libraries():
    """Words split by classes of bytes, and hard ones, with a small cache that is begun anew again and again."""
    import tiktoken
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    rows = ["", "it's DON'T l'homme ''re 's 'S x'y'll", "É È × ÷ ÀÉÎ ŒUVRE ΟΔΟΣ İ J̌ ﬁ é Å ÿŸ", "<|endoftext|> a<|b <| x", "12 3a4 b5_c--d!! $%^ 日本語", "a\x1cb", "longword" * 30 + " " + "x" * 40 + " " + "y" * 39, "-" * 60 + "'s", "ªµ º ² ½ ſ ßSS ẞ", "﻿abc\x00"]
    rows += ["".join(rnd.choice("ab cdé'stÉ×12.,<| \n日ΣİJ̌̊\xa0Zß") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    rows.append(" ".join(rows) * 20)
    path = P.path("word_bpe_49k.json")
    lib, words = Tokenizer.from_file(path), packing.Words(path)
    words.coder.cache.PLACES, words.coder.cache.ARENA = 8, 3000
    words.coder.cache.clear()
    assert [x.tolist() for x in words.ids(rows, 1)] == [[*lib.encode(t, add_special_tokens=False).ids, 1] for t in rows]
    coder = bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    assert [ids.tolist() for _, _, ids in coder.spread(rows)] == [lib.encode_ordinary(t) for t in rows]
    assert [x.tolist() for x in words.ids(["", "", " "], 1)] == [[1]] * 3 and words.ids([], 1) == [] and [len(x[2]) for x in coder.spread(["", ""])] == [0, 0]


def test_encoding_decoding_and_edits(spark, awkward):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    coder = bpe.load(path, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rows = tokens.round_trip(awkward, path, P.PATTERN).collect()
    want = sorted((str(k), hashlib.sha256(np.array(lib.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, t in everything(awkward))
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    back = tokens.decode(tokens.encode(awkward, path, P.PATTERN), path, P.PATTERN)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted(t.encode() for _, t in everything(awkward))
    data = "antidisestablishment".encode()
    last, counts = coder.last_tokens(data[:7])
    assert coder.last_tokens(data, last, counts) == coder.last_tokens(data)
    rnd, text = random.Random(1), "The quick  brown fox, jumps\nover 12 lazy dogs' tails." * 3
    for _ in range(60):
        at = rnd.randrange(len(text) + 1)
        new, ids, again = coder.edit(text, np.array(coder.encode(text), "<u4"), at, min(rnd.randrange(4), len(text) - at), rnd.choice(["", " ", "x", "it's ", "\n"]))
        assert ids.tolist() == lib.encode_ordinary(new) and again < 60


def test_line_dedup_is_brute_force(spark):
    rnd = random.Random(2)
    pool = [" ".join(rnd.choice("pqrstuv") * rnd.randrange(1, 3) for _ in range(rnd.randrange(1, 6))) for _ in range(14)]
    rows = [(k, "\n".join(rnd.choice([*pool, "", " "]) for _ in range(rnd.randrange(0, 14)))) for k in range(60)] + [(None, "\n".join(pool)), (60, None), (7, "\n".join(pool[:6])), (61, "\n".join(["a b c"] * 9))]
    out = lines.dedup(documents(spark, rows), run_words=8).collect()
    assert len(out) == len(rows)
    places: dict = {}
    worded = lambda t: [x.strip() for x in (t or "").split("\n") if x.split()]
    for k, t in rows:
        own = worded(t)
        for s in range(len(own)):
            for e in range(s + 1, len(own) + 1):
                if sum(len(x.split()) for x in own[s:e]) >= 8:
                    places.setdefault(tuple(own[s:e]), set()).add((k if k is not None else -1, spark_hash(spark, t), s, e))
    gone: dict = {}
    for found in places.values():
        first = min(found)
        for k, th, s, e in found:
            if (k, th, s) != first[:3] and ((k, th) != first[:2] or s >= first[3]):
                gone.setdefault((k, th), set()).update(range(s, e))
    for r in out:
        cut = gone.get((r["doc_id"] if r["doc_id"] is not None else -1, spark_hash(spark, r_text(rows, r))), set()) if r["text"] is not None else set()
        assert r["n_removed"] == len(cut)
        if r["text"] is not None:
            assert worded(r["text"]) == [x for k, x in enumerate(worded(r_text(rows, r))) if k not in cut]
    assert lines.dedup(documents(spark, []), run_words=8).count() == 0


def test_line_dedup_deletes_runs_to_both_ends(spark):
    rnd = random.Random(6)
    words = lambda n: " ".join(rnd.choice("pqrstuv") + rnd.choice("abc") for _ in range(n))
    pool = [words(rnd.choice([1, 2, 3, 7, 9, 12])) for _ in range(12)]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 16)))) for k in range(80)]
    rows += [(k, "\n".join([*[rnd.choice(pool) for _ in range(2)], *pool[a : a + 6], rnd.choice(pool)])) for k, a in zip(range(80, 90), [0, 1, 2, 3, 4] * 2, strict=True)]
    # lines of 60 and 10 words, and again, behind another line
    long = words(60) + "\n" + words(10)
    rows += [(90, long), (91, "other\n" + long + "\nend")]
    own = {k: t.split("\n") if t else [] for k, t in rows}
    places: dict = {}
    for k, x in own.items():
        for s in range(len(x)):
            for e in range(s + 1, len(x) + 1):
                if sum(len(y.split()) for y in x[s:e]) >= 8:
                    places.setdefault(tuple(x[s:e]), []).append((k, s, e))
    gone: dict = {k: set() for k in own}
    for found in places.values():
        for k, s, e in found:
            if any(a < k or (a == k and c <= s) for a, _, c in found):
                gone[k].update(range(s, e))
    assert gone[91] == {1, 2}
    for r in lines.dedup(documents(spark, rows), run_words=8).collect():
        x, cut = own[r["doc_id"]], gone[r["doc_id"]]
        assert r["n_removed"] == len(cut) and r["text"] == "\n".join(y for i, y in enumerate(x) if i not in cut)


def test_repeated_runs_reach_over_the_match_both_ways(spark):
    """Lines of 45, 10, 10 and 10 words that stood before: no window begins at the last ones, and all four go."""
    rnd = random.Random(9)
    line = lambda n: " ".join(rnd.choice("pqrstuv") + rnd.choice("abcdefg") for _ in range(n))
    same = [line(45), line(10), line(10), line(10)]
    rows = [(1, "\n".join(["intro", *same, "tail"])), (2, "\n".join(["start", "", *same, "end"])), (3, "\n".join(same * 2)), (4, None), (None, "")]
    runs = lines.repeated_runs(documents(spark, rows)).collect()
    assert sorted((r["key"], r["start"], r["end"], r["first_key"], r["first_start"]) for r in runs) == [(2, 1, 5, 1, 1), (3, 0, 4, 1, 1), (3, 4, 8, 1, 1)]
    out = {r["doc_id"]: (r["n_removed"], r["text"]) for r in lines.dedup(documents(spark, rows)).collect()}
    assert out[2] == (4, "start\n\nend") and out[3] == (8, "") and out[1][0] == 0 and out[4] == (0, None) and out[None] == (0, "")


_hashes: dict = {}


def spark_hash(spark, t):
    if t not in _hashes:
        _hashes[t] = spark.range(1).select(F.xxhash64(F.lit(t or ""))).first()[0]
    return _hashes[t]


def r_text(rows, r):
    """The row's text before: of doc 7, which has two rows, the one with as many lines with words."""
    own = [t for k, t in rows if k == r["doc_id"]]
    return next(t for t in own if len(own) == 1 or sum(bool(x.split()) for x in (t or "").split("\n")) == r["n_lines"])


def test_packing(spark, awkward):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    ids = {}
    for k, t in everything(awkward):
        ids.setdefault(k, []).append(np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4"))
    for length, shard in ((128, 1000), (2048, 2_000_000)):
        rows = packing.pack(awkward, path, length=length, shard=shard).collect()
        by: dict = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for pieces in by.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= length
        left = {(k, a, len(x)) for k, xs in ids.items() for x in xs for a in range(len(x))}
        for r in rows:
            x = next(x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"])
            assert zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            left -= {(r["doc_id"], a, len(x)) for a in range(r["start"], r["start"] + r["length"])}
        assert not left and sum(r["length"] for r in rows) == sum(len(x) for xs in ids.values() for x in xs)
        assert len(by) <= sum(r["length"] for r in rows) / length + len({r["sequence_id"] >> 33 for r in rows}) + 1
    assert packing.pack(awkward.limit(0), path).count() == 0


def test_packing_takes_the_nearest():
    ids = [np.array([5, 6, 7, 1]), np.array([20, 21, 22, 1]), np.array([5, 6, 8, 1])]
    pieces = list(packing.fill(ids, np.where(np.arange(50) == 1, 0.01, 1.0), 4.0, 8))
    assert [p[2] for p in pieces] == [0, 2, 1]


def test_warc(spark, tmp_path):
    same, small = "<html>" + "é" * 100, "tiny"
    rows = [(3, "http://a/ b", same), (1, None, same), (2, "http://b", same), (4, "u", small), (5, "u", small), (6, "u", None), (None, "u", same), (7, "u", "x" * 400_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    out = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(out) == len(rows)
    for k, _, html in rows:
        data = (html or "").encode()
        assert (out[k]["payload_bytes"], out[k]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert {k: r["refers_to"] for k, r in out.items() if r["record_type"] == "revisit"} == {3: 1, 2: 1, None: 1}
    named = pages.withColumn("page_id", F.when(F.col("page_id") == 3, "None").when(F.col("page_id") == 2, "a b>\n+%").when(F.col("page_id") == 4, "").otherwise(F.col("page_id").cast("string")))
    assert sorted(map(str, (r[0] for r in warc.round_trip(named).select("page_id").collect()))) == sorted(map(str, (r[0] for r in named.select("page_id").collect())))
    files = warc.write_archives(pages, folder=f"file://{tmp_path}/w")
    read = warc.read_archives(spark, files, payloads=True)
    assert sorted((bytes(r["payload"]) for r in read.where("record_type = 'response'").collect()), key=len)[-1] == b"x" * 400_000
    data = zlib.decompress(warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest()), 31)
    for raw, ok in ((data, True), (data.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"), False)):
        [r] = warc.read_records(iter_read(raw))
        assert r["payload_ok"] is ok and r["block_ok"] is ok
    for bad in (data[:-6], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.read_records(iter_read(bad)))
    assert warc.round_trip(pages.limit(0)).count() == 0


def iter_read(data):
    import io

    return io.BytesIO(data).read


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[100:400] = x[100] + 0.01 * rng.normal(size=(300, 16))
    x[5] = x[6] = x[20]
    rows = [(k, v.tolist(), "e") for k, v in enumerate(x)] + [(2000, None, "e"), (2020, [0.0] * 16, "e"), (2040, [float("nan")] * 16, "e"), (2060, [1.0] * 3, "e"), (None, [1.0] * 16, "e"), (2080, [None] * 16, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, data string")
    found: dict = {}
    for r in lsh.search(df).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 900, 20))
    right = 0
    for q, got in found.items():
        s = x @ x[q]
        want = sorted((k for k in range(900) if k != q), key=lambda k: (-s[k], k))[:20]
        right += len({k for k, _ in got} & set(want))
        assert len(got) == 20 and all(abs(v - s[k]) < 1e-9 for k, v in got) and got == sorted(got, key=lambda p: (-p[1], p[0]))
    assert right >= 0.9 * 20 * len(found)
    few = lsh.search(df.where("vec_id < 3 or vec_id = 20")).where("query_id = 20").collect()
    assert {r["vec_id"] for r in few} == {0, 1, 2}
    assert lsh.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", ["one long", "log-normal"])
def test_neighbours_of_unequal_lengths(spark, lengths):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(160, 32)), 40, axis=0) + 0.5 * rng.normal(size=(6400, 32))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    if lengths == "one long":
        x[77] *= 10
    else:
        x *= rng.lognormal(0, 0.5, size=(6400, 1))
    found: dict = {}
    for r in lsh.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = x[::20] @ x.T
    s[np.arange(320), np.arange(0, 6400, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    recall = sum(len(found.get(20 * i, set()) & set(b.tolist())) for i, b in enumerate(best)) / best.size
    assert recall >= 0.9


@pytest.mark.parametrize("rows", [11, 21, 700])
def test_neighbours_are_never_too_few(spark, rows):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(rows, 16))
    # far from all others, and a key with many vectors
    x[0] *= -0.001
    more = [(1, (20 * x[1] + 0.01 * rng.normal(size=16)).tolist()) for _ in range(40)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + more, "vec_id long, embedding array<double>")
    found: dict = {}
    for r in lsh.search(df, every=5, success=0.01).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(found) == set(range(0, rows, 5)) and all(len(v) == min(20, rows - 1) for v in found.values())


def test_quality(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out()))
    scored = quality.score(docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})), model)
    assert scored.count() == docs.count() + 1 and scored.where("score is null or score < 0 or score > 1").count() == 0
    judged = scored.join(labels, "doc_id").where(quality.held_out()).select(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int").alias("right"))
    assert judged.agg(F.avg("right")).first()[0] > 0.9
    assert quality.train(docs.limit(0), labels).score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]


def test_trie_join_finds_all_components():
    rnd = random.Random(3)
    for _ in range(300):
        sets = [{rnd.randrange(60) for _ in range(rnd.randrange(1, 25))}]
        while len(sets) < 10:
            s = set(rnd.choice(sets)) ^ {rnd.randrange(60) for _ in range(rnd.randrange(0, 4))} if rnd.random() < 0.7 else {rnd.randrange(60) for _ in range(rnd.randrange(1, 25))}
            sets.append(s or {1})
        minor = np.array([rnd.random() < 0.4 for _ in sets])
        links = [(i, j) for i in range(10) for j in range(i) if trie.linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j]))]
        arrays = [np.array(sorted(s)) for s in sets]
        for mark, own in ((None, links), (minor, [(i, j) for i, j in links if minor[i] or minor[j]])):
            a, b = trie.Groups(range(10)), trie.Groups(range(10))
            for i, j in own:
                a.join(i, j)
            for i, j in trie.trie_join(arrays, None, mark):
                b.join(i, j)
            assert [a.find(k) for k in range(10)] == [b.find(k) for k in range(10)]


def test_similar_documents(spark, awkward):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    rows = everything(awkward)
    sets = []
    for _, t in rows:
        w = word.findall(t.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    groups = trie.Groups(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                groups.join(i, j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        g = groups.find(i)
        least[g] = min(x for x in (least.get(g), k) if x is not None) if (least.get(g), k) != (None, None) else None
    want = sorted((str(k), len(sets[i]), str(least[groups.find(i)])) for i, (k, _) in enumerate(rows))
    out = jaccard.similar(awkward)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out.collect()) == want


def test_components(spark):
    links = [(k + 1, k) for k in range(40)] + [(100, 200), (200, 300), (7, 7)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(roots[k] == 0 for k in range(1, 41)) and roots[300] == roots[200] == 100


def test_pseudo_likelihood(spark, awkward):
    rows = lm.pseudo_likelihood(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert (r["n_words"] == 0) == (r["mean"] is None) and np.isfinite(r["log_probability"])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    totals = [lm.pseudo_likelihood(docs, rounds=n).agg(F.sum("log_probability")).first()[0] for n in (0, 2)]
    assert totals[1] > totals[0]
    assert lm.pseudo_likelihood(docs.limit(0)).count() == 0


def test_scores_are_brute_force(spark, awkward, monkeypatch):
    """The same network, but words counted in a dictionary of the corpus, and probabilities in loops."""
    monkeypatch.setattr(lm, "COMMON", 3)
    from isotherm.llm.common import key_text

    docs, words = lm.encoded(key_text(awkward.repartition(3), "doc_id", "text"))
    net = lm.train(docs, words)
    out = lm.score(docs, net).collect()
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower() if t.isascii() else t.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    rows = [(k, split(t)) for k, t in everything(awkward)]
    counts: dict = {}
    for _, ws in rows:
        for w in ws:
            counts[w] = counts.get(w, 0) + 1
    hashes = {w: int(jaccard.word_hashes(w.decode()).view(np.int64)[0]) for w in counts}
    top = sorted((w for w in counts if counts[w] >= 3), key=lambda w: (-counts[w], hashes[w]))[: lm.VOCABULARY - lm.RARE]
    name, mass = {w: k for k, w in enumerate(top)}, [0] * lm.RARE
    for w, n in counts.items():
        if w not in name:
            mass[int(lm.level(np.array([n]))[0])] += n
    assert mass == words.mass.tolist()
    want = []
    for k, ws in rows:
        ids, extra = [], 0.0
        for w in ws:
            rest = counts[w] - ws.count(w)
            kind = int(lm.level(np.array([rest]))[0])
            ids.append(name.get(w, lm.VOCABULARY - lm.RARE + kind))
            extra += 0.0 if w in name else np.log(rest / max(mass[kind], rest)) if rest else -lm.SPELLED * len(w)
        total = extra
        if k in (8, 9, 11, 20) or not ws:
            line = [lm.VOCABULARY] * 2 + ids + [lm.VOCABULARY] * 2
            for p, w in enumerate(ids):
                h = np.append(np.tanh(net.bias + sum(net.near[j][line[p + q]] for j, q in enumerate((0, 1, 3, 4)))), 1.0)
                softmax = lambda x: np.exp(x) / np.exp(x).sum()
                total += np.log(softmax(h @ net.classes)[w % lm.CLASSES]) + np.log(softmax(h @ net.words[w % lm.CLASSES])[w // lm.CLASSES])
            want.append((k, len(ws), total))
    got = {r["key"]: r for r in out}
    assert len(out) == len(rows)
    for k, n, total in want:
        assert got[k]["n_words"] == n and abs(got[k]["log_probability"] - total) < 1e-3 * max(1, n)


def test_words_that_occur_elsewhere_score_higher(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    texts = [" ".join(word() if rnd.random() < 0.3 else rnd.choice(["the", "of", "and", "to"]) for _ in range(80)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, texts[k]) for k in range(6)]
    means = {r["doc_id"]: r["mean"] for r in lm.pseudo_likelihood(documents(spark, rows)).collect()}
    twice = [means[k] for k in [*range(6), *range(100, 106)]]
    assert min(twice) > max(means[k] for k in range(6, 60)) and means[0] == means[100]


def test_numbers_in_seven_bits():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 1 << b, 300) for b in (3, 8, 15, 27)] + [np.array([0, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21])])
    many = np.array([0, 500, 0, 700, len(x) - 1200, 0])
    assert [lm.unpacked(d).tolist() for d in lm.packed(x, many)] == [p.tolist() for p in np.split(x, np.cumsum(many)[:-1])]


def test_network_learns_and_is_a_distribution():
    rng = np.random.default_rng(0)
    net = lm.Network.new(np.ones(lm.VOCABULARY))
    around = rng.integers(0, 50, (4000, 4)).astype(np.int32)
    word = (around[:, 1] * 3 % 50).astype(np.int32)
    before = net.log_probabilities(word, around).mean()
    for _ in range(60):
        net.learn(word, around, 0.5)
    assert net.log_probabilities(word, around).mean() > before + 1
    every = np.arange(lm.VOCABULARY, dtype=np.int32)
    assert abs(np.exp(net.log_probabilities(every, np.repeat(around[:1], len(every), axis=0))).sum() - 1) < 1e-6


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, sf).cache()
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {r["doc_id"] for r in out} <= {r["doc_id"] for r in kept.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "packing"]


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long, key string, th long, h long, kind int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Some documents of the test tables, and awkward rows, as tables of their own; columns whose names clash beside them."""
    folder, rnd = tmp_path_factory.mktemp("corpus"), random.Random(3)
    base = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{base}/documents.parquet").collect() if len(r["text"] or "") < 6000]
    some = [t for _, t in rows if len(t or "") > 900][:6]
    rows += [(9001, None), (9002, ""), (9003, "  \n "), (None, some[0]), (None, None), (rows[0][0], rows[0][1]), (rows[1][0], some[1] + "\nmore"), (9004, "\n".join(some[2:5])), (9005, some[5]), (9006, some[5] + " z"), (9005, some[5])]
    rnd.shuffle(rows)
    spark.createDataFrame([(k, t, "en", "web", len(t or ""), "x", 1, 2, 3) for k, t in rows], PIPELINE).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{base}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_is_brute_force(spark, corpus):
    """Each stage on what its predecessor kept, against loops; and run() against the last of them."""
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    order = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)
    # quality: the same model, each text by itself
    labels = spark.read.parquet(f"{corpus}/labels.parquet").where(~quality.held_out())
    model = quality.train(docs, labels)
    now = [r for r in docs.collect() if model.score(np.array([quality.statistics(r["text"] or "")]))[0] >= pipeline.LEAST_QUALITY]
    kept = pipeline.quality_stage(spark, docs, corpus)
    assert tuple(kept.columns) == pipeline.COLUMNS and order(kept.collect()) == order(now) and 20 < len(now) < docs.count()
    # lines: all shortest windows of 50 words from each line on and up to each line
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    ident = {(r["doc_id"], r["text"]): ((r["doc_id"] is not None, r["doc_id"] or 0), spark_hash(spark, r["text"])) for r in now}
    places: dict = {}
    for (_, t), name in ident.items():
        own = [x.strip() for x in (t or "").split("\n") if x.split()]
        for s, e in lines.shortest_runs([len(x.split()) for x in own], 50):
            places.setdefault(tuple(own[s:e]), []).append((name, s, e))
    gone: dict = {}
    for found in places.values():
        first = min(found)
        for name, s, e in found:
            if (name, s) != first[:2] and (name != first[0] or s >= first[2]):
                gone.setdefault(name, set()).update(range(s, e))
    want = []
    for r in now:
        cut, k, out = gone.get(ident[r["doc_id"], r["text"]], set()), 0, []
        for x in (r["text"] or "").split("\n"):
            if not (x.split() and k in cut):
                out.append(x)
            k += bool(x.split())
        if not cut or len(cut) < k:
            want.append({"doc_id": r["doc_id"], "text": "\n".join(out) if r["text"] is not None else None})
    after = pipeline.line_stage(spark, kept, corpus)
    assert tuple(after.columns) == pipeline.COLUMNS and order(after.collect()) == order(want) and len(want) < len(now)
    # near duplicates: one row of each group of links
    after = spark.createDataFrame(after.collect(), after.schema)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (re.findall("[^ \t-\r]+", (r["text"] or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))) for r in want)]
    groups = trie.Groups(range(len(want)))
    for i, a in enumerate(sets):
        for j in range(i):
            if (want[i]["doc_id"], want[i]["text"] or "") == (want[j]["doc_id"], want[j]["text"] or "") or (a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j])):
                groups.join(i, j)
    names: dict = {}
    for i, r in enumerate(want):
        names.setdefault(groups.find(i), []).append((r["doc_id"] is None, r["doc_id"] or 0, spark_hash(spark, r["text"])))
    one = pipeline.near_duplicate_stage(spark, after, corpus).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, spark_hash(spark, r["text"])) for r in one) == sorted(min(v) for v in names.values()) and len(one) < len(want)
    # packing: every id of what is left, once
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = sorted((str(r["doc_id"]), len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in one)
    pieces = pipeline.run(spark, corpus).collect()
    assert sum(r["length"] for r in pieces) == sum(n for _, n in ids)
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in pieces if r["start"] == 0) == ids


def test_stages_on_awkward_tables(spark, corpus, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), corpus).count() == 0
    none = spark.createDataFrame([(k, None, None, None, None, "x", 1, 2, 3) for k in (1, 1, None)], PIPELINE)
    assert pipeline.line_stage(spark, none, corpus).count() == 3
    assert sorted(str(r["doc_id"]) for r in pipeline.near_duplicate_stage(spark, none, corpus).collect()) == ["1", "None"]
    assert [r["length"] for r in pipeline.packing_stage(spark, none, corpus).collect()] == [1, 1, 1]
    spark.read.parquet(f"{corpus}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.quality_stage(spark, docs, str(tmp_path)).count() == docs.count()


def test_bm25_is_brute_force():
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 40, rng.integers(3, 60)).astype("<u4") for _ in range(80)]
    idf, mean = rng.random(40), float(np.mean([len(x) for x in ids]))

    def score(seed, other):
        out = 0.0
        for t in set(ids[seed].tolist()):
            tf = ids[other].tolist().count(t)
            out += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(ids[other]) / mean))
        return out

    shard = packing.Shard(ids, idf, mean)
    for seed in (0, 7, 79):
        assert np.allclose(shard.scores(seed), [score(seed, k) for k in range(len(ids))], rtol=1e-5)
    # greedy filling: the best unused neighbour first, what is cut off is the next seed
    free, left, seed, want, room = set(range(80)), [len(x) for x in ids], None, [], 0
    while free or seed is not None:
        seed = min(free) if seed is None else seed
        free.discard(seed)
        s = shard.scores(seed)
        queue, room, rest = [seed, *sorted(free, key=lambda k: (-s[k], k))], 128, None
        for k in queue:
            if not room:
                break
            free.discard(k)
            n = min(room, left[k])
            want.append((k, n))
            left[k], room = left[k] - n, room - n
            rest = k if left[k] else None
        seed = rest
    assert [(k, b - a) for _, _, k, a, b in packing.fill(ids, idf, mean, 128)] == want


def test_trees_are_brute_force():
    rng = np.random.default_rng(4)
    x, noise = rng.normal(size=(600, 5)), rng.normal(size=600)
    x[:, 3] = rng.integers(0, 4, 600)
    y = ((x[:, 1] + 0.4 * noise > 0.2) ^ (x[:, 3] > 2)).astype(float)
    model = quality.fit(x, y, trees=6, depth=3)

    def walk(row, node):
        while model.left[node] != node:
            node = model.left[node] if row[model.feature[node]] <= model.limit[node] else model.right[node]
        return model.value[node]

    want = [1 / (1 + np.exp(-(model.base + sum(walk(row, r) for r in model.roots)))) for row in x[:80]]
    assert np.allclose(model.score(x[:80]), want, atol=1e-8)
    # the first split is the best of all at the bins' edges
    p = y.mean() * 600 / 601 + 0.5 / 601
    g, h = y - p, np.full(600, p * (1 - p))
    best = max(
        (g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1), -f, -e)
        for f in range(5) for e in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for low in [x[:, f] <= e] if min(low.sum(), (~low).sum()) >= 8
    )
    root = model.roots[0]
    low = x[:, model.feature[root]] <= model.limit[root]
    assert abs(g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - best[0]) < 1e-6


def test_shots_are_brute_force():
    rng = np.random.default_rng(7)
    owner = np.repeat(np.arange(4), [1, 30, 2, 40])
    level = np.cumsum(rng.random(len(owner)) < 0.12) * 37 % 200
    frames = (level[:, None] + rng.integers(0, rng.integers(2, 50), (len(owner), 576))).astype(np.uint8)
    d, new = media.shots(frames, owner)
    hist = [[sum(int(v) >> 3 == b for v in f) / 576 for b in range(32)] for f in frames]
    seen: list = []
    for k in range(len(owner)):
        if k == 0 or owner[k] != owner[k - 1]:
            assert new[k]
            seen = []
            continue
        x = round(sum(abs(a - b) for a, b in zip(hist[k], hist[k - 1], strict=True)) / 2, 6)
        last = seen[-12:][-(12 if len(seen) >= 12 else len(seen)) :] if seen else []
        last = last[1:] if len(seen) >= 12 else last
        mean = sum(last) / len(last) if last else 0
        var = max(0, sum(v * v for v in last) / len(last) - mean * mean) if last else 0
        assert abs(d[k] - x) < 1e-6 and new[k] == ((x > mean + 3 * var**0.5 and x > 0.08) if last else x > 0.5)
        seen.append(x)


def test_near_duplicate_stage_keeps_one_row_a_group(spark):
    import corpus_pipeline

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(60)] for _ in range(8)]
    near = lambda k: " ".join([*base[k][:59], word()])
    whole = lambda k: " ".join(base[k])
    rows = [(1, whole(0)), (1, whole(0)), (2, near(0)), (None, whole(0)), (None, whole(1)), (None, near(1)), (None, whole(2)), (5, near(2)), (5, whole(3)), (6, near(3)), (6, whole(4)), (7, whole(5)), (7, whole(5)), (8, None), (9, "")]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def grams(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    root = list(range(len(rows)))
    for i, (k, t) in enumerate(rows):
        for j in range(i):
            a, b = grams(t), grams(rows[j][1])
            if (k, t) == rows[j] or (a and len(a & b) >= 0.75 * len(a | b)):
                root = [root[j] if r == root[i] else r for r in root]
    # all of a group's rows with the smallest doc_id are possible
    want = {}
    for r in set(root):
        own = [rows[i] for i in range(len(rows)) if root[i] == r]
        least = min((k is None, k or 0) for k, _ in own)
        want[r] = {x for x in own if (x[0] is None, x[0] or 0) == least}
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    got = [(r["doc_id"], r["text"]) for r in out]
    assert tuple(out[0].asDict()) == corpus_pipeline.COLUMNS and len(got) == len(want)
    assert all(len([x for x in got if x in w]) == 1 for w in want.values())
