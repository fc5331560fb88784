"""Operator 1: AVI files of JPEG frames. RIFF indexes, intra frames, shots, timed clips.

Bytes are kept losslessly as 8-bit grey frames of 24 x 24 samples, each a lossless JPEG (SOF3, predictor 1:
the sample to the left), so that every frame decodes on its own. Real motion JPEG, whose frames are baseline
DCT (SOF0) with their Huffman tables in the frame, is read by the same reader.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import key_text, per_batch, texts, type_of

SIDE = 24
FRAME = SIDE * SIDE
MICROSECONDS = 40_000  # a frame's time
BLOCK = 2048  # frames worked on at a time
SLICE = 4_000_000  # bytes of texts or files worked on at a time
#: Fixed: code lengths of the nine categories of differences (bits of the difference) in the frames written here.
LENGTHS = {4: 2, 7: 2, 2: 3, 3: 3, 0: 4, 1: 4, 6: 4, 5: 5, 8: 6}


def canonical(counts, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a JPEG Huffman table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@functools.cache
def written() -> tuple[bytes, np.ndarray, np.ndarray]:
    """The header of all frames written here, and code and length of each category."""
    symbols = sorted(LENGTHS, key=lambda s: (LENGTHS[s], s))
    counts = [sum(n == k for n in LENGTHS.values()) for k in range(1, 17)]
    codes = canonical(counts, symbols)
    header = b"\xff\xd8" + segment(0xC4, bytes([0, *counts, *symbols])) + segment(0xC3, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    return header, np.array([codes[k][0] for k in range(9)]), np.array([codes[k][1] for k in range(9)])


def encode_frames(cells: np.ndarray) -> list[bytes]:
    """JPEG of each row of 576 samples."""
    header, code, length = written()
    out: list[bytes] = []
    for k in range(0, len(cells), BLOCK):
        x = cells[k : k + BLOCK].reshape(-1, SIDE, SIDE).astype(np.int32)
        d = np.empty_like(x)
        d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
        d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
        d[:, 0, 0] = x[:, 0, 0] - 128
        d = d.reshape(len(x), FRAME)
        size = bits_of(np.abs(d))
        value = code[size] << size | (np.where(d < 0, d - 1, d) & ((1 << size) - 1))
        n = length[size] + size
        ends = np.cumsum(n, axis=1)
        first = np.concatenate([[0], np.cumsum((ends[:, -1] + 7) // 8)])  # each frame's first byte
        at = (ends - n + 8 * first[:-1, None]).ravel()
        word, byte = value.ravel() << (24 - n.ravel() - (at & 7)), at >> 3
        total = int(first[-1])
        data = sum(np.bincount(byte + j, (word >> (16 - 8 * j)) & 255, total + 2) for j in range(3))[:total].astype(np.uint8)
        data[first[1:] - 1] |= ((1 << (-ends[:, -1] % 8)) - 1).astype(np.uint8)
        marked = data == 255
        to = np.arange(total) + np.cumsum(marked) - marked  # a zero follows each 255
        stuffed = np.zeros(total + int(marked.sum()), np.uint8)
        stuffed[to] = data
        cuts = np.append(to, len(stuffed))[first].tolist()
        stuffed = stuffed.tobytes()
        out += [header + stuffed[a:b] + b"\xff\xd9" for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


@functools.cache
def bits_table() -> np.ndarray:
    return np.array([k.bit_length() for k in range(512)])


def bits_of(x: np.ndarray) -> np.ndarray:
    return bits_table()[x]


def write_avi(frames: list[bytes], side: int = SIDE, microseconds: int = MICROSECONDS) -> bytes:
    """RIFF AVI with one video stream of JPEG frames and an index."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    group = lambda name, body: b"LIST" + struct.pack("<I", len(body) + 4) + name + body
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", microseconds, 0, 0, 0x10, len(frames), 0, 1, largest, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, microseconds, 1_000_000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    head = group(b"hdrl", chunk(b"avih", avih) + group(b"strl", chunk(b"strh", strh) + chunk(b"strf", strf)))
    sizes = np.array([len(f) for f in frames], np.int64)
    offsets = 4 + np.cumsum(sizes + sizes % 2 + 8) - (sizes + sizes % 2 + 8)
    index = np.empty((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, offsets, sizes
    body = b"AVI " + head + group(b"movi", b"".join([chunk(b"00dc", f) for f in frames])) + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[list[tuple[int, int]], int]:
    """(begin, end) of each video frame, by the index if there is one, else by walking; and microseconds a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, microseconds, at = None, None, MICROSECONDS, 12
    stack = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST" and data[body : body + 4] == b"movi":
                movi = (body, min(end, body + size))
            elif name == b"LIST":
                stack.append((body + 4, min(end, body + size)))
            elif name == b"avih" and size >= 4:
                microseconds = struct.unpack_from("<I", data, body)[0] or MICROSECONDS
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", min(size, len(data) - body) // 16 * 4, body).reshape(-1, 4)
            at = body + size + size % 2
    if movi is None:
        raise ValueError("an AVI file without frames' list")
    if index is not None and len(index):
        video = index[((index[:, 0] >> 16) & 0xFFFF == int.from_bytes(b"dc", "little")) | ((index[:, 0] >> 16) & 0xFFFF == int.from_bytes(b"db", "little"))]
        base = movi[0] if not len(video) or data[movi[0] + int(video[0, 2]) :][:4] == int(video[0, 0]).to_bytes(4, "little") else 0
        begins = base + 8 + video[:, 2].astype(np.int64)
        return list(zip(begins.tolist(), (begins + video[:, 3]).tolist(), strict=True)), microseconds
    spans, at = [], movi[0] + 4
    while at + 8 <= movi[1]:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST":
            at += 12
            continue
        if name[2:] in (b"dc", b"db"):
            spans.append((at + 8, at + 8 + size))
        at += 8 + size + size % 2
    return spans, microseconds


class Header:
    """The segments of a JPEG up to its entropy-coded data."""

    def __init__(self, data: bytes):
        self.quant, self.huffman, self.restart, at = {}, {}, 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(float)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = lookup(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1, 0xC3):
                self.kind, (_, self.height, self.width, n) = marker, struct.unpack_from(">BHHB", body)
                self.parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            elif 0xC0 < marker < 0xD0 and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError(f"JPEG frames of kind {marker:#x} are not read")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                self.predictor = body[1 + 2 * body[0]]
                self.end = at
                return


def lookup(counts, symbols) -> np.ndarray:
    """Symbol * 32 + length for each 16 bits ahead."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, (code, length) in canonical(counts, symbols).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
    return out


@functools.lru_cache(maxsize=64)
def header_of(data: bytes) -> Header:
    return Header(data)


def decode_lossless(header: Header, coded: list[bytes]) -> np.ndarray:
    """Samples of many frames with one lossless header (grey, 8 bits, left predictor): a step for each sample, all frames at once."""
    if header.predictor != 1 or len(header.scan) != 1 or header.restart:
        raise ValueError("lossless frames are read with one component, predictor 1 and no restarts")
    raw = np.frombuffer(b"".join(coded), np.uint8)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 0) | (raw[:-1] != 255)  # zeros that follow 255 are stuffed
    before = np.concatenate([[0], np.cumsum(keep)])
    at = 8 * before[np.concatenate([[0], np.cumsum([len(c) for c in coded])])[:-1]]
    data = np.concatenate([raw[keep], np.full(4, 255, np.uint8)]).astype(np.int32)
    ahead = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    table, n = header.huffman[header.scan[0][1]], header.width * header.height
    most = len(ahead) - 1
    d = np.empty((n, len(coded)), np.int32)
    for k in range(n):
        found = table[ahead[np.minimum(at >> 3, most)] >> (8 - (at & 7)) & 0xFFFF]
        at, size = at + (found & 31), found >> 5
        value = (ahead[np.minimum(at >> 3, most)] >> (8 - (at & 7)) & 0xFFFF) >> (16 - size)
        at = at + size
        d[k] = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
    d = d.T.reshape(-1, header.height, header.width)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8)


@functools.cache
def cosines() -> np.ndarray:
    k = np.arange(8)
    return np.where(k == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)


@functools.cache
def zigzag() -> list[int]:
    return [y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]


def decode_baseline(header: Header, coded: bytes) -> np.ndarray:
    """Luminance samples of one baseline frame, [height, width]. Colour parts are read past: shots need the first part only."""
    parts = [coded]
    if header.restart:
        parts, last, at = [], 0, coded.find(b"\xff")
        while 0 <= at < len(coded) - 1:
            if 0xD0 <= coded[at + 1] <= 0xD7:
                parts.append(coded[last:at])
                last = at + 2
            at = coded.find(b"\xff", at + 2)
        parts.append(coded[last:])
    wide, high = max(p[0] for p in header.parts.values()), max(p[1] for p in header.parts.values())
    across, down = -(-header.width // (8 * wide)), -(-header.height // (8 * high))
    first = header.scan[0][0]
    h, v, q = header.parts[first]
    blocks, order = np.zeros((down * v, across * h, 64)), zigzag()
    unit = 0
    for part in parts:
        part = part.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
        at, dc = 0, dict.fromkeys(header.parts, 0)

        def ahead(at: int, n: int, part=part) -> int:
            return int.from_bytes(part[at >> 3 : (at >> 3) + 5], "big") >> (40 - (at & 7) - n) & (1 << n) - 1

        for _ in range(min(header.restart or across * down, across * down - unit)):
            for name, dc_table, ac_table in header.scan:
                ph, pv, _ = header.parts[name]
                for b in range(ph * pv if len(header.scan) > 1 else 1):
                    cells, k = [0] * 64, 0
                    while k < 64:
                        found = int(header.huffman[16 + ac_table if k else dc_table][ahead(at, 16)])
                        if not found:
                            raise ValueError("a code that the frame's tables lack")
                        at, symbol = at + (found & 31), found >> 5
                        size, run = symbol & 15, symbol >> 4 if k else 0
                        if k and not symbol:
                            break
                        k += run
                        if size and k < 64:
                            value = ahead(at, size)
                            at += size
                            value = value - (1 << size) + 1 if value < 1 << (size - 1) else value
                            if not k:
                                dc[name] += value
                            else:
                                cells[order[k]] = value
                        if not k:
                            cells[0] = dc[name]
                        k += 1
                    if name == first:
                        y, x = divmod(unit, across)
                        blocks[y * v + b // ph, x * h + b % ph] = cells
            unit += 1
    scale = np.zeros(64)
    scale[order] = header.quant[q]
    c = cosines()
    pixels = np.einsum("ki,abkl,lj->aibj", c, (blocks * scale).reshape(*blocks.shape[:2], 8, 8), c)
    rows, cols = -(-header.height * v // high), -(-header.width * h // wide)
    return np.clip(np.rint(pixels.reshape(blocks.shape[0] * 8, -1) + 128), 0, 255).astype(np.uint8)[:rows, :cols]


def decode_frames(jpegs: list[bytes]) -> list[np.ndarray]:
    """Samples of each frame. Lossless frames with one header are decoded together."""
    out: list = [None] * len(jpegs)
    groups: dict[bytes, list[int]] = {}
    head = b""
    for k, j in enumerate(jpegs):
        if not head or not j.startswith(head):
            head = j[: Header(j).end]
        groups.setdefault(head, []).append(k)
    for head, members in groups.items():
        header = header_of(head)
        coded = lambda k: jpegs[k][len(head) : jpegs[k].rindex(b"\xff\xd9")]  # noqa: B023, E731
        if header.kind == 0xC3:
            for b in range(0, len(members), BLOCK):
                part = members[b : b + BLOCK]
                for k, frame in zip(part, decode_lossless(header, [coded(k) for k in part]), strict=True):
                    out[k] = frame
        else:
            for k in members:
                out[k] = decode_baseline(header, coded(k))
    return out


def shots(frames: np.ndarray | list[np.ndarray], owner: np.ndarray, window: int = 12, factor: float = 3.0, least: float = 0.08) -> tuple[np.ndarray, np.ndarray]:
    """Differences of neighbouring frames' histograms (32 bins, 0 to 1) and where a shot begins.

    owner: the file of each frame, in order; a file's first frame begins a shot. Another frame begins one if
    its difference is over `least` and over mean + factor x deviation of up to `window` differences before it
    in its file; with no difference before it, if it is over 0.5.
    """
    n = len(frames)
    hist = np.empty((n, 32))
    for k in range(0, n, BLOCK):
        part = frames[k : k + BLOCK]
        if isinstance(part, np.ndarray):
            flat = (part.reshape(len(part), -1) >> 3) + 32 * np.arange(len(part))[:, None]
            hist[k : k + BLOCK] = np.bincount(flat.ravel(), minlength=32 * len(part)).reshape(-1, 32) / max(1, part[0].size)
        else:
            hist[k : k + BLOCK] = [np.bincount(f.ravel() >> 3, minlength=32) / f.size for f in part]
    new = np.ones(n, bool)
    new[1:] = owner[1:] != owner[:-1]
    d = np.zeros(n)
    d[1:] = np.abs(hist[1:] - hist[:-1]).sum(axis=1) / 2
    d[new] = 0
    d = np.rint(d * 1e6) / 1e6
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    low = np.maximum(start + 1, np.arange(n) - window)
    count = np.maximum(np.arange(n) - low, 0)
    total, squares = np.concatenate([[0], np.cumsum(np.rint(d * 1e6))]), np.concatenate([[0], np.cumsum(np.rint(d * 1e6) ** 2)])
    low = np.minimum(low, np.arange(n))
    mean = (total[np.arange(n)] - total[low]) / np.maximum(count, 1) / 1e6
    var = np.maximum((squares[np.arange(n)] - squares[low]) / np.maximum(count, 1) / 1e12 - mean * mean, 0)
    cut = np.where(count > 0, (d > mean + factor * np.sqrt(var)) & (d > least), d > 0.5)
    return d, new | cut


def to_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media (an AVI file) of every text: its UTF-8 bytes, then bytes 255 up to a positive multiple of 576.

    Null and empty texts give one frame of 255. One row per row of df; very long texts give long files, made
    in blocks of frames.
    """

    def work(batch):
        for begin, end, rows in sliced([t.encode() for t in texts(batch)], SLICE):
            padded = [t + b"\xff" * (-len(t) % FRAME or FRAME * (not t)) for t in rows]
            cells = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, FRAME)
            frames, at, files = encode_frames(cells), 0, []
            for t in padded:
                n = len(t) // FRAME
                files.append(write_avi(frames[at : at + n]))
                at += n
            yield {"key": batch.column("key").slice(begin, end - begin), "n_bytes": [len(t) for t in rows], "media": files}

    return per_batch(key_text(df, key, text), work, f"key {type_of(df, key)}, n_bytes long, media binary").withColumnRenamed("key", key)


def sliced(rows: list[bytes], most: int):
    begin = 0
    while begin < len(rows):
        end, size = begin, 0
        while end < len(rows) and (end == begin or size + len(rows[end]) <= most):
            size += len(rows[end])
            end += 1
        yield begin, end, rows[begin:end]
        begin = end


CLIPS = "array<struct<clip:int,first_frame:long,last_frame:long,start_s:double,end_s:double,peak:double>>"


def probe(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Read every file back: key, frames, the decoded samples' size and digests, the file's, and its clips.

    Null files give nulls and no clips. A file that cannot be read fails the job: nothing is dropped silently.
    """

    def work(batch):
        for begin, end, files in sliced([m or b"" for m in batch.column("media").to_pylist()], SLICE):
            spans = [read_avi(f) if f else ([], MICROSECONDS) for f in files]
            frames = decode_frames([f[a:b] for f, (s, _) in zip(files, spans, strict=True) for a, b in s])
            owner = np.repeat(np.arange(len(files)), [len(s) for s, _ in spans])
            same = len({f.shape for f in frames}) == 1
            d, new = shots(np.array(frames) if same else frames, owner)
            out: dict[str, list] = {c: [] for c in ("frames", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips")}
            at = 0
            for f, (s, microseconds) in zip(files, spans, strict=True):
                own, mine, first = frames[at : at + len(s)], d[at : at + len(s)], np.flatnonzero(new[at : at + len(s)]).tolist()
                at += len(s)
                payload = b"".join([x.tobytes() for x in own])
                out["frames"].append(len(s) if f else None)
                out["payload_bytes"].append(len(payload) if f else None)
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest() if f else None)
                out["tail_crc32"].append(zlib.crc32(payload[-32:]) if f else None)
                out["media_bytes"].append(len(f) if f else None)
                out["media_sha256"].append(hashlib.sha256(f).hexdigest() if f else None)
                second = microseconds / 1e6
                out["clips"].append([{"clip": k, "first_frame": a, "last_frame": b - 1, "start_s": round(a * second, 6), "end_s": round(b * second, 6), "peak": round(float(mine[a:b].max()), 6)} for k, (a, b) in enumerate(zip(first, [*first[1:], len(s)], strict=True))])
            yield {"key": batch.column("key").slice(begin, end - begin)} | out

    schema = f"key {type_of(df, key)}, frames long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips {CLIPS}"
    return per_batch(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{media}`").alias("media")), work, schema).withColumnRenamed("key", key)


def clip_rows(probed: DataFrame, key: str = "doc_id") -> DataFrame:
    """A timed row for each clip of probe()'s files; files without frames have none."""
    return probed.select(key, F.inline("clips"))
