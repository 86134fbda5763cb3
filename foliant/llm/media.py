"""Baseline JPEG: bytes stored as the DC terms of grey 8x8 blocks, and read back through a general baseline decoder.

The writer gives each sample one block whose DC term, at a quantiser of 8, is the sample less 128; that is lossless.
A restart interval covers twelve rows of 24 blocks, so a reader can decode all intervals of a batch of pictures at once.
The reader parses markers, builds tables from DHT and DQT, Huffman-decodes all DC and AC symbols of a baseline scan
(any sampling, with or without restarts) and reconstructs the luminance thumbnail from the DC terms alone, in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced

#: Samples of a row; payloads are padded to a multiple of ``ROW * ROW``, the smallest picture.
ROW, PAD = 24, 255
#: Samples of one restart interval.
LANE = ROW * 12
#: Most rows of one picture; a longer payload is stored as several pictures, one after the other.
MOST_ROWS = 65535 // 8 // ROW * ROW
#: Payload bytes that one step turns into arrays.
STEP_BYTES = 1 << 20
#: Zigzag position of each coefficient is not needed for DC; quantiser of 8 for DC, 1 elsewhere.
QUANT = bytes([8] + [1] * 63)
#: Code lengths of the DC categories 0 to 8 that the writer uses: counts for lengths 1 to 16, then the symbols.
DC_COUNTS = bytes([0, 0, 7, 1, 1] + [0] * 11)
DC_SYMBOLS = bytes([5, 6, 4, 7, 3, 2, 0, 1, 8])
AC_COUNTS = bytes([1] + [0] * 15)
AC_SYMBOLS = bytes([0])


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """Canonical Huffman codes: ``(symbol, code, length)``."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=1)
def _writer_table() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255 to 255: its bits with end-of-block, left-aligned in 16, and their number."""
    dc = {s: (c, n) for s, c, n in _codes(DC_COUNTS, DC_SYMBOLS)}
    bits, size = np.zeros(511, np.uint16), np.zeros(511, np.uint8)
    for diff in range(-255, 256):
        cat = abs(diff).bit_length()
        code, n = dc[cat]
        value = diff if diff >= 0 else diff + (1 << cat) - 1
        total = n + cat + 1
        bits[diff + 255] = ((code << cat | value) << 1) << (16 - total)
        size[diff + 255] = total
    return bits, size


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=4096)
def _header(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8", _segment(0xDB, b"\0" + QUANT), _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS), _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
        _segment(0xDD, struct.pack(">H", LANE)), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def _encoded(pictures: list[bytes]) -> list[bytes]:
    """The samples of each picture, of a multiple of 24, as one JPEG."""
    table, sizes = _writer_table()
    data = np.frombuffer(b"".join(pictures), np.uint8).astype(np.int16)
    # a lane is one restart interval: LANE samples, fewer at the end of a picture
    lane_size = np.array([min(LANE, len(p) - a) for p in pictures for a in range(0, len(p), LANE)], np.int64)
    firsts = np.cumsum(lane_size) - lane_size
    diff = np.empty_like(data)
    diff[1:] = data[1:] - data[:-1]
    diff[firsts] = data[firsts] - 128
    diff += 255
    word, size = table[diff], sizes[diff]
    # bits before each symbol, with every lane filled up to a whole byte
    ends = np.cumsum(size, dtype=np.int64)
    used = np.diff(ends[firsts + lane_size - 1], prepend=0)
    padded = (used + 7) >> 3
    starts = np.cumsum(padded) - padded
    at = ends - size + np.repeat(starts * 8 - (np.cumsum(used) - used), lane_size)
    total = int(padded.sum())
    cell = at >> 4
    spread = word.astype(np.uint32) << (16 - (at & 15)).astype(np.uint32)
    n = (total + 1) // 2 + 1
    words = np.bincount(cell, spread >> 16, n) + np.bincount(cell + 1, spread & 0xFFFF, n + 1)[:n]
    data = words.astype(">u2").view(np.uint8)[:total].copy()
    stops = starts + padded
    data[stops - 1] |= ((1 << (padded * 8 - used)) - 1).astype(np.uint8)
    raw, full = data.tobytes(), np.add.reduceat(data == 0xFF, starts)
    bounds, stuffed = list(zip(starts.tolist(), stops.tolist(), strict=True)), full.tolist()
    out, lane = [], 0
    for p in pictures:
        parts, count = [_header(len(p) // ROW)], -(-len(p) // LANE)
        for i in range(count):
            first, last = bounds[lane]
            piece = raw[first:last]
            parts.append(piece.replace(b"\xff", b"\xff\0") if stuffed[lane] else piece)
            parts.append(_RESTARTS[i & 7] if i + 1 < count else b"\xff\xd9")
            lane += 1
        out.append(b"".join(parts))
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a multiple of 24 bytes, as one JPEG, or several in a row beyond ``MOST_ROWS``. At most ``STEP_BYTES`` of samples, or one
    picture, are arrays at a time, however long a payload is."""
    most = MOST_ROWS * ROW
    places = [(i, a) for i, p in enumerate(payloads) for a in range(0, len(p), most)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for a, b in sliced([min(most, len(payloads[i]) - top) for i, top in places], STEP_BYTES):
        for (i, _), picture in zip(places[a:b], _encoded([payloads[i][top : top + most] for i, top in places[a:b]]), strict=True):
            out[i].append(picture)
    return [b"".join(x) for x in out]


_RESTARTS = [bytes([0xFF, 0xD0 + i]) for i in range(8)]


@dataclass
class Picture:
    """What the markers of one baseline JPEG say, and its entropy-coded lanes, unstuffed."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, h, v, quantiser)
    quant: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # (class, id) -> (counts, symbols)
    restart: int = 0
    scan: list = field(default_factory=list)  # (component index, dc table, ac table)
    lanes: list = field(default_factory=list)


class BadPicture(ValueError):
    """Not a baseline JPEG, or a damaged one."""


def parse(data: bytes) -> Iterator[Picture]:
    """The pictures of a byte string, one after the other."""
    at = 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise BadPicture("no start of image")
        pic, at = Picture(), at + 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if len(data) < at + 4 and data[at : at + 2] != b"\xff\xd9":
                raise BadPicture("ends within its markers")
            marker = data[at + 1]
            if data[at] != 0xFF:
                raise BadPicture("no marker")
            if marker == 0xD9:
                at += 2
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    n = 128 if wide else 64
                    pic.quant[body[i] & 15] = struct.unpack(">64H" if wide else ">64B", body[i + 1 : i + 1 + n])
                    i += 1 + n
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    counts = body[i + 1 : i + 17]
                    n = sum(counts)
                    pic.tables[body[i] >> 4, body[i] & 15] = (counts, body[i + 17 : i + 17 + n])
                    i += 17 + n
            elif marker in (0xC0, 0xC1):
                depth, pic.height, pic.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise BadPicture("not 8 bits")
                pic.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise BadPicture("not baseline")
            elif marker == 0xDD:
                pic.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                ids = [c[0] for c in pic.components]
                pic.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                lanes, start = [], at
                while True:
                    at = data.find(b"\xff", at)
                    if at < 0 or at + 1 >= len(data):
                        raise BadPicture("ends within its scan")
                    code = data[at + 1]
                    if code == 0:
                        at += 2
                    elif 0xD0 <= code <= 0xD7:
                        lanes.append(data[start:at])
                        at = start = at + 2
                    else:
                        lanes.append(data[start:at])
                        break
                pic.lanes = [x.replace(b"\xff\0", b"\xff") if b"\xff" in x else x for x in lanes]
        if not pic.scan or not pic.components:
            raise BadPicture("no scan")
        yield pic


@lru_cache(maxsize=64)
def _symbol_table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16-bit window; length 0 where no code fits."""
    sym, size = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
    for s, code, n in _codes(counts, symbols):
        a = code << (16 - n)
        sym[a : a + (1 << (16 - n))] = s
        size[a : a + (1 << (16 - n))] = n
    return sym, size


@lru_cache(maxsize=64)
def _block_table(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> np.ndarray:
    """``difference << 8 | bits`` of a whole block, for windows in which a DC symbol and the end of block both lie; 0 elsewhere."""
    out = np.zeros(65536, np.int32)
    ends = [(c, n) for s, c, n in _codes(*ac) if s == 0]
    for cat, code, n in _codes(*dc):
        for end, m in ends:
            total = n + cat + m
            if total <= 16:
                value = np.arange(1 << cat)
                d = np.where(value >= (1 << cat >> 1), value, value - (1 << cat) + 1) if cat else value
                first = ((code << cat | value) << m | end) << (16 - total)
                span = 1 << (16 - total)
                out[(first[:, None] + np.arange(span)).ravel()] = np.repeat(d << 8 | total, span)
    return out


def _dc_lanes(lanes: list[bytes], blocks: np.ndarray, plan: list[tuple[int, tuple, tuple]]) -> np.ndarray:
    """DC terms for each lane and block. ``plan``: component and tables of the blocks of one MCU, over and over."""
    n, most = len(lanes), int(blocks.max(initial=0))
    order = np.argsort(-blocks, kind="stable")  # lanes that go on stay in front
    lengths = np.array([len(lanes[i]) for i in order], np.int64)
    buf = np.frombuffer(b"".join(x for i in order for x in (lanes[i], b"\xff\xff\xff\xff")) + bytes(2 * most + 16), np.uint8)
    limit = (np.cumsum(lengths + 4) - 4) * 8
    pos = ((np.cumsum(lengths + 4) - lengths - 4) * 8).astype(np.int64 if len(buf) > 1 << 27 else np.int32)
    window = buf[:-2].astype(np.uint32)
    window <<= 8
    window |= buf[1:-1]
    window <<= 8
    window |= buf[2:]
    furthest = (len(window) - 2 * most - 8) * 8
    still = np.searchsorted(-blocks[order], -np.arange(most), side="left").tolist()
    out = np.zeros((most, n), np.int32)
    tables = [_block_table(dc, ac) for _, dc, ac in plan]

    def peek(p: np.ndarray) -> np.ndarray:
        return (window[np.minimum(p >> 3, len(window) - 1)] >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF

    for k in range(most):
        live = still[k]
        p = pos[:live]
        got = tables[k % len(plan)][(window[p >> 3] >> (8 - (p & 7)).view(np.uint32 if p.itemsize == 4 else np.uint64)) & 0xFFFF]
        used = got & 255
        got >>= 8
        if not used.all():
            slow = np.flatnonzero(used == 0)
            _, dc, ac = plan[k % len(plan)]
            got[slow], end = _slow_block(p[slow].astype(np.int64), peek, dc, ac)
            if (end > furthest).any():
                raise BadPicture("scan data runs out")
            used[slow] = end - p[slow]
        p += used
        out[k, :live] = got
    if (pos > limit).any():
        raise BadPicture("scan data runs out")
    for c in {c for c, _, _ in plan}:
        own = [k for k in range(most) if plan[k % len(plan)][0] == c]
        if len(own) == most:
            np.cumsum(out, axis=0, out=out)
        else:
            out[own] = np.cumsum(out[own], axis=0)
    back = np.empty((n, most), np.int32)
    back[order] = out.T
    return back


def _slow_block(p: np.ndarray, peek, dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray]:
    """One block of each of some lanes, symbol by symbol: DC difference, and the position after the block."""
    sym, size = _symbol_table(*dc)
    w = peek(p)
    cat, n = sym[w].astype(np.int64), size[w].astype(np.int64)
    if (n == 0).any():
        raise BadPicture("no such code")
    p = p + n
    value = peek(p).astype(np.int64) >> (16 - cat)
    d = np.where((cat > 0) & (value < (1 << np.maximum(cat, 1) >> 1)), value - (1 << cat) + 1, value)
    p = p + cat
    sym, size = _symbol_table(*ac)
    k, live = np.ones(len(p), np.int64), np.arange(len(p))
    while len(live):
        w = peek(p[live])
        s, n = sym[w].astype(np.int64), size[w].astype(np.int64)
        if (n == 0).any():
            raise BadPicture("no such code")
        run, bits = s >> 4, s & 15
        p[live] += n + bits
        k[live] += np.where(bits > 0, run + 1, np.where(run == 15, 16, 64))
        live = live[k[live] < 64]
    return d.astype(np.int32), p


def thumbnails(pictures: list[Picture]) -> list[np.ndarray]:
    """Luminance thumbnail of each picture, one sample for each 8x8 block, from DC terms alone. Pictures of the same
    layout are decoded side by side."""
    groups: dict[tuple, list[int]] = {}
    for i, pic in enumerate(pictures):
        try:
            key = tuple((c, pic.components[c][1:3], pic.tables[0, a], pic.tables[1, b]) for c, a, b in pic.scan)
        except KeyError as e:
            raise BadPicture("no such table") from e
        groups.setdefault((len(pic.components), key), []).append(i)
    out: list[np.ndarray | None] = [None] * len(pictures)
    for (_, key), members in groups.items():
        alone = len(key) == 1
        plan = [(c, dc, ac) for c, (h, v), dc, ac in key for _ in range(1 if alone else h * v)]
        lanes, blocks, shapes = [], [], []
        for i in members:
            pic = pictures[i]
            hm, vm = max(c[1] for c in pic.components), max(c[2] for c in pic.components)
            h, v = key[0][1]
            if alone:  # its own blocks, in rows
                wide, high = -(-pic.width * h // (8 * hm)), -(-pic.height * v // (8 * vm))
            else:
                wide, high = -(-pic.width // (8 * hm)), -(-pic.height // (8 * vm))
            units, step = wide * high, pic.restart or wide * high
            need = [min(step, units - a) * len(plan) for a in range(0, units, step)]
            if len(need) != len(pic.lanes):
                raise BadPicture("restart intervals are missing")
            shapes.append((wide, high, h, v, len(lanes), len(need)))
            lanes += pic.lanes
            blocks += need
        dc = _dc_lanes(lanes, np.array(blocks, np.int64), plan)
        blocks = np.array(blocks)
        mine = [j for j, (c, _, _) in enumerate(plan) if c == key[0][0]]
        for i, (wide, high, h, v, a, n) in zip(members, shapes, strict=True):
            pic = pictures[i]
            got = dc[a : a + n]
            if (blocks[a : a + n] == got.shape[1]).all():
                flat = got.reshape(-1, len(plan))
            else:
                flat = np.concatenate([got[j, : blocks[a + j]] for j in range(n)]).reshape(-1, len(plan))
            flat = flat[:, mine]
            grid = flat.reshape(high, wide) if alone else flat.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
            grey = np.clip(np.floor(grid * (pic.quant[pic.components[key[0][0]][3]][0] / 8) + 128.5), 0, 255).astype(np.uint8)
            hm, vm = max(c[1] for c in pic.components), max(c[2] for c in pic.components)
            out[i] = grey[: -(-pic.height * v // (8 * vm)), : -(-pic.width * h // (8 * hm))]
    return out


def thumbnail_hash(grey: np.ndarray) -> str:
    """64 bits in hex: each cell of an 8x8 grid of means against the median of the grid."""
    rows = np.linspace(0, grey.shape[0], 9).astype(int)
    cols = np.linspace(0, grey.shape[1], 9).astype(int)
    rows, cols = np.minimum(rows[:-1], grey.shape[0] - 1), np.minimum(cols[:-1], grey.shape[1] - 1)
    sums = np.add.reduceat(np.add.reduceat(grey.astype(np.int64), rows, axis=0), cols, axis=1)
    areas = np.maximum(np.diff([*rows, grey.shape[0]]), 1)[:, None] * np.maximum(np.diff([*cols, grey.shape[1]]), 1)
    means = sums / areas
    return np.packbits((means > np.median(means)).ravel()).tobytes().hex()


def payload_of(raw: bytes) -> bytes:
    unit = ROW * ROW
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, bytes([PAD]))


def store(texts: list[str | None]) -> list[bytes]:
    """Each text's payload as JPEG bytes; null counts as empty."""
    payloads = [payload_of((t or "").encode("utf-8", "surrogatepass")) for t in texts]
    return [x for a, b in sliced(map(len, payloads), STEP_BYTES) for x in encode(payloads[a:b])]


def read_back(media: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, str]]]]:
    """Of each byte string: the samples of its thumbnails in order, and ``(width, height, hash)`` of each picture. Pictures are decoded
    side by side, about ``STEP_BYTES`` of scan data at a time."""
    samples: list[list[bytes]] = [[] for _ in media]
    found: list[list[tuple[int, int, str]]] = [[] for _ in media]
    held, size = [], 0

    def decoded() -> None:
        for (i, p), grey in zip(held, thumbnails([p for _, p in held]), strict=True):
            samples[i].append(grey.tobytes())
            found[i].append((p.width, p.height, thumbnail_hash(grey)))

    for i, m in enumerate(media):
        for p in parse(m):
            held.append((i, p))
            size += sum(map(len, p.lanes))
            if size >= STEP_BYTES:
                decoded()
                held, size = [], 0
    if held:
        decoded()
    return [(b"".join(x), y) for x, y in zip(samples, found, strict=True)]


@F.pandas_udf(T.BinaryType())
def as_media(text: pd.Series) -> pd.Series:
    return pd.Series(store(text.tolist()))


_FEATURES = T.StructType([T.StructField(n, t) for n, t in (("width", T.LongType()), ("height", T.LongType()), ("pictures", T.IntegerType()), ("thumbnail_hash", T.StringType()), ("error", T.StringType()))])


@F.pandas_udf(_FEATURES)
def media_features(media: pd.Series) -> pd.DataFrame:
    """Dimensions and thumbnail hashes of JPEG bytes: sizes of the first picture, hashes of all joined by ``-``; a
    damaged or missing picture has nulls and a reason."""
    rows = []
    for m in media:
        try:
            if m is None:
                raise BadPicture("null")
            (_, found), = read_back([m])
            rows.append((found[0][0], found[0][1], len(found), "-".join(x[2] for x in found), None))
        except (BadPicture, IndexError, ValueError, struct.error) as e:
            rows.append((None, None, 0, None, str(e)))
    return pd.DataFrame(rows, columns=[f.name for f in _FEATURES]).astype({"width": "Int64", "height": "Int64"})


def media_column(docs: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """``docs`` with each text stored as JPEG bytes in ``out_col``. Null text: the picture of an empty payload. Rows and other columns
    are kept as they are, repeated rows and null ids too; a column of the name ``out_col`` is replaced."""
    return docs.withColumn(out_col, as_media(F.col(text_col)))


_ROUND_TRIP = T.StructType([T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))])


@F.pandas_udf(_ROUND_TRIP)
def _round_trip(text: pd.Series) -> pd.DataFrame:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in text]
    rows = []
    for a, b in sliced(map(len, raw), STEP_BYTES):
        media = encode([payload_of(r) for r in raw[a:b]])
        for r, m, (payload, found) in zip(raw[a:b], media, read_back(media), strict=True):
            feature = ";".join(f"{w}x{h}:{x}" for w, h, x in found)
            rows.append((len(r), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
    return pd.DataFrame(rows, columns=[f.name for f in _ROUND_TRIP])


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as JPEG, read the stored bytes back, and describe both. Null text counts as empty; rows are kept
    as they are, repeated ones too, and other columns are ignored. Nothing is shuffled."""
    return docs.select(F.col(id_col).alias("doc_id"), _round_trip(F.col(text_col)).alias("m")).select("doc_id", "m.*")
