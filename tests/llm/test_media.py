import hashlib
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from foliant.llm import media, queries

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_round_trip_of_any_bytes():
    random.seed(6)
    texts = ["", "a", "x" * 576, "y" * 577, "".join(map(chr, range(32, 1500))), "ÿ" * 900, "\0" * 700, "".join(random.choices("aÿ\uffff", k=5000)), None]
    for t, (payload, found) in zip(texts, media.read_back(media.store(texts)), strict=True):
        assert payload == media.payload_of((t or "").encode()) and len(payload) % 576 == 0
        assert found[0][:2] == (192, len(payload) // 24 * 8)


def test_long_payload_takes_several_pictures(monkeypatch):
    monkeypatch.setattr(media, "MOST_ROWS", 48)
    t = "long text " * 700
    (payload, found), = media.read_back(media.store([t]))
    assert payload == media.payload_of(t.encode()) and len(found) == -(-len(payload) // (48 * 24))


def _bits(pairs):
    out = "".join(f"{c:0{n}b}" for c, n in pairs)
    out += "1" * (-len(out) % 8)
    return bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\0")


def build(width, height, parts, dc, ac, restart=0, quant=16):
    """A baseline picture with three components, the first sampled 2x2, from DC differences and AC symbols."""
    seg = media._segment
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([quant] + [3] * 63)) + seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += seg(0xC4, b"\x00" + dc[0] + dc[1]) + seg(0xC4, b"\x10" + ac[0] + ac[1])
    if restart:
        head += seg(0xDD, restart.to_bytes(2, "big"))
    return head + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + parts + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1])
def test_general_baseline_picture(restart):
    """Sampling, AC symbols with runs and long runs, several units, with and without restarts."""
    rng = random.Random(7)
    dc = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7), bytes(range(12)))
    ac = (bytes([0, 2, 1, 2, 0] + [0] * 11), bytes([0x00, 0x01, 0x12, 0xF0, 0x03]))
    dcc, acc = ({s: (c, n) for s, c, n in media._codes(*t)} for t in (dc, ac))
    units, want, lanes, pred, pairs = 6, [], [], [0, 0, 0], []
    for u in range(units):
        for comp in (0, 0, 0, 0, 1, 2):
            new = rng.randint(-60, 60)
            d, pred[comp] = new - pred[comp], new
            cat = abs(d).bit_length()
            pairs += [dcc[cat]] + ([(d if d > 0 else d + (1 << cat) - 1, cat)] if cat else [])
            k = 1
            for _ in range(rng.randint(0, 5)):
                s = rng.choice([0x01, 0x12, 0xF0, 0x03])
                step = 16 if s == 0xF0 else (s >> 4) + 1
                if k + step > 63:
                    break
                k += step
                pairs += [acc[s]] + ([(rng.getrandbits(s & 15), s & 15)] if s & 15 else [])
            pairs.append(acc[0])
            if comp == 0:
                want.append(new)
        if restart:
            lanes.append(_bits(pairs))
            pairs, pred = [], [0, 0, 0]
    if not restart:
        lanes = [_bits(pairs)]
    data = b"".join(x + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(lanes) else b"") for i, x in enumerate(lanes))
    grey = media.thumbnails(list(media.parse(build(48, 32, data, dc, ac, restart))))[0]
    grid = np.array(want).reshape(2, 3, 2, 2).transpose(0, 2, 1, 3).reshape(4, 6)
    assert (grey == np.clip(np.floor(grid * 16 / 8 + 128.5), 0, 255)).all()


def test_damaged_pictures_have_a_reason(spark):
    good = media.store(["hello"])[0]
    cases = [None, b"", b"GIF89a", good[:60], good[:-30], good.replace(b"\xff\xc0", b"\xff\xc2")]
    df = spark.createDataFrame([(i, c) for i, c in enumerate([good, *cases])], "i int, media binary").select("i", media.media_features("media").alias("f"))
    rows = {r.i: r.f for r in df.collect()}
    assert rows[0].width == 192 and rows[0].error is None and len(rows[0].thumbnail_hash) == 16
    assert all(rows[i].error and rows[i].width is None for i in range(1, len(cases) + 1))


def naive(data):
    """Grey samples and size of each picture of stored bytes, bit by bit: one component, DC terms times their quantiser over eight."""
    out, at = [], 0
    while at < len(data):
        assert data[at : at + 2] == b"\xff\xd8"
        at, tables, samples = at + 2, {}, []
        while data[at : at + 2] != b"\xff\xd9":
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                quant = body[1]
            elif mark == 0xC0:
                height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            elif mark == 0xDD:
                restart = int.from_bytes(body, "big")
            elif mark == 0xC4:
                code, k, found = 0, 17, {}
                for n in range(1, 17):
                    for _ in range(body[n]):
                        found[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code *= 2
                tables[body[0]] = found
            elif mark == 0xDA:
                blocks = (width // 8) * (height // 8)
                while len(samples) < blocks:
                    end = at
                    while data[end] != 0xFF or data[end + 1] == 0:
                        end += 1
                    bits = "".join(f"{x:08b}" for x in data[at:end].replace(b"\xff\0", b"\xff"))
                    i, last = 0, 0

                    def symbol(table):
                        nonlocal i
                        n = next(n for n in range(1, 17) if (n, int(bits[i : i + n], 2)) in table)
                        i += n
                        return table[n, int(bits[i - n : i], 2)]

                    for _ in range(min(restart, blocks - len(samples))):
                        cat = symbol(tables[0])
                        v = int(bits[i : i + cat] or "0", 2)
                        i += cat
                        last += v if not cat or v >> (cat - 1) else v - (1 << cat) + 1
                        assert symbol(tables[0x10]) == 0
                        samples.append(last * quant // 8 + 128)
                    at = end + 2 if 0xD0 <= data[end + 1] <= 0xD7 else end
        at += 2
        out.append((width, height, np.array(samples, np.uint8).reshape(height // 8, width // 8)))
    return out


def naive_hash(grey):
    edge = lambda n, i: min(int(n * i / 8), n - 1)
    cells = [grey[edge(h, i) : max(edge(h, i) + 1, edge(h, i + 1) if i < 7 else h), edge(w, j) : max(edge(w, j) + 1, edge(w, j + 1) if j < 7 else w)] for h, w in [grey.shape] for i in range(8) for j in range(8)]
    means = [c.astype(np.int64).sum() / c.size for c in cells]
    middle = sum(sorted(means)[31:33]) / 2
    return f"{sum(int(m > middle) << (63 - i) for i, m in enumerate(means)):016x}"


def test_stored_bytes_and_features_by_a_naive_decoder(monkeypatch):
    random.seed(8)
    texts = ["", None, "plain words " * 300, "".join(random.choices("aÿ\uffff\x00", k=3000)), "x" * 576, "long text " * 1700]
    monkeypatch.setattr(media, "MOST_ROWS", 144)
    monkeypatch.setattr(media, "STEP_BYTES", 5000)
    stored = media.store(texts)
    for t, m, (payload, found) in zip(texts, stored, media.read_back(stored), strict=True):
        pictures = naive(m)
        assert b"".join(g.tobytes() for *_, g in pictures) == payload == media.payload_of((t or "").encode())
        assert found == [(w, h, naive_hash(g)) for w, h, g in pictures]


def test_memory_of_one_long_text_is_a_few_times_its_size():
    code = "import resource, random; from foliant.llm import media; random.seed(1)\nraw = random.randbytes(24_000_000); base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
    code += "(p, f), = media.read_back(media.encode([media.payload_of(raw)])); assert p[: len(raw)] == raw; print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout) < 400


def test_query(spark):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op5_media(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = media.payload_of(raw)
        stored = media.store([texts[r.doc_id]])[0]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), zlib.crc32(payload[-32:]), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()


def test_odd_rows(odd_docs, no_docs):
    rows = media.media_round_trip(odd_docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and by[1].payload_sha256 == by[2].payload_sha256 and by[5].feature == by[6].feature
    assert media.media_round_trip(no_docs).count() == 0
