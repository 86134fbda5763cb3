"""Files by their headers, JSON by schemas, and values of any depth: literal cases and plain twins."""

import io
import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from foliant.functions import distance, schema
from foliant.operators import assemble, trees
from foliant.sources import headers


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width, height, frames=None):
    more = chunk(b"acTL", struct.pack(">II", frames, 0)) if frames else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + more + chunk(b"IDAT", b"x" * 50) + chunk(b"IEND", b"")


def jpeg(width, height):
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xff\xc2\0\x0b\x08" + struct.pack(">HH", height, width) + b"\x01\x11\0\xff\xda"


def tiff(sizes, order=">"):
    out = io.BytesIO()
    out.write((b"MM\0*" if order == ">" else b"II*\0") + struct.pack(order + "I", 8))
    for i, (w, h) in enumerate(sizes):
        last = i + 1 == len(sizes)
        out.write(struct.pack(order + "H", 2) + struct.pack(order + "HHIHH", 256, 3, 1, w, 0) + struct.pack(order + "HHII", 257, 4, 1, h) + struct.pack(order + "I", 0 if last else out.tell() + 30))
    return out.getvalue()


def pdf(objects, trailer):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in objects.items()) + b"trailer\n<< " + trailer + b" >>\nstartxref\n0\n%%EOF"


TREE = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /MediaBox [0 0 100 200] >>", 3: b"<< /Type /Page /Parent 2 0 R >>", 4: b"<< /Kids [5 0 R 6 0 R] /CropBox [10 10 60 20] >>", 5: b"<< /Type /Page /MediaBox [0 0 1 1] >>", 6: b"<< /Type /Page /CropBox [0 0 30 30] >>"}


def packed(objects):
    """The same objects in a compressed object stream, with a cross-reference stream as trailer."""
    body, where = b"", []
    for n, b in objects.items():
        where += [n, len(body)]
        body += b + b" "
    head = b" ".join(b"%d" % x for x in where) + b" "
    data = zlib.compress(head + body)
    stream = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(objects), len(head), len(data), data)
    return b"%%PDF-1.5\n7 0 obj\n%s\nendobj\n8 0 obj\n<< /Type /XRef /Root 1 0 R >>\nstream\n0\nendstream\nendobj\nstartxref\n0\n%%%%EOF" % stream


@pytest.mark.parametrize(
    "ext,data,want",
    [
        ("png", png(30, 40), (True, None, 1, None, 1200)), ("png", png(30, 40, 5), (True, None, 5, None, 6000)), ("png", png(30, 40)[:-9], (False, None, None, None, 0)), ("png", png(30, 40).replace(b"xx", b"xy", 1), (False, None, None, None, 0)),
        ("jpeg", jpeg(300, 20), (True, None, 1, None, 6000)), ("jpg", b"\xff\xd8\xff\xda\0\x02", (False, None, None, None, 0)), ("jpg", png(1, 1), (False, None, None, None, 0)),
        ("tif", tiff([(10, 20), (30, 40)]), (True, None, 2, None, 1400)), ("tiff", tiff([(10, 20)], "<"), (True, None, 1, None, 200)), ("tiff", tiff([(10, 20)])[:20], (False, None, None, None, None)),
        ("bmp", b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 7, -9), (True, None, 1, None, 63)), ("webp", b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 9 | 19 << 14), (True, None, 1, None, 200)),
        ("webp", b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little") + (b"ANMF" + struct.pack("<I", 2) + b"ab") * 3, (True, None, 3, None, 15000)),
        ("pdf", pdf(TREE, b"/Root 1 0 R"), (True, False, 3, 20000.0, None)), ("pdf", packed(TREE), (True, False, 3, 20000.0, None)), ("pdf", pdf(TREE, b"/Root 1 0 R /Encrypt 9 0 R"), (True, True, 0, 0.0, None)),
        ("pdf", pdf({1: TREE[1], 2: b"<< /Kids [] >>"}, b"/Root 1 0 R"), (True, False, 0, 0.0, None)), ("pdf", pdf({1: TREE[1], 2: b"<< /Kids [2 0 R 2 0 R] >>"}, b"/Root 1 0 R"), (True, False, 0, 0.0, None)), ("pdf", pdf(TREE, b""), (False, None, None, None, None)),
        ("pdf", b"text", (False, None, None, None, None)), ("exe", b"MZ", (None,) * 5), ("csv", b"a,b", (None,) * 5), ("png", b"", (False, None, None, None, 0)), ("png", None, (None,) * 5),
    ],
)
def test_headers(ext, data, want):
    assert headers.header(ext, data) == want


def test_files_of_a_folder(spark, tmp_path):
    given = {"a.png": png(30, 40), "b.pdf": pdf(TREE, b"/Root 1 0 R"), "c.PDF": pdf(TREE, b"/Root 1 0 R /Encrypt 9 0 R"), "d.tiff": tiff([(9, 9)] * 4), "e.txt": b"text", "sub/f.docx": b"PK", "g.jpg": b"no", "h.bmp": b"BM" + b"\0" * 9000, "i.png": png(9000, 9000)}
    for name, data in given.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.filename: (r.error, r.pages) for r in headers.admitted_files(spark, str(tmp_path), most_bytes=5000, most_pages=3).collect()}
    assert got == {"a.png": (None, 1), "b.pdf": (None, 3), "c.PDF": ("encrypted_pdf", None), "d.tiff": ("too_many_pages", None), "e.txt": ("unsupported_type", None), "f.docx": (None, 1), "g.jpg": ("invalid_image", None), "h.bmp": ("too_large", None), "i.png": ("image_too_large", None)}


SCHEMA = {
    "type": "object", "required": ["name"], "$defs": {"box": {"type": "object", "required": ["left"], "properties": {"left": {"type": "number", "minimum": 0}}}},
    "properties": {"name": {"type": "string", "minLength": 2, "pattern": "^[a-z]"}, "size": {"anyOf": [{"type": "integer"}, {"type": "null"}]}, "boxes": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/box"}}, "flag": {"const": True}, "x.y": {"enum": [1, "b", None]}},
    "additionalProperties": {"type": "boolean"},
}


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"name": "ab"}', None), ('{"name": "a"}', "$.name: minLength"), ('{"name": "Ab"}', "$.name: pattern"), ('{"name": 5}', "$.name: type"), ('{"name": null}', "$.name: type"), ("{}", "$: required name"), ("[]", "$: type"), ("null", "$: type"), ("{", "$: JSON"), (None, "$: JSON"),
        ('{"name": "ab", "size": 3.0}', None), ('{"name": "ab", "size": null}', None), ('{"name": "ab", "size": 3.5}', "$.size: anyOf"), ('{"name": "ab", "boxes": []}', "$.boxes: minItems"),
        ('{"name": "ab", "boxes": [{"left": 0}, {"left": 0.5}, {"left": -1}, {}]}', "$.boxes[2].left: minimum"), ('{"name": "ab", "boxes": [{"left": 1}, {}]}', "$.boxes[1]: required left"), ('{"name": "ab", "flag": true}', None), ('{"name": "ab", "flag": 1}', "$.flag: const"),
        ('{"name": "ab", "x.y": null}', None), ('{"name": "ab", "x.y": "c"}', "$.x.y: enum"), ('{"name": "ab", "other": false}', None), ('{"name": "ab", "other": "x"}', "$.other: type"),
    ],
)
def test_schema(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string").select(F.try_parse_json("text").alias("v"))
    assert df.select(schema.violation(F.col("v"), SCHEMA)).first()[0] == want


def test_schemas_without_a_rule_are_refused():
    for bad in ({"oneOf": []}, {"properties": {"a": {"format": "date"}}}):
        with pytest.raises(ValueError):
            schema.violation(F.lit(None), bad)


def random_value(rng, depth):
    kind = rng.randrange(6) if depth else rng.randrange(3)
    if kind < 3:
        return rng.choice([1, 2.5, "text \"q\" é", None, True, "", 700])
    if kind == 3:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 4:
        return {"left": rng.choice([0, 100, 0.2, "x"]), "top": rng.choice([0, 3]), "right": rng.choice([900, 0.5, 1001]), "bottom": rng.choice([4, 1, None]), "z": random_value(rng, depth - 1)}
    return {rng.choice(["a", "b b", "ü", "text"]): random_value(rng, depth - 1) for _ in range(rng.randrange(4))}


def number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def plain(value):
    """The same by recursion: shares of boxes, and fields of chunks."""

    def walk(v):
        if isinstance(v, dict):
            sides = [v.get(s) for s in trees.SIDES]
            if all(map(number, sides)) and any(s > 1 for s in sides) and all(0 <= s <= 1000 for s in sides):
                v.update({s: v[s] / 1000 for s in trees.SIDES})
            for x in v.values():
                walk(x)
        elif isinstance(v, list):
            for x in v:
                walk(x)

    if isinstance(value, dict) and isinstance(value.get("chunks"), list):
        for c in value["chunks"]:
            if isinstance(c, dict):
                c.setdefault("markdown", c.get("text", "") if isinstance(c.get("text", ""), str) else json.dumps(c["text"]) if not isinstance(c["text"], (list, dict)) else "")
                for k, x in trees.DEFAULTS.items():
                    c.setdefault(k, json.loads(x))
    walk(value)
    return value


def first_error(v, path="$"):
    if isinstance(v, dict):
        left, top, right, bottom = (v.get(s) for s in trees.SIDES)
        if all(map(number, (left, top, right, bottom))) and (left >= right or top >= bottom):
            return path + trees.OUT_OF_ORDER
        return next((e for k in sorted(v) if (e := first_error(v[k], f"{path}.{k}"))), None)
    return next((e for i, x in enumerate(v) if (e := first_error(x, f"{path}[{i}]"))), None) if isinstance(v, list) else None


def test_values_of_any_depth_equal_recursion(spark):
    rng = random.Random(4)
    values = [random_value(rng, d % 7) for d in range(60)] + [{"chunks": [random_value(rng, 3) for _ in range(3)], "more": random_value(rng, 5)} for _ in range(20)] + [{}, [], 5, "x", {"chunks": 3}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, None)], "id long, text string").select("id", F.parse_json("text").alias("v"))
    tree = trees.nodes(df, ["id"], "v")
    same = {r.id: json.loads(r.json) for r in trees.rebuilt(tree, ["id"]).collect()}
    assert same == dict(enumerate(values))
    errors = {r.id: r.error for r in trees.geometry_errors(tree, ["id"]).collect()}
    assert errors == {i: e for i, v in enumerate(values) if (e := first_error(v))} and errors
    got = {r.id: json.loads(r.json) for r in trees.rebuilt(trees.normalized(tree, ["id"]), ["id"]).collect()}
    assert got == {i: plain(v) for i, v in enumerate(values)}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance_equals_a_plain_table():
    rng = random.Random(6)
    text = lambda n, letters="ab": "".join(rng.choice(letters) for _ in range(n))
    pairs = [("", ""), ("", "abc"), ("abc", ""), ("kitten", "sitting"), ("é😀", "e😀x")] + [(text(rng.randrange(60)), text(rng.randrange(60))) for _ in range(200)]
    for _ in range(60):
        a = list(text(150, "abcdef"))
        b = list(a)
        for _ in range(rng.randrange(30)):
            i = rng.randrange(len(b))
            b[i : i + rng.randrange(3)] = rng.choice(["", "x", "yz"])
        pairs.append(("".join(a), "".join(b)))
    for a, b in pairs:
        want = plain_distance(a, b)
        assert distance.edit_distance(a, b) == want == distance.edit_distance(b, a)
        for k in (0, 1, 2, 5, 20, 200):
            assert distance.within(a, b, k) == (want if want <= k else None)


def test_long_texts_take_time_as_they_are_long():
    a = "lorem ipsum dolor " * 20_000
    b = a.replace("dolor", "dolar", 3)[:-7] + "!"
    assert distance.edit_distance(a, b) == 3 + 7


def test_placement_in_linear_time():
    """Twice the words take about twice the time, also where hardly any is found."""
    import time

    def took(n):
        words = [f"w{i}" for i in range(n)]
        text, odd = " ".join(words), [w if i % 2 else f"{w}q{i}" for i, w in enumerate(words)]
        began = time.perf_counter()
        found = list(assemble.placements(text, odd))
        assert sum(x is not None for x in found) == n // 2 and all(text[x[0] : x[1]] == w for x, w in zip(found, odd) if x)
        return time.perf_counter() - began

    took(1000)
    assert min(took(40_000) for _ in range(3)) < 4 * min(took(20_000) for _ in range(3))


def test_ink_of_runs_equals_pixels(spark):
    from foliant.functions.geometry import box
    from foliant.operators import quality

    rng = random.Random(8)
    dark = {(p, x, y) for p in range(3) for x in range(50) for y in range(60) if rng.random() < 0.6}
    boxes = [(p, *sorted(rng.sample(range(101), 2)), *sorted(rng.sample(range(101), 2))) for p in range(2) for _ in range(6)]
    px = spark.createDataFrame([(p, x, y, 0 if (p, x, y) in dark else 255) for p in range(3) for x in range(50) for y in range(60)], "page int, x int, y int, gray int")
    b = spark.createDataFrame(boxes, "page int, l int, r int, t int, b int").select("page", box(F.col("l") / 100, F.col("t") / 100, F.col("r") / 100, F.col("b") / 100).alias("box"))
    pages = spark.createDataFrame([(p, 50, 60) for p in range(3)], "page int, width int, height int")
    runs = quality.ink_runs(px, ["page"])
    assert runs.count() < 0.6 * len(dark)
    got = {r.page: round(r.uncovered, 9) for r in quality.uncovered_ink(runs, b, pages, ["page"]).collect()}
    inner = [d for d in dark if 1 <= d[1] <= 49 and 1 <= d[2] <= 58]
    edge = lambda v, grow, size: int((max(0.0, v / 100 - 0.01) if grow < 0 else min(1.0, v / 100 + 0.01)) * size)
    bare = [d for d in inner if not any(d[0] == p and edge(x0, -1, 50) <= d[1] <= edge(x1, 1, 50) and edge(y0, -1, 60) <= d[2] <= edge(y1, 1, 60) for p, x0, x1, y0, y1 in boxes)]
    assert got == {p: round(sum(d[0] == p for d in bare) / sum(d[0] == p for d in inner), 9) for p in range(3)}


def test_resolution_of_whole_pages(spark):
    """Every chunk comes out once, as the two steps say, and no figure stands verified without a description."""
    from foliant.plans import queries

    out = queries.resolved_chunks(spark, "/root/testdata/sf0.001").collect()
    first = {(r.page, r.order): r for r in queries.chunk_resolution(spark, "/root/testdata/sf0.001").collect()}
    assert len(out) == len(first) == len({(r.page, r.order) for r in out}) and all(r.status in ("verified", "candidate", "unresolved") for r in out)
    for r in out:
        before = first[r.page, r.order]
        if r.type == "figure":
            assert r.status == "unresolved" and "figure_description_unavailable" in r.warnings
        elif before.status is not None:
            assert (r.status, r.text, r.warnings) == (before.status, before.text, before.warnings)
        else:
            assert r.source_pass is not None
