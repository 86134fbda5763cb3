"""What the headers of files say: pages, sizes and encryption of PDFs and images.

Files come as bytes, from Spark's own reader of binary files or any table. Small parsers, one for each format, run in Arrow batches; what they find
are plain columns, and admission stays a plan over columns."""

from __future__ import annotations

import re
import zlib
from struct import error, unpack, unpack_from

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import batch

FOUND = T.StructType([T.StructField("readable", T.BooleanType()), T.StructField("encrypted", T.BooleanType()), T.StructField("page_count", T.IntegerType()), T.StructField("canvas_area", T.DoubleType()), T.StructField("pixels", T.LongType())])
#: Frames of an image as width and height; none if it can't be read.
Frames = list[tuple[int, int]]

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_TRAILER, _ROOT, _PAGES = re.compile(rb"trailer\s*<<(.*?)startxref", re.S), re.compile(rb"/Root\s+(\d+)\s+\d+\s+R"), re.compile(rb"/Pages\s+(\d+)\s+\d+\s+R")
_KIDS, _REFERENCE = re.compile(rb"/Kids\s*\[(.*?)\]", re.S), re.compile(rb"(\d+)\s+\d+\s+R")
_BOX = {name: re.compile(rb"/" + name + rb"\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s*\]") for name in (b"CropBox", b"MediaBox")}


def _packed(body: bytes) -> dict[int, bytes]:
    """Objects of an object stream."""
    start = re.search(rb"stream\r?\n", body)
    count, first = re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body)
    if not (start and count and first):
        return {}
    data = body[start.end() : body.rfind(b"endstream")]
    if b"/FlateDecode" in body[: start.start()]:
        data = zlib.decompressobj().decompress(data)
    where = [int(x) for x in data[: int(first[1])].split()[: 2 * int(count[1])]]
    starts = [int(first[1]) + at for at in where[1::2]]
    return {number: data[a:b] for number, a, b in zip(where[::2], starts, [*starts[1:], len(data)], strict=True)}


def pdf_pages(data: bytes) -> tuple[bool, list[float]] | None:
    """Whether a PDF is encrypted, and the area of each of its pages, found along the page tree with the boxes that pages inherit; None if there is no such
    tree. Any encryption counts, one with an empty password as well; pages of an encrypted file aren't looked at."""
    if b"%PDF-" not in data[:1024]:
        return None
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    heads = [m[1] for m in _TRAILER.finditer(data)] + [b for b in objects.values() if re.search(rb"/Type\s*/XRef\b", b)]
    if any(b"/Encrypt" in h for h in heads):
        return True, []
    for body in [b for b in objects.values() if re.search(rb"/Type\s*/ObjStm\b", b)]:
        objects = _packed(body) | objects
    root = next((int(m[1]) for h in reversed(heads) if (m := _ROOT.search(h))), None)
    tree = _PAGES.search(objects.get(root, b""))
    if not tree or int(tree[1]) not in objects:
        return None
    areas, seen, todo = [], set(), [(int(tree[1]), {})]
    while todo:
        number, boxes = todo.pop()
        if number in seen or number not in objects:
            continue
        seen.add(number)
        boxes = boxes | {name: [float(x) for x in m.groups()] for name, pattern in _BOX.items() if (m := pattern.search(objects[number]))}
        if kids := _KIDS.search(objects[number]):
            todo += [(int(k), boxes) for k in reversed(_REFERENCE.findall(kids[1]))]
        elif number != int(tree[1]):
            box = boxes.get(b"CropBox") or boxes.get(b"MediaBox") or [0, 0, 612, 792]
            areas.append(abs((box[2] - box[0]) * (box[3] - box[1])))
    return False, areas


def png_frames(data: bytes) -> Frames:
    """All chunks up to the end must hold their checksums."""
    at, size, frames = 8, None, 1
    while data[:8] == b"\x89PNG\r\n\x1a\n" and at + 12 <= len(data):
        n, kind = unpack_from(">I4s", data, at)
        if len(data) < at + 12 + n or zlib.crc32(data[at + 4 : at + 8 + n]) != unpack_from(">I", data, at + 8 + n)[0]:
            break
        if kind == b"IHDR":
            size = unpack_from(">II", data, at + 8)
        elif kind == b"acTL":
            frames = unpack_from(">I", data, at + 8)[0]
        elif kind == b"IEND":
            return [size] * frames if size else []
        at += 12 + n
    return []


def jpeg_frames(data: bytes) -> Frames:
    """The size stands in the first frame header; a scan without one isn't a picture."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD7:
            at += 1 if kind == 0xFF else 2
            continue
        if kind in (0xD9, 0xDA):
            break
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = unpack_from(">HH", data, at + 5)
            return [(width, height)]
        at += 2 + unpack_from(">H", data, at + 2)[0]
    return []


def tiff_frames(data: bytes) -> Frames:
    """One frame for each directory of the chain."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    out, seen = [], set()
    at = unpack_from(order + "I", data, 4)[0] if order else 0
    while at and at not in seen:
        seen.add(at)
        n, tags = unpack_from(order + "H", data, at)[0], {}
        for i in range(n):
            tag, kind, _ = unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if tag in (256, 257):
                tags[tag] = unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * i)[0]
        if len(tags) < 2:
            return []
        out.append((tags[256], tags[257]))
        at = unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return out


def bmp_frames(data: bytes) -> Frames:
    if data[:2] != b"BM":
        return []
    width, height = unpack_from("<HH" if unpack_from("<I", data, 14)[0] == 12 else "<ii", data, 18)
    return [(abs(width), abs(height))]


def webp_frames(data: bytes) -> Frames:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        return []
    kind = data[12:16]
    if kind == b"VP8X":
        size = tuple(int.from_bytes(data[i : i + 3], "little") + 1 for i in (24, 27))
        at, frames = 12, 0
        while at + 8 <= len(data):
            frames += data[at : at + 4] == b"ANMF"
            n = unpack_from("<I", data, at + 4)[0]
            at += 8 + n + n % 2
        return [size] * max(frames, 1)
    if kind == b"VP8L" and data[20] == 0x2F:
        bits = unpack_from("<I", data, 21)[0]
        return [((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)]
    if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
        width, height = unpack_from("<HH", data, 26)
        return [(width & 0x3FFF, height & 0x3FFF)]
    return []


_IMAGES = {"png": png_frames, "jpg": jpeg_frames, "jpeg": jpeg_frames, "tif": tiff_frames, "tiff": tiff_frames, "bmp": bmp_frames, "webp": webp_frames}


def header(ext: str, data: bytes | None) -> tuple:
    """``readable, encrypted, page_count, canvas_area`` (of the largest page) and ``pixels`` (of all frames), as far as a format has them."""
    if data is None or ext not in _IMAGES and ext != "pdf":
        return None, None, None, None, None
    try:
        if ext == "pdf":
            found = pdf_pages(data)
            return (False, None, None, None, None) if found is None else (True, found[0], len(found[1]), max(found[1], default=0.0), None)
        frames = _IMAGES[ext](data)
        return bool(frames), None, len(frames) or None, None, sum(w * h for w, h in frames)
    except (error, IndexError, ValueError, zlib.error):
        return False, None, None, None, None


@F.pandas_udf(FOUND)
def _headers(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header(e, c) for e, c in zip(ext, content, strict=True)], columns=FOUND.names, dtype=object)


def inspected(files: DataFrame, content: Column | None = None) -> DataFrame:
    """``files`` (``filename, content``) with ``readable, encrypted, page_count, canvas_area, pixels`` instead of the content."""
    data = F.col("content") if content is None else content
    found = files.withColumn("found", _headers(batch.suffix(F.col("filename")), data))
    return found.select(*[c for c in files.columns if c != "content"], "found.*")


def admitted_files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int = batch.MOST_BYTES, most_pages: int = batch.MOST_PAGES) -> DataFrame:
    """``path, filename, size, error, mime_type, pages`` of all files below a folder. Files that are too large are never read: the limit reaches Spark's reader."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    named = raw.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.col("length").alias("size"), "content")
    small = inspected(named.where(F.col("size") <= most_bytes))
    large = named.where(F.col("size") > most_bytes).drop("content").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in FOUND])
    return batch.admitted(small.unionByName(large), most_bytes, most_pages).select("path", "filename", "size", "error", "mime_type", "pages")
