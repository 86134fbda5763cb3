"""Box expressions. A box is a struct of left, top, right, bottom in shares of the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold

SIDES = ("left", "top", "right", "bottom")


def box(left, top, right, bottom) -> Column:
    cols = [F.lit(x) if isinstance(x, (int, float)) else x for x in (left, top, right, bottom)]
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(SIDES, cols, strict=True)])


FULL_PAGE = (0.0, 0.0, 1.0, 1.0)


def area(b: Column) -> Column:
    return (b["right"] - b["left"]) * (b["bottom"] - b["top"])


def overlap_over_smaller(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; zero for an empty box."""
    w = F.greatest(F.lit(0.0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]))
    h = F.greatest(F.lit(0.0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    small = F.least(area(a), area(b))
    return F.when(small != 0, w * h / small).otherwise(0.0)


def is_valid(b: Column) -> Column:
    """Within the page, and neither empty nor reversed (V1)."""
    inside = [(b[s] >= 0) & (b[s] <= 1) & ~F.isnan(b[s]) for s in SIDES]
    return F.coalesce(inside[0] & inside[1] & inside[2] & inside[3] & (b["left"] < b["right"]) & (b["top"] < b["bottom"]), F.lit(False))


def parse_model_box(b: Column) -> Column:
    """A box in shares, or in thousandths if any side exceeds one; null if it is neither."""
    sides = [b[s].cast("double") for s in SIDES]
    finite = F.lit(True)
    for s in sides:
        finite = finite & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    scaled = F.when(F.greatest(*sides) > 1, 1000.0).otherwise(1.0)
    out = box(*[s / scaled for s in sides])
    return F.when(finite & (F.least(*sides) >= 0) & (F.greatest(*sides) <= 1000) & is_valid(out), out)


def normalize_points(b: Column, width: Column, height: Column, bottom_left: bool = False) -> Column:
    """A box in page units as shares of the page, clamped; null if nothing is left."""
    cut = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    top, bottom = (height - b["top"], height - b["bottom"]) if bottom_left else (b["top"], b["bottom"])
    out = box(cut(b["left"] / width), cut(top / height), cut(b["right"] / width), cut(bottom / height))
    return F.when((width > 0) & (height > 0) & (out["left"] < out["right"]) & (out["top"] < out["bottom"]), out)


def polygon_box(points: Column) -> Column:
    """The box around an array of points ``x``, ``y``."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def ocr_words(items: Column, width: Column, height: Column) -> Column:
    """Array of ``text, confidence, box`` from recognised words ``text, confidence, points`` in pixels (S8): boxes around the points, cut to the page;
    words without text, points or area are left out."""
    told = F.transform(items, lambda w: F.struct(w["text"].alias("text"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), w["confidence"])).alias("confidence"), normalize_points(polygon_box(w["points"]), width, height).alias("box")))
    return F.filter(told, lambda w: (F.coalesce(w["text"], F.lit("")) != "") & w["box"].isNotNull())


def crop_to_page(crop: Column, inner: Column) -> Column:
    """A box within a crop as a box of the page, to eight places."""
    w, h = crop["right"] - crop["left"], crop["bottom"] - crop["top"]
    at = lambda x: F.bround(x, 8)
    return box(at(crop["left"] + inner["left"] * w), at(crop["top"] + inner["top"] * h), at(crop["left"] + inner["right"] * w), at(crop["top"] + inner["bottom"] * h))


def padded(b: Column, by: float) -> Column:
    """Grown on all sides within the page."""
    return box(F.greatest(F.lit(0.0), b["left"] - by), F.greatest(F.lit(0.0), b["top"] - by), F.least(F.lit(1.0), b["right"] + by), F.least(F.lit(1.0), b["bottom"] + by))


def source_box(b: Column, width: Column, height: Column) -> Column:
    """In units of the source page."""
    return box(b["left"] * width, b["top"] * height, b["right"] * width, b["bottom"] * height)


def source_unit(filename: Column) -> Column:
    return F.when(F.lower(filename).endswith(".pdf"), "pdf_points").otherwise("image_pixels")


def crop_pixels(b: Column, width: Column, height: Column, padding: float = 0.05) -> Column:
    """Pixel box of a padded region, one pixel at least."""
    w, h = (b["right"] - b["left"]) * padding, (b["bottom"] - b["top"]) * padding
    left = F.greatest(F.lit(0), F.expr("int(0)") + ((b["left"] - w) * width).cast("int"))
    top = F.greatest(F.lit(0), ((b["top"] - h) * height).cast("int"))
    right = F.least(width.cast("int"), F.greatest(left + 1, ((b["right"] + w) * width).cast("int")))
    bottom = F.least(height.cast("int"), F.greatest(top + 1, ((b["bottom"] + h) * height).cast("int")))
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


#: The label of text that runs up the side of a page, and how much taller than wide its crop is turned.
SIDEWAYS, TALL = "aside_text", 2


def crop_size(label: Column, pixels: Column) -> Column:
    """``width, height, turned`` of the crop of a pixel box: text that runs up the side is turned by a quarter."""
    width, height = pixels["right"] - pixels["left"], pixels["bottom"] - pixels["top"]
    turned = F.coalesce((casefold(label) == SIDEWAYS) & (height > width * TALL), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"), turned.alias("turned"))


def reading_key(b: Column) -> Column:
    """Order by top, then left; a missing box comes last."""
    return F.struct(F.coalesce(b["top"], F.lit(1.0)).alias("top"), F.coalesce(b["left"], F.lit(1.0)).alias("left"))
