"""Edit distance of long texts (A12): bit-parallel, within a band around the diagonal that grows until the distance fits into it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Half the width of the first band.
BAND = 32


def within(a: str, b: str, k: int) -> int | None:
    """The edit distance of two texts if it is at most ``k``, else null.

    A column of the table is two bit vectors, the vertical steps up and down of the rows within ``k`` of the diagonal; they move down by one
    row with each column. Where ``a`` has a character is kept in blocks as wide as the band, so a column costs as much as the band is wide."""
    if abs(len(a) - len(b)) > k:
        return None
    width = 2 * k + 1
    mask = (1 << width) - 1
    where: dict[str, dict[int, int]] = {}
    for i, c in enumerate(a):
        blocks = where.setdefault(c, {})
        blocks[i // width] = blocks.get(i // width, 0) | 1 << i % width
    up, down, distance = mask >> k << k, 0, min(k, len(a))
    last = len(a) - k  # columns up to here end on the band's lower edge, later ones in the last row
    none: dict[int, int] = {}
    for j, c in enumerate(b, 1):
        block, offset = divmod(j - k - 1, width)
        blocks = where.get(c, none)
        match = (blocks.get(block, 0) >> offset | blocks.get(block + 1, 0) << width - offset) & mask if blocks else 0
        diagonal = ((match & up) + up ^ up | match | down) & mask
        right, left = (down | ~(diagonal | up)) & mask, diagonal & up
        if j <= last:
            distance += not diagonal >> 2 * k & 1
        else:
            row = len(a) - j + k
            distance += (right >> row & 1) - (left >> row & 1)
        below = diagonal >> 1
        up, down = (left | ~(below | right)) & mask, below & right
    return distance if distance <= k else None


def edit_distance(a: str, b: str) -> int:
    """The least number of characters to insert, delete or replace. What two texts have in common at both ends costs nothing."""
    if a == b:
        return 0
    start, end = 0, 0
    least = min(len(a), len(b))
    step = 1 << max(least.bit_length() - 1, 0)
    while step:  # the common beginning, by halves
        if start + step <= least and a[start : start + step] == b[start : start + step]:
            start += step
        else:
            step //= 2
    least -= start
    step = 1 << max(least.bit_length() - 1, 0)
    while step:
        if end + step <= least and a[len(a) - end - step : len(a) - end] == b[len(b) - end - step : len(b) - end]:
            end += step
        else:
            step //= 2
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    k = max(BAND, abs(len(a) - len(b)))
    while (found := within(a, b, k)) is None:
        k *= 2
    return found


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def text_accuracy(got: Column, reference: Column) -> Column:
    """One less the edit distance over the reference's length, at least zero; an empty reference gives 1 or 0. For texts of any length; short ones
    are as well served by ``char_accuracy``, which needs no Python."""
    return F.when(F.length(reference) == 0, F.when(F.length(got) == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - _distance(got, reference) / F.length(reference)))
