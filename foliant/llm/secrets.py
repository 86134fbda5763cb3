"""Secret scans: fixed patterns, and a battery of randomness tests for tokens of no known pattern.

A candidate is a run of 16 or more characters of ``[A-Za-z0-9+/_=-]`` outside the fixed patterns. Its encoding is the smallest
alphabet that holds it. Three tests look at it: chi-squared uniformity, runs above and below the middle of the alphabet,
and the serial test of adjacent characters. Each test has two sides:

* For *random* characters of the alphabet, Fisher's method combines uniformity, runs and serial correlation; a token that this
  rejects is no secret.
* For *text*, each test gives the chance that text of this length looks as random as the token does. What text looks like is
  counted over all documents: how often each character follows each other within words of fewer than 16 characters. Cauchy's
  combination, which allows for tests that depend on each other, makes one p-value of the three.

The p-values of all candidates of all documents go through one step-up rule of Benjamini and Hochberg, weighted by the bits that a
token can hold: counts of their magnitudes decide one threshold, so false discoveries are bounded over the whole corpus.
Only those counts, and the counts of character pairs, reach the driver.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, materialise, sliced

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_ASSIGNED, ALPHA_RANDOM, FALSE_DISCOVERIES = 12, 1e-3, 1e-3
#: Alphabets by inferred encoding, smallest first.
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"),
)
_SETS = [(name, frozenset(chars), np.array([chars.find(chr(i)) for i in range(128)]), len(chars)) for name, chars in ENCODINGS]
#: Characters of candidates in the order of the pair counts, by class: lower, upper, digits, others.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CLASS = np.repeat(np.arange(4), (26, 26, 10, 5))
_INDEX = np.full(256, -1, np.int16)
_INDEX[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
_K = len(SYMBOLS)
#: Weight, in pairs after each character, of what is believed before any text is counted: the next character is of the same class
#: with this chance, all of a class being alike. Surprise of one pair counts no more than ``MOST_BITS``. Text varies more than
#: independent pairs do: its variances are taken ``DISPERSION`` times.
PRIOR_PAIRS, SAME_CLASS, MOST_BITS, DISPERSION = 200.0, 0.9, 10.0, 2.0
#: Steps of a decade in which magnitudes of p-values are counted, and the largest magnitude.
STEPS, DECADES = 20, 40


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by Wilson and Hilferty's cube root."""
    return _normal_tail(((max(x, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def pair_counts(texts: list[str | None]) -> np.ndarray:
    """How often each symbol follows each other in the runs of fewer than 16 symbols of some texts. About ``SLICE_BYTES`` are arrays at a time, cut at
    blanks and line ends."""
    total = np.zeros(_K * _K, np.int64)
    for t in texts:
        total += _counted((t or "").encode("utf-8", "surrogatepass")) if len(t or "") > SLICE_BYTES else 0
    short = [t for t in texts if t and len(t) <= SLICE_BYTES]
    for a, b in sliced(map(len, short)):
        total += _counted("\n".join(short[a:b]).encode("utf-8", "surrogatepass"))
    return total


def _counted(raw: bytes) -> np.ndarray:
    total, start = np.zeros(_K * _K, np.int64), 0
    while start < len(raw):
        end = start + SLICE_BYTES
        ends = [at for at in (raw.find(b" ", end), raw.find(b"\n", end)) if at >= 0]
        end = min(ends, default=len(raw))
        x = _INDEX[np.frombuffer(b"\n" + raw[start:end] + b"\n", np.uint8)]
        edge = np.flatnonzero(np.diff((x >= 0).astype(np.int8)))
        for i in np.flatnonzero(edge[1::2] - edge[::2] >= LEAST).tolist():
            x[edge[2 * i] + 1 : edge[2 * i + 1] + 1] = -1
        both = (x[:-1] >= 0) & (x[1:] >= 0)
        total += np.bincount(x[:-1][both] * np.int16(_K) + x[1:][both], minlength=_K * _K)
        start = end
    return total


class TextModel:
    """What text looks like to each test, from counts of symbol pairs."""

    def __init__(self, counts: np.ndarray | None = None) -> None:
        counts = np.zeros(_K * _K) if counts is None else np.asarray(counts, float)
        same = _CLASS[:, None] == _CLASS[None, :]
        sizes = np.bincount(_CLASS)
        prior = np.where(same, SAME_CLASS / sizes[_CLASS][None, :], (1 - SAME_CLASS) / (_K - sizes[_CLASS])[:, None])
        counts = counts.reshape(_K, _K)
        follow = (counts + PRIOR_PAIRS * prior) / (counts.sum(1, keepdims=True) + PRIOR_PAIRS)
        self.joint = (counts.sum(1) + 1.0)[:, None] * follow
        self.surprise = np.minimum(-np.log2(follow), MOST_BITS)
        self.of = lru_cache(maxsize=None)(self._of)

    def __getstate__(self) -> dict:
        return {"joint": self.joint, "surprise": self.surprise}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.of = lru_cache(maxsize=None)(self._of)

    def _of(self, name: str) -> tuple[float, float, float, float]:
        """Of text in the symbols of an encoding: growth of chi-squared a symbol, chance that neighbours lie on two sides of the middle,
        and mean and variance of the surprise of a pair."""
        chars = dict(ENCODINGS)[name]
        at = np.array([SYMBOLS.index(c) for c in chars])
        joint = self.joint[np.ix_(at, at)]
        joint = joint / joint.sum()
        share = joint.sum(1)
        high = np.arange(len(chars)) >= len(chars) / 2
        surprise = self.surprise[np.ix_(at, at)]
        mean = float((joint * surprise).sum())
        return max(len(chars) * float((share**2).sum()) - 1, 0.25), float(joint[high[:, None] != high[None, :]].sum()), mean, float((joint * (surprise - mean) ** 2).sum())


PLAIN = TextModel()


def infer(token: str) -> tuple[str, np.ndarray, int]:
    """Encoding, codes in its alphabet, and its size; padding at the end is left out."""
    body = token.rstrip("=").replace("=", "")
    seen = set(body)
    for name, chars, code, size in _SETS:
        if seen <= chars:
            return name, code[np.frombuffer(body.encode(), np.uint8)], size
    raise ValueError(token)


def battery(codes: np.ndarray, size: int) -> tuple[float, int, tuple[float, float, float]]:
    """Chi-squared statistic, changes of side, and the p-values of uniformity, runs and serial correlation for random characters."""
    n = len(codes)
    chi = size * float((np.bincount(codes, minlength=size) ** 2).sum()) / n - n
    high = codes >= size / 2
    ups, turns = int(high.sum()), int((high[1:] != high[:-1]).sum())
    downs = n - ups
    if ups and downs:
        mean = 2 * ups * downs / n + 1
        var = (mean - 1) * (mean - 2) / max(n - 1, 1)
        p_runs = 2 * _normal_tail(abs(turns + 1 - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    x = codes - codes.mean()
    var = float((x * x).sum())
    r = float((x[1:] * x[:-1]).sum()) / var if var else 1.0
    p_serial = 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))
    return chi, turns, (_chi_tail(chi, size - 1), p_runs, p_serial)


def fisher(ps: tuple[float, ...]) -> float:
    return _chi_tail(-2 * sum(math.log(max(p, 1e-300)) for p in ps), 2 * len(ps))


def cauchy(ps: tuple[float, ...]) -> float:
    """Cauchy's combination of p-values that may depend on each other."""
    far = lambda p: 1 / (math.pi * p) if p < 1e-9 else math.tan((0.5 - min(p, 0.99)) * math.pi)
    x = sum(far(max(p, 1e-300)) for p in ps) / len(ps)
    return 1 / (math.pi * x) if x > 1e9 else 0.5 - math.atan(x) / math.pi


def token_p(token: str, model: TextModel) -> tuple[float, float]:
    """Chance that text looks as random to the battery as this token, 1 if it isn't random, and the bits that it can hold."""
    name, codes, size = infer(token)
    n = len(codes)
    if n < LEAST:
        return 1.0, 1.0
    chi, turns, ps = battery(codes, size)
    bits = n * math.log2(size)
    if fisher(ps) < ALPHA_RANDOM:
        return 1.0, bits
    growth, turn, mean, var = model.of(name)
    even = _normal_tail((size - 1 + n * growth - chi) / math.sqrt(2 * DISPERSION * (size - 1 + 2 * n * growth)))
    runs = _normal_tail((turns - 0.5 - (n - 1) * turn) / math.sqrt(max(DISPERSION * (n - 1) * turn * (1 - turn), 1e-9)))
    at = _INDEX[np.frombuffer(token.rstrip("=").replace("=", "").encode(), np.uint8)]
    surprise = float(model.surprise[at[:-1], at[1:]].sum())
    serial = _normal_tail((surprise - (n - 1) * mean) / math.sqrt(max(DISPERSION * (n - 1) * var, 1e-9)))
    return cauchy((even, runs, serial)), bits


def magnitude(p: float, bits: float) -> int:
    """Steps of a decade of a p-value weighted by bits, rounded towards the larger value; above 0 are those that may count."""
    return min(math.floor(-math.log10(max(p, 1e-300) / bits) * STEPS), DECADES * STEPS)


def threshold(counts: dict[int, int], mean_bits: float, share: float = FALSE_DISCOVERIES) -> int:
    """The least magnitude that the step-up rule accepts, given how many candidates there are of each; beyond all where it accepts none."""
    total, above, best = sum(counts.values()), 0, DECADES * STEPS + 1
    for m in sorted(counts, reverse=True):
        above += counts[m]
        if mean_bits * 10 ** (-m / STEPS) * total <= share * above:
            best = m
    return best


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns by start, then kind."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Spans of candidates that no span of ``taken`` (by start) meets; both lists are walked once."""
    i, reach = 0, 0  # ``reach``: the furthest end of the spans that begin before the candidate ends
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            yield a, b


def scan(text: str | None, model: TextModel = PLAIN, least: int | None = None) -> list[tuple[int, int, str, int]]:
    """All spans ``(start, end, kind, magnitude)`` of a text by start, then kind; null counts as empty. Random ones are those of at least
    magnitude ``least``; without it, those that the step-up rule accepts in this text alone."""
    text = text or ""
    base = base_spans(text)
    tested = [(a, b, *token_p(text[a:b], model)) for a, b in candidates(text, base)]
    found = [(a, b, "random", magnitude(p, bits)) for a, b, p, bits in tested]
    if least is None and found:
        counts = {m: sum(x[3] == m for x in found) for m in {x[3] for x in found}}
        least = threshold(counts, sum(x[3] for x in tested) / len(tested))
    return sorted([*((*x, 0) for x in base), *(x for x in found if x[3] >= least)], key=lambda x: (x[0], KINDS.index(x[2])))


def redacted(text: str | None, model: TextModel = PLAIN, least: int | None = None, mark: str = "<secret>") -> str | None:
    """The text with every span replaced by the mark; overlapping spans become one."""
    if text is None:
        return None
    spans = scan(text, model, least)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b = spans[i][:2]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][1])
        out += [text[at:a], mark]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def text_model(docs: DataFrame, text_col: str = "text") -> TextModel:
    """The text model of all documents. Each task sums its own counts, and at most as many sums as there are pairs reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_K * _K, np.int64)
        for batch in batches:
            total += pair_counts(batch.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    counts = np.zeros(_K * _K)
    for r in docs.select(text_col).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] = r["n"]
    return TextModel(counts)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("magnitude", T.IntegerType())]))
_TESTED = T.StructType([T.StructField("spans", _SPANS), T.StructField("bits", T.DoubleType()), T.StructField("n", T.IntegerType())])


def _tested(model):
    @F.pandas_udf(_TESTED)
    def of(text: pd.Series) -> pd.DataFrame:
        rows, names = [], ("start", "end", "kind", "magnitude")
        for t in text:
            base = base_spans(t or "")
            tested = [(a, b, *token_p(t[a:b], model.value)) for a, b in candidates(t or "", base)]
            spans = [(*x, 0) for x in base] + [(a, b, "random", m) for a, b, p, bits in tested if (m := magnitude(p, bits)) > 0]
            spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
            rows.append(([dict(zip(names, x, strict=True)) for x in spans], sum(x[3] for x in tested), len(tested)))
        return pd.DataFrame(rows, columns=["spans", "bits", "n"])

    return of


def corpus_threshold(tested: DataFrame) -> int:
    """The threshold for all candidates, from counts of their magnitudes: a few hundred rows."""
    sums = tested.agg(F.sum("bits"), F.sum("n")).first()
    if not sums[1]:
        return DECADES * STEPS + 1
    found = tested.select(F.explode(F.filter("spans", lambda x: x["kind"] == "random")).alias("x")).groupBy("x.magnitude").count().collect()
    counts = {r["magnitude"]: r["count"] for r in found}
    counts[0] = sums[1] - sum(counts.values())
    return threshold(counts, sums[0] / sums[1])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``, an array of ``(start, end, kind, magnitude)`` in code points, for every row; null text has none.

    Texts are read twice, once for the model of text, and nothing of them is shuffled; spans are written before the threshold is known.
    Repeated rows give repeated results; other columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(text_model(docs, text_col))
    tested = materialise(docs.select(F.col(id_col), _tested(model)(F.col(text_col)).alias("t")).select(id_col, "t.*"), "tested")
    least = corpus_threshold(tested)
    return tested.select(id_col, F.filter("spans", lambda x: (x["kind"] != "random") | (x["magnitude"] >= least)).alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All columns and rows of ``docs``, with secrets replaced in the text and its length set anew. Null text stays null; repeated rows
    stay, and there are no ties."""
    model = docs.sparkSession.sparkContext.broadcast(text_model(docs, text_col))
    least = corpus_threshold(materialise(docs.select(_tested(model)(F.col(text_col)).alias("t")).select("t.*").where("n > 0"), "tested"))

    @F.pandas_udf(T.StringType())
    def redact(text: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, model.value, least) for t in text], dtype=object)

    out = docs.withColumn(text_col, redact(F.col(text_col)))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


@F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in (("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()))]))
def _digest(spans: pd.Series) -> pd.DataFrame:
    rows = []
    for s in spans:
        named = [f"{x['kind']}:{x['start']}:{x['end']}" for x in s]
        kinds = [x["kind"] for x in s]
        base = ",".join(x for x, k in zip(named, kinds, strict=True) if k != "random")
        rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(base.encode()).hexdigest(), ",".join(named)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, digest of the pattern spans, and all spans as text."""
    return found.select("doc_id", _digest("spans").alias("d")).select("doc_id", "d.*")
