"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier on hashed byte n-grams of a text's letters tells the languages with the bit
from those without, by the log ratio of n-gram shares that were counted over all training texts. A text's margins are compared with every
codeword: the loss of a bit weighs as much as its classifier proved right for that language, and the codeword with the least loss wins, so that
single classifiers may be wrong. A text whose best two codewords are nearly as near is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced

#: Orders of n-grams in bytes, and their hash buckets.
ORDERS, BUCKETS = (2, 3, 4), 1 << 14
#: Up to so many languages get all ways of parting them as bits; more get random codewords of ``BITS_EACH`` bits for each doubling of their number.
EXHAUSTIVE, BITS_EACH = 5, 10
#: Training documents on which classifiers are measured to weigh their bits: those with the least hash of id and text.
MEASURED = 4000
#: Least share of the loss between the best two codewords that isn't ambiguous, and the steepness of scores.
CLEAR, STEEP = 0.15, 6.0
#: Distinct languages that a codebook can hold.
MOST_LANGUAGES = 4096
UNKNOWN = "und"
_BLANK = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULT = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def folded(text: str) -> bytes:
    """The letters of a text in lower case as UTF-8, with blanks for all else of ASCII and around it."""
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(_BLANK) + b" "


def grams(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and buckets of the n-grams of each order; those with two blanks in a row, and those across a zero byte, don't count."""
    raw = np.frombuffer(data, np.uint8)
    value = raw.astype(np.uint32)
    bad = raw == 0
    bad[:-1] |= (raw[:-1] == 32) & (raw[1:] == 32)
    for n in ORDERS:
        if len(raw) < n:
            return
        end = len(raw) - n + 1
        h, out = value[:end].copy(), bad[:end] | (raw[n - 1 :] == 0)
        for k in range(1, n):
            h = h * np.uint32(257) + value[k : k + end]
            if k < n - 1:
                out = out | bad[k : k + end]
        at = np.flatnonzero(~out)
        h = (h[at] + np.uint32(n)) * _MULT
        yield at, (h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)


# --- codewords and the model ---------------------------------------------------------------------------------------


def codebook(languages: int) -> np.ndarray:
    """Codewords of -1 and 1, one row for each language. Few languages get every way of parting them in two once, so that two codewords differ in
    half of the bits or more; many get the best of some random codebooks, by the least distance of two codewords."""
    if languages < 2:
        return np.zeros((languages, 0), np.int8)
    if languages <= EXHAUSTIVE:
        ways = [w for w in product((1, -1), repeat=languages) if w[0] == 1 and -1 in w]
        return np.array(ways, np.int8).T
    bits, best, apart = BITS_EACH * int(np.ceil(np.log2(languages))), None, -1
    for seed in range(20):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (languages, bits))
        code = code[:, np.abs(code.sum(axis=0, dtype=np.int64)) < languages]  # both sides of a bit have languages
        same = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(same, -bits)
        least = (code.shape[1] - same.max()) / 2
        if least > apart:
            best, apart = code, least
    return best


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray
    #: Log ratio of each bucket for each bit, and how far each bit's classifier is trusted for each language.
    weights: np.ndarray
    trust: np.ndarray


def bit_weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """``[bucket, bit]``: log ratio of smoothed shares of a bucket in the languages with a bit and in those without. Each language counts alike,
    however many texts it has."""
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    out = np.zeros((counts.shape[1], code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        out[:, b] = np.log(share[code[:, b] == 1].mean(axis=0)) - np.log(share[code[:, b] == -1].mean(axis=0))
    return out


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """``[text, bit]``: mean weight of each text's n-grams; 0 without any."""
    out, limit = np.zeros((len(texts), weights.shape[1])), max((1 << 21) // max(weights.shape[1], 1), 4096)
    data = [folded(t) for t in texts]
    for a, b in sliced(map(len, data), limit):
        joined = b"\0".join(data[a:b])
        starts = np.cumsum([0, *(len(x) + 1 for x in data[a:b])])
        seen = np.zeros(b - a)
        part = limit if b - a == 1 else len(joined)  # a text larger than a slice goes in parts, which overlap by less than an n-gram
        for begin in range(0, len(joined), part):
            for at, bucket in grams(joined[begin : begin + part + max(ORDERS) - 1]):
                keep = at < part
                at, bucket = at[keep] + begin, bucket[keep]
                if len(at):
                    which = np.searchsorted(starts, at, "right") - 1
                    seen += np.bincount(which, minlength=b - a)
                    first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
                    out[a + which[first]] += np.add.reduceat(weights[bucket], first, axis=0, dtype=np.float64)
        out[a:b] /= np.maximum(seen, 1)[:, None]
    return out


def decoded(margin: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the language with the least weighted loss, a score from 0 to 1, and whether another language comes close."""
    if len(model.languages) == 1:
        return np.zeros(len(margin), np.int64), np.ones(len(margin)), np.zeros(len(margin), bool)
    agree = margin[:, None, :] * model.code[None, :, :]
    loss = (np.logaddexp(0, -STEEP * agree) * model.trust[None, :, :]).sum(axis=2) / np.log(2)
    order = np.argsort(loss, axis=1, kind="stable")
    rows = np.arange(len(margin))
    best, second = loss[rows, order[:, 0]], loss[rows, order[:, 1]]
    like = np.exp(-(loss - best[:, None]) * STEEP)
    return order[:, 0], 1 / like.sum(axis=1), second - best < CLEAR * np.maximum(second, 1e-12)


def trust_of(margin: np.ndarray, whose: np.ndarray, code: np.ndarray) -> np.ndarray:
    """``[language, bit]``: smoothed share of a language's texts for which a bit's classifier is right; of each language, the shares add up to 1."""
    out = np.ones(code.shape)
    for k in range(len(code)):
        own = np.sign(margin[whose == k]) == code[k]
        out[k] = (own.sum(axis=0) + 1) / (len(own) + 2)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-12)


# --- on Spark ------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: CRC-32 of the decimal id (null: of no text) modulo 4 is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, text``: counts of buckets by language, of all texts of a task."""
    seen: dict[str, np.ndarray] = {}

    def counts() -> Iterator[pa.RecordBatch]:
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, text in zip(langs, texts, strict=True):
            if len(seen) > 64 and lang not in seen:
                yield from counts()
                seen = {}
            n = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
            data = folded(text)
            for begin in range(0, len(data), 1 << 20):
                for at, bucket in grams(data[begin : begin + (1 << 20) + max(ORDERS) - 1]):
                    n += np.bincount(bucket[at < 1 << 20], minlength=BUCKETS)
    yield from counts()


def language_counts(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their counts of buckets, over all ``rows`` (``lang, text``). The driver gets one array for each language."""
    sums = rows.mapInArrow(_tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("c")).select("lang", F.col("c.bucket").alias("at"), F.col("c.n").alias("n"))
    found = by_lang.orderBy("lang").limit(MOST_LANGUAGES + 1).toArrow()
    languages = found.column("lang").to_pylist()
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"a codebook holds at most {MOST_LANGUAGES} languages")
    counts = np.zeros((len(languages), BUCKETS))
    for k, (at, n) in enumerate(zip(found.column("at"), found.column("n"), strict=True)):
        counts[k, at.values.to_numpy(zero_copy_only=False)] = n.values.to_numpy(zero_copy_only=False)
    return languages, counts


def train(rows: DataFrame, measured: int = MEASURED) -> Model:
    """A model of ``rows`` (``doc_id, lang, text``), of which those without a language or a letter teach nothing. Counts are over all of them; ``measured`` of them tell how far
    each classifier can be trusted."""

    @F.pandas_udf(T.BooleanType())
    def lettered(texts: pd.Series) -> pd.Series:
        return texts.map(has_letter).astype(bool)

    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages, counts = language_counts(rows.where(lettered("text")).select("lang", "text"))
    code = codebook(len(languages))
    model = Model(languages, code, bit_weights(counts, code), np.ones(code.shape) / max(code.shape[1], 1))
    if len(languages) < 2:
        return model
    mine = {x: i for i, x in enumerate(languages)}
    shared = rows.sparkSession.sparkContext.broadcast(model.weights)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def margin(texts: pd.Series) -> pd.Series:
        return pd.Series(list(margins(texts.tolist(), shared.value)))

    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    last = hashed.select("h", "lang").distinct().orderBy("h", "lang").limit(measured).agg(F.max("h")).first()[0]
    few = hashed.where(F.col("h") <= F.lit(last)).groupBy("h", "lang").agg(F.first("text").alias("text"))
    sample = few.orderBy("h", "lang").limit(measured).select("lang", margin("text").alias("m")).collect()
    whose = np.array([mine.get(r["lang"], -1) for r in sample])
    return model._replace(trust=trust_of(np.array([r["m"] for r in sample]), whose, code))


_SAID = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def predicted(text: Column, model: Model, spark) -> Column:
    """``lang_pred, score, ambiguous`` of a text. Without a text, a letter or any learned language: ``und``, 0 and false."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(_SAID)
    def of(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "ambiguous": False})
        known = np.flatnonzero([has_letter(t) for t in texts])
        if len(known) and m.languages:
            which, score, close = decoded(margins([texts.iat[i] for i in known], m.weights), m)
            out.loc[known, "lang_pred"] = [m.languages[k] for k in which]
            out.loc[known, "score"] = score.round(9)
            out.loc[known, "ambiguous"] = close
        return out

    return of(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", measured: int = MEASURED) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every row. Learned from the rows that aren't held out and have a language; a prediction
    sees nothing but its text, so equal texts have equal ones.

    A null text, or one without a letter, is ``und``; with one language learned, every other text is of that. A language is a string like any other: an empty one
    counts as a language. Repeated rows count each time; other columns are ignored; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    model = train(rows.where(~F.col("held_out")).select("doc_id", "lang", "text"), measured)
    return rows.select("doc_id", "held_out", predicted(F.col("text"), model, docs.sparkSession).alias("said")).select("doc_id", "held_out", "said.*")
