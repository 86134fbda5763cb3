"""Quality classifier from weak labels.

Overlapping labellers vote good, bad or abstain on every document; expectation-maximisation over the counts of vote
patterns (at most ``3 ** len(LABELLERS)`` of them) estimates from their agreement alone each labeller's accuracy in every class
(good, three kinds of junk, abuse), and so a posterior for every pattern. The posteriors of a bounded sample then train a hashed linear scorer, which judges
all documents. Eight labellers are heuristics on statistics of the text. Nothing but words tells abuse, so three labellers are hashed
linear models of whole words and of their first four and five letters, fitted to a bounded sample of labelled documents; this is all
that labels are used for. What the driver holds is bounded by ``SAMPLE`` times ``MOST_FEATURES`` and by the patterns.
"""

from __future__ import annotations

import re
import string
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table

#: Documents of the labelled sample, and of the sample that trains the scorer: the least by a hash of id and text.
SAMPLE = 8000
#: Hashed features of each view (words, first four letters, first five, style and votes), and how many of them a model may use.
HASH_SIZE, MOST_FEATURES = 1 << 18, 400
WORDS, FOUR, FIVE, STYLE = range(4)
BAD_ABOVE = 0.5
#: Words among which distinct ones are counted.
RUN = 500
HEURISTICS = ("symbols", "capitals", "stutter", "variety", "function_words", "sentences", "shouting", "marked_words")
LABELLERS = (*HEURISTICS, "abuse_words", "abuse_four", "abuse_five")
GOOD, BAD, ABSTAIN = 1, 2, 0
#: Name of the column that judged documents get.
JUDGEMENT = "_judgement"
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was with aber als auf das dem den der des die ein eine er es für"
    " ich im ist mit nicht sich sie und von zu au aux dans de des du elle en est et il la le les on par pas pour que qui se sur un une"
    " al como con del el en es la las lo los más no para por que se su un una y".split()
)
_SYMBOLS = "".join(c for c in string.punctuation if c not in ".,;:?'\"-()!").encode()
_MARKED = bytes.maketrans(_SYMBOLS, b"|" * len(_SYMBOLS))
_UPPER, _LETTERS = string.ascii_uppercase.encode(), string.ascii_letters.encode()
_STRIP = string.punctuation + "¡¿«»“”’"
#: A word with a symbol, from its first symbol on, where symbols are marked.
_MARKED_WORD = re.compile(rb"\|\S*")


def described(text: str | None) -> tuple[tuple[float, ...], set[str]]:
    """Statistics of a text (null counts as empty), and its distinct words in lower case.

    The statistics are shares of symbols, capitals, immediate repeats, distinct words (within each ``RUN`` words, so that length doesn't matter), function words, full stops, double marks and words with
    symbols; word count."""
    text = text or ""
    data, words = text.encode("utf-8", "surrogatepass"), text.split()
    n, size = len(words), max(len(data), 1)
    if not n:
        return (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0), set()
    less = lambda chars: len(data) - len(data.translate(None, chars))
    lowered = text.lower().split()
    marked = data.translate(_MARKED)
    symbols = marked.count(b"|")
    stats = (
        symbols / size, less(_UPPER) / max(less(_LETTERS), 1), sum(map(eq, words, words[1:])) / n, sum(len(set(words[i : i + RUN])) for i in range(0, n, RUN)) / n,
        sum(map(FUNCTION_WORDS.__contains__, lowered)) / n, data.count(b".") / n, data.count(b"!!") / n, len(_MARKED_WORD.findall(marked)) / n if symbols else 0.0, n,
    )
    return stats, set(lowered)


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def heuristic_votes(s: tuple[float, ...]) -> list[int]:
    symbols, capitals, stutter, variety, function, stops, marks, marked, n = s
    return [
        _vote(symbols > 0.04, symbols < 0.015),
        _vote(capitals > 0.5 and n > 3, capitals < 0.2),
        _vote(stutter > 0.3 and n > 3, stutter < 0.05 and n > 20),
        _vote(n >= 60 and variety < 0.2, n >= 20 and variety > 0.35),
        _vote(n >= 40 and function < 0.03, function > 0.08),
        _vote(n >= 60 and stops < 0.004, n >= 8 and 0.02 < stops < 0.5),
        _vote(marks > 0.2 and n > 3, marks < 0.02),
        _vote(marked > 0.2 and n > 3, marked < 0.08),
    ]


def _hashed(key: str, view: int) -> int:
    return crc32(key.encode("utf-8", "surrogatepass")) % HASH_SIZE + view * HASH_SIZE


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word, and of its first four and five letters."""
    bare = word.strip(_STRIP)
    return (_hashed(bare, WORDS), _hashed(bare[:4], FOUR), _hashed(bare[:5], FIVE)) if len(bare) > 1 else ()


def style_features(s: tuple[float, ...], votes: list[int]) -> list[int]:
    """Hashes of the statistics in steps, and of votes."""
    steps = [f"{i}:{int(x * 20) if i < 8 else len(str(int(x)))}" for i, x in enumerate(s)]
    return [_hashed(k, STYLE) for k in [*steps, *(f"{n}={v}" for n, v in zip(LABELLERS, votes, strict=False))]]


def features(text: str | None, votes: list[int] | None = None) -> np.ndarray:
    """All distinct hashed features of a text and of its votes (those of the heuristics, where none are given)."""
    s, words = described(text)
    out = set(style_features(s, heuristic_votes(s) if votes is None else votes)).union(*map(word_features, words))
    return np.fromiter(out, np.int32, len(out))


#: Words, and beginnings of words, that a worker remembers; beyond it the cache starts anew, so memory stays bounded.
CACHED_WORDS = 200_000


class _Kept(dict):
    """What a function gives for each key; emptied when it has grown large."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, key: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        got = self[key] = self.of(key)
        return got


def used_features(used: frozenset[int]) -> _Kept:
    """For each word, those of its features that some model uses; mostly none. Words are many, most of them seen once, so a new one costs little
    beside its CRC-32; their beginnings are few."""
    four, five = (_Kept(lambda key, view=view: (f,) if (f := _hashed(key, view)) in used else ()) for view in (FOUR, FIVE))

    def of(word: str) -> tuple[int, ...]:
        bare = word.strip(_STRIP)
        if len(bare) < 2:
            return ()
        begin = four[bare[:4]] + five[bare[:5]]
        whole = crc32(bare.encode("utf-8", "surrogatepass")) % HASH_SIZE + WORDS * HASH_SIZE
        return (whole, *begin) if whole in used else begin

    return _Kept(of)


class Linear:
    """A logistic model on a few of the hashed features; without any, it gives its base rate."""

    def __init__(self, at: list[int], weight: np.ndarray, bias: float) -> None:
        self.bias, self.weights = bias, dict(zip(at, map(float, weight), strict=True))

    def __call__(self, found: set[int]) -> float:
        x = self.bias + sum(self.weights[f] for f in found if f in self.weights)
        return float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))


class Judge:
    """Votes of all labellers, and the chance of *bad* by the scorer if there is one. The words of a text are looked up once for all models."""

    def __init__(self, abuse: list[Linear], scorer: Linear | None = None) -> None:
        self.abuse, self.scorer = abuse, scorer
        self.used: _Kept | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"used": None}

    def __call__(self, text: str | None) -> tuple[list[int], float | None]:
        if self.used is None:
            self.used = used_features(frozenset().union(*(m.weights for m in [*self.abuse, *filter(None, [self.scorer])])))
        s, words = described(text)
        found = set().union(*filter(None, map(self.used.__getitem__, words)))
        votes = heuristic_votes(s) + [BAD if model(found) > 0.5 else GOOD for model in self.abuse]
        return votes, self.scorer(found.union(style_features(s, votes))) if self.scorer else None


def logistic(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a ridge-penalised logistic fit to soft targets; the last column of ``x`` is one."""
    base = target.mean()
    w = np.zeros(x.shape[1])
    w[-1] = np.log(base / (1 - base))
    ridge = np.full(x.shape[1], 0.5)
    ridge[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = np.diag(ridge)
        for i in range(0, len(x), 1000):
            part = x[i : i + 1000].astype(np.float64)
            hess += (part * (p[i : i + 1000] * (1 - p[i : i + 1000]) + 1e-6)[:, None]).T @ part
        step = np.linalg.solve(hess, x.T @ (target - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(rows: DataFrame, views: tuple[int, ...], least_support: int = 6, least_z: float = 4.0) -> Linear:
    """A model of ``target`` on the features of some views whose share differs most surely between the classes. ``rows``: ``features`` and
    ``target`` of a bounded sample. Supports are summed by Spark; the driver gets the few features chosen, and which of them each row has."""
    total, base = rows.agg(F.count(F.lit(1)), F.avg("target")).first()
    if not total or base * total < 1 or base * total > total - 1:
        return Linear([], np.zeros(0), 9.0 if total and base >= 0.5 else -9.0)
    one = rows.select(F.explode("features").alias("f"), "target").where(F.floor(F.col("f") / HASH_SIZE).isin(*views))
    sums = one.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("ones")).where(F.col("n") >= least_support)
    sure = F.round(F.abs((F.col("ones") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))), 9)
    at = [r["f"] for r in sums.withColumn("z", sure).where(F.col("z") >= least_z).orderBy(F.desc("z"), "f").limit(MOST_FEATURES).collect()]
    place = {f: i for i, f in enumerate(at)}

    @F.pandas_udf(T.ArrayType(T.ShortType()))
    def chosen(found: pd.Series) -> pd.Series:
        return pd.Series([sorted(place[f] for f in row.tolist() if f in place) for row in found])

    held = rows.select(chosen("features").alias("at"), "target").collect()
    x = np.zeros((len(held), len(at) + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(held):
        x[i, r["at"]] = 1
    w = logistic(x, np.array([r["target"] for r in held]))
    return Linear(at, w[:-1], float(w[-1]))


def code(votes: list[int]) -> int:
    out = 0
    for v in votes:
        out = out * 3 + v
    return out


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return out[::-1]


#: What is believed before any vote is counted: the labellers that tend to vote bad in each class (the others, mostly good), how much the
#: classes weigh, and how much the belief weighs beside all documents.
CLASSES = {"good": (), "marks": ("symbols", "marked_words"), "shouting": ("capitals", "shouting"), "repeats": ("stutter", "variety"), "abuse": LABELLERS[-3:]}
CLASS_BELIEF, BELIEF_WEIGHT, TENDS, OTHERWISE = (0.8, 0.04, 0.04, 0.04, 0.08), 0.02, 0.1, 0.95


def estimate(counts: dict[int, float], rounds: int = 500) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """Posterior of *bad* for each pattern, vote shares ``[class, labeller, vote]`` among votes cast, and class shares, from the counts of
    patterns alone: expectation-maximisation with a weak prior, which also says which class is which.

    Classes are those of ``CLASSES``, and bad is any but the first. An abstention says nothing about the class. Counts are shares
    of all documents before anything else, so that the result is the same at every size."""
    belief = np.array([[[0, g, 1 - g] for x in LABELLERS for g in [TENDS if x in bad else OTHERWISE]] for bad in CLASSES.values()])
    share, prior = belief.copy(), np.array(CLASS_BELIEF)
    keys = sorted(counts)
    if not keys:
        return {}, share, prior
    votes = np.array([votes_of(k) for k in keys])
    n = np.array([counts[k] for k in keys], float)
    n /= max(n.sum(), 1e-9)
    cast = np.eye(3)[votes]  # pattern, labeller, vote
    cast[:, :, ABSTAIN] = 0
    post = np.zeros((len(prior), len(keys)))
    for _ in range(rounds):
        like = np.einsum("plv,clv->cp", cast, np.log(share + 1e-9)) + np.log(prior)[:, None]
        new = np.exp(like - like.max(axis=0))
        new /= new.sum(axis=0)
        share = np.einsum("cp,plv->clv", n * new, cast) + BELIEF_WEIGHT * belief
        share /= share.sum(axis=2, keepdims=True)
        prior = (n * new).sum(axis=1) + BELIEF_WEIGHT * np.array(CLASS_BELIEF)
        prior /= prior.sum()
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return dict(zip(keys, (1 - new[0]).tolist(), strict=True)), share, prior


def _sampled(base: DataFrame, keys: DataFrame, abuse: list[Linear] | None = None) -> DataFrame:
    """``features`` and the other columns of ``keys`` (``doc_id``, ``print``, ``target``), one row each; written, as it is read several times."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def of(text: pd.Series) -> pd.Series:
        judge = Judge(abuse) if abuse else None
        return pd.Series([features(t, judge(t)[0] if judge else None) for t in text])

    met = base.join(F.broadcast(keys), ["doc_id", "print"]).select("doc_id", "print", "target", of("text").alias("features"))
    return materialise(met.dropDuplicates(["doc_id", "print"]), "sample")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
    """The abuse labellers, the scorer, and ``(posteriors, vote shares, class shares)`` of the estimation.

    Labelled rows without an id or toxic value are left out; without any labelled row the abuse labellers never vote bad. Rows of one id
    and one text count once in samples."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("print", F.xxhash64("text"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic") == 1).cast("double").alias("target"))
    order = [F.xxhash64("doc_id", "print"), "doc_id", "print"]
    chosen = base.select("doc_id", "print").join(known, "doc_id").distinct().orderBy(*order).limit(sample)
    marked = _sampled(base, materialise(chosen, "chosen"))
    abuse = [fit(marked, (view,)) for view in (WORDS, FOUR, FIVE)]

    shared = docs.sparkSession.sparkContext.broadcast(Judge(abuse))

    @F.pandas_udf(T.IntegerType())
    def pattern(text: pd.Series) -> pd.Series:
        judge = shared.value  # with the words that it remembers from batch to batch
        return pd.Series([code(judge(t)[0]) for t in text], dtype="int32")

    voted = materialise(base.select("doc_id", "print", pattern("text").alias("pattern")), "votes")
    counts = {r["pattern"]: float(r["count"]) for r in voted.groupBy("pattern").count().collect()}
    posterior, share, prior = estimate(counts)
    said = docs.sparkSession.createDataFrame(list(posterior.items()), "pattern int, target double")
    picked = voted.where("doc_id is not null").distinct().orderBy(*[F.xxhash64("doc_id", "print", F.lit(1)), "doc_id", "print"]).limit(sample)
    scorer = fit(_sampled(base, materialise(picked.join(F.broadcast(said), "pattern").drop("pattern"), "picked"), abuse), (WORDS, FOUR, FIVE, STYLE))
    return abuse, scorer, (posterior, share, prior)


_JUDGED = T.StructType([T.StructField("votes", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())])


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """All columns and rows of ``docs`` with a struct ``JUDGEMENT``: the labellers' votes, the estimated posterior of *bad*
    from them, and the scorer's chance of *bad*. Null or empty text: all labellers abstain but on what an empty text shows."""
    abuse, scorer, (posterior, _, prior) = train(docs, labels, id_col, text_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast((Judge(abuse, scorer), posterior, 1 - float(prior[0])))

    @F.pandas_udf(_JUDGED)
    def of(text: pd.Series) -> pd.DataFrame:
        judge, known, rate = shared.value
        rows = []
        for t in text:
            votes, score = judge(t)
            rows.append(("".join("?+-"[v] for v in votes), known.get(code(votes), rate), score))
        return pd.DataFrame(rows, columns=["votes", "posterior", "score"])

    return docs.withColumn(JUDGEMENT, of(F.col(text_col)))


def rejected() -> Column:
    """Whether a judged document goes: the scorer finds it bad."""
    return F.col(JUDGEMENT)["score"] > BAD_ABOVE


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, votes, posterior and score of *bad*, and whether the document is kept, for every row."""
    out = judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    return out.select("doc_id", f"{JUDGEMENT}.*", (~rejected()).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their own columns."""
    return judged(docs, labels, id_col, text_col).where(~rejected()).select(*docs.columns)


def labels_of(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")
