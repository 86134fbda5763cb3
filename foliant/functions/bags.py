"""Bags of words: how often each word stands in a text, and which of many bags share most of their words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np

from .text import HIDDEN, SPLIT_NUMBER, SPLIT_WORD

_HIDDEN, _SPLIT, _WORD = re.compile(f"[{HIDDEN}]"), re.compile(SPLIT_WORD), re.compile(r"\w+")
_SPLIT_NUMBER, _LINE_END = re.compile(SPLIT_NUMBER.removeprefix("(?U)")), re.compile(r"[ \t]*\r?\n[ \t]*")
#: White space as Unicode has it, without the separators that Python adds; and whatever normalisation changes.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS, _CHANGED = re.compile(f"[{_SPACE}]+"), re.compile(f"[{_SPACE.replace(' ', '')}{HIDDEN}]|  ")
#: Rows that a step makes of postings or of words at one time.
AT_ONCE = 1 << 21


def words(text: str) -> list[str]:
    """The words of ``normalized_key``; what it does to blanks and numbers leaves words as they are."""
    if _HIDDEN.search(text):
        text = _HIDDEN.sub("", text)
    if "\n" in text and "-" in text:
        text = _SPLIT.sub("", text)
    return _WORD.findall(text.casefold())


def key(text: str) -> str:
    """``normalized_key``."""
    if _CHANGED.search(text):
        text = _HIDDEN.sub("", text)
        if "\n" in text:
            text = _LINE_END.sub(" ", _SPLIT_NUMBER.sub("-", _SPLIT.sub("", text)))
        text = _BLANKS.sub(" ", text)
    return text.strip(" ").casefold()


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def parts(counts: np.ndarray, at_once: int | None = None) -> Iterator[slice]:
    """Runs of rows that make up to ``at_once`` together (``AT_ONCE``), or a single one."""
    sums, start = np.cumsum(counts), 0
    while start < len(counts):
        end = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + (at_once or AT_ONCE), "right")))
        yield slice(start, end)
        start = end


def _before(group: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For rows that are sorted by group: the sum of ``k`` in the rows of the same group before."""
    sums = np.cumsum(k) - k
    first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    return sums - np.maximum.accumulate(np.where(first, sums, 0)) if len(group) else sums


class Bags:
    """Bags that others are compared with."""

    def __init__(self, given: list[tuple[list[str], list[int]]]):
        self.words: dict[str, int] = {}
        ids = [[self.words.setdefault(w, len(self.words)) for w in ws] for ws, _ in given]
        self.size = np.array([len(x) for x in ids], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.word = np.array([i for x in ids for i in x], np.int64)
        self.k = np.array([k for _, ks in given for k in ks], np.int64)
        self.bag = np.repeat(np.arange(len(given)), self.size)
        self.n = np.bincount(self.bag, self.k, len(given)).astype(np.int64)
        self.order = np.argsort(self.word, kind="stable")
        self.posts = np.bincount(self.word, minlength=len(self.words))
        self.first_post = np.cumsum(self.posts) - self.posts

    def _met(self, n: np.ndarray, other: np.ndarray, word: np.ndarray, posts: np.ndarray, first: np.ndarray, bags: np.ndarray, smaller: bool) -> np.ndarray:
        """Pairs, as numbers, of ``other`` and a bag under its word; ``smaller``: of bags that are no larger than the other, else of larger ones."""
        found = [np.zeros(0, np.int64)]
        for s in parts(posts[word]):
            count = posts[word[s]]
            a, b = np.repeat(other[s], count), bags[ranges(first[word[s]], count)]
            fit = self.n[b] <= n[a] if smaller else self.n[b] > n[a]
            found.append(np.unique(a[fit] * len(self.n) + b[fit]))
        return np.unique(np.concatenate(found))

    def sharing(self, others: list[dict[str, int]], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of those among ``others`` and of own bags of which the smaller has a share of ``least`` of its words in the larger, and that share.

        A bag of n words that shares so many has one of any n (1 - least) + 1 of them in common with the larger one. Each bag takes those that
        fewest bags of the other side hold, here and now; what meets under them is counted in full."""
        some = [(i, self.words.keys() & bag.keys()) for i, bag in enumerate(others)]
        other = np.repeat(np.arange(len(others)), [len(ws) for _, ws in some]).astype(np.int64)
        word = np.array([self.words[w] for _, ws in some for w in ws], np.int64)
        k = np.array([others[i][w] for i, ws in some for w in ws], np.int64)
        n = np.array([sum(bag.values()) for bag in others], np.int64)
        by_word = np.lexsort((word, other))
        other, word, k = other[by_word], word[by_word], k[by_word]
        may_miss = lambda n: np.floor(np.round(n * (1 - least), 6))
        # own bags that are no larger: their words that are rarest among the others
        seen = np.bincount(word, minlength=len(self.words))
        rare = np.lexsort((seen[self.word], self.bag))
        rare = rare[_before(self.bag[rare], self.k[rare]) <= may_miss(self.n[self.bag[rare]])]
        rare = rare[np.argsort(self.word[rare], kind="stable")]
        posts = np.bincount(self.word[rare], minlength=len(self.words))
        pairs = [self._met(n, other, word, posts, np.cumsum(posts) - posts, self.bag[rare], True)]
        # own bags that are larger: the other's words that are rarest here, first of all those that no bag here holds
        by_rarity = np.lexsort((self.posts[word], other))
        a, w = other[by_rarity], word[by_rarity]
        unknown = n - np.bincount(other, k, len(others)).astype(np.int64)
        small = (unknown[a] + _before(a, k[by_rarity]) <= may_miss(n[a])) & (n[a] < self.n.max(initial=0))
        pairs.append(self._met(n, a[small], w[small], self.posts, self.first_post, self.bag[self.order], False))
        a, b = np.divmod(np.concatenate(pairs), max(1, len(self.n)))
        common, key = np.zeros(len(a), np.int64), other * len(self.words) + word
        for s in parts(self.size[b]):
            row = ranges(self.start[b[s]], self.size[b[s]])
            pair = np.repeat(np.arange(s.stop - s.start), self.size[b[s]])
            wanted = a[s][pair] * len(self.words) + self.word[row]
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            both = np.where(key[at] == wanted, np.minimum(k[at], self.k[row]), 0)
            common[s] = np.bincount(pair, both, s.stop - s.start)
        share = common / np.minimum(n[a], self.n[b])
        return a[share >= least], b[share >= least], share[share >= least]


def bag(text: str | None, given: list[str] | None, counts: list[int] | None) -> dict[str, int]:
    """The bag of a text, or the one that is given."""
    return Counter(words(text or "")) if given is None else dict(zip(given, counts, strict=True))
