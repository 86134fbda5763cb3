"""Token ids of the public byte-level BPE vocabulary, by a word cache before the merge routine."""

from __future__ import annotations

import array
import base64
import re
from functools import lru_cache

#: Words whose ids a worker remembers; beyond it the cache starts anew, so memory stays bounded.
CACHED_WORDS = 300_000
#: Characters for which Python's classes agree with the Unicode ones of the vocabulary's own pattern.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7eÀ-ɏ‐-‧]")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Words(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = array.array("I", self.encode(word.encode())).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return enc, _Words(enc._core_bpe.encode_single_piece).__getitem__


def token_bytes(text: str | None, path: str) -> bytes:
    """Ids of the whole text as little-endian unsigned 32-bit numbers; null counts as empty. The string of the vocabulary's special token is
    ordinary text, as its notes set the tokenizer (``encode_special_tokens``), so that no text can end a document."""
    if not text:
        return b""
    enc, word = _encoder(path)
    if _OTHER.search(text):
        return array.array("I", enc.encode_ordinary(text)).tobytes()
    return b"".join(map(word, _WORDS.findall(text)))
