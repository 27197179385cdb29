"""Byte-level BPE through the tokenizers library, with a bounded cache of words.

The byte-level pre-tokenizer cuts a text into words and BPE never joins across
them, so a word's ids depend on the word alone.  Texts are cut by the same
pattern; words not met before go to the library, others come from the cache.
Texts of Latin characters only are cut by the same pattern written for the faster
``re`` module, with its classes spelled out.  A text that holds a special token's string goes to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

#: Fixed value: the cutting pattern of the byte-level pre-tokenizer.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
LATIN = 0x250                              # characters below: ASCII to Latin Extended-B


def _latin(kind: str) -> str:
    """The Latin characters of a Unicode category, as ranges of an ``re`` class."""
    chars = [chr(c) for c in range(LATIN) if unicodedata.category(chr(c)).startswith(kind)]
    return "".join(map(re.escape, chars))


_L, _N, _S = _latin("L"), _latin("N"), "\\t-\\r \x85\xa0"
LATIN_PATTERN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
NOT_LATIN = re.compile(f"[^\\x00-{chr(LATIN - 1)}]")
CACHE_WORDS = 400_000
CACHED_WORD_CHARS = 64
BATCH_WORDS = 10_000                       # new words handed to the library at once
RUN_WORDS = 500                            # plain words (a space and letters) in one running text
_ENCODERS: dict = {}


def words_of(text: str) -> list[str]:
    """The words of a text, in order; together they are the text."""
    return (PATTERN if NOT_LATIN.search(text) else LATIN_PATTERN).findall(text)


class WordEncoder:
    def __init__(self, path: str, plain_specials: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task has one core; its process was forked
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else [
            t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        tokens = self.lib.get_vocab()
        self.spaced = np.zeros(max(tokens.values()) + 1, bool)       # tokens that begin with a space
        self.spaced[[i for t, i in tokens.items() if t.startswith("Ġ")]] = True

    def _ids(self, text: str) -> bytes:
        ids = self.lib.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _add_words(self, new: list[str]) -> None:
        """Cache the ids of new words, each a text for the library."""
        for i in range(0, len(new), BATCH_WORDS):              # without offsets, which only whole texts would need
            some = new[i:i + BATCH_WORDS]
            for w, e in zip(some, self.lib.encode_batch_fast(some, add_special_tokens=False)):
                self.cache[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def _add_runs(self, plain: list[str]) -> None:
        """Cache the ids of new words that hold one space, at their start: many words make one text for the library.

        As many tokens that begin with a space as words: then every word begins with such a
        token, and the ids part there.  Words of a run that parts otherwise are not cached.
        """
        for i in range(0, len(plain), BATCH_WORDS):
            runs = [plain[j:j + RUN_WORDS] for j in range(i, min(i + BATCH_WORDS, len(plain)), RUN_WORDS)]
            for ws, e in zip(runs, self.lib.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                at = (4 * np.flatnonzero(self.spaced[ids])).tolist()
                if len(at) == len(ws):
                    flat = ids.tobytes()
                    self.cache.update(zip(ws, [flat[a:b] for a, b in zip(at, [*at[1:], len(flat)])]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian uint32 arrays."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cut = [None if any(s in t for s in self.specials) else words_of(t) for t in texts]
        new = list({w for ws in cut if ws for w in ws} - self.cache.keys())
        plain = [w for w in new if w[0] == " " and w[1:].isalpha()]
        self._add_runs(plain)
        self._add_words([w for w in new if w not in self.cache])
        get = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(get, ws)) if ws is not None else self._ids(t), "<u4")
               for t, ws in zip(texts, cut)]
        for w in new:
            if len(w) > CACHED_WORD_CHARS:     # kept for this call only
                del self.cache[w]
        return out


def word_encoder(path: str, plain_specials: bool = False) -> WordEncoder:
    """One encoder per Python worker and file."""
    key = (path, plain_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, plain_specials)
    return _ENCODERS[key]


def text_groups(texts: list[str], most_chars: int = 2_000_000):
    """Consecutive slices of bounded total length (a longer single text stands alone)."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most_chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
