"""Words that go to the tokenizers library as running texts."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from sitelens.llm import wordbpe  # noqa: E402

BPE = P.path("byte_bpe_50k.json")


class Counted:
    """A library that counts the texts it is given."""

    def __init__(self, lib):
        self.lib, self.texts = lib, 0

    def encode(self, text, **more):
        return self.lib.encode(text, **more)

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.lib.encode_batch_fast(texts, **more)


def test_plain_new_words_go_to_the_library_as_running_texts():
    enc = wordbpe.WordEncoder(BPE, False)
    lib, enc.lib = enc.lib, Counted(enc.lib)
    syllables = ["th", "on", "Er", "é", "ß", "ж", "漢", "i"]
    words = ["".join(x) for x in np.random.default_rng(1).choice(syllables, (3000, 5))]
    texts = [" ".join(words[i:i + 50]) for i in range(0, 3000, 50)]
    texts += ["", "  two  spaces don't x² ½\n\n ʰa ́ ĠĠ Ġa aĠ  y​z ", "a <|endoftext|> b", " " + "q" * 3000]
    got = enc.encode(texts)
    assert [x.tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert enc.lib.texts < 200                 # one text a word before: over 2,000


def test_runs_that_do_not_part_at_their_words_are_not_cached():
    enc = wordbpe.WordEncoder(BPE, False)
    enc.spaced[:] = False
    ids = enc.encode(["one two three"])[0]
    assert ids.tolist() == enc.lib.encode("one two three", add_special_tokens=False).ids
