"""Ids of texts with mixed white space, and of long ones, against the libraries they must equal."""

import random

import numpy as np
import public_tokenizers as P
import pytest

from sievework.llm import bytebpe, common, piece_codec

GAPS = [" ", " ", " ", "\n", "\t", " ", "\r\n", " ", "\x1c", "\x85", "  ", "\n\n", "　", " ", "\x0b", "\t\t", " \n"]
WORDS = ["a", "the", "2", "é", "x.", "12", "'s", "don't", "日本", "▁", "...", "Tion", "_", "\U0001f600"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def same(text, libraries):
    tok, sp = libraries
    ids = sp.encode(text)
    assert bytebpe.word_ids(bytebpe.default_path()).encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text[:80])
    assert piece_codec.codec().both(text) == (len(ids), ",".join(map(str, ids)), sp.decode(ids)), repr(text[:80])


def test_mixed_white_space(libraries):
    r = random.Random(7)
    for _ in range(50_000):
        same("".join(r.choice(WORDS if r.random() < 0.6 else GAPS) for _ in range(r.randrange(1, 14))), libraries)


def test_long_texts(libraries):
    for text in ("the and  of\tx\n\n" * 150_000, "the cat sat on " * 150_000, "abab" * 250_000):
        same(text, libraries)


def test_plain_spacing_by_definition():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("ab \n\t ") for _ in range(r.randrange(8)))
        gaps = [k for k, c in enumerate(t) if c.isspace()]
        want = bool(t) and all(t[k] in " \n" and 0 < k < len(t) - 1 and not t[k - 1].isspace() and not t[k + 1].isspace() for k in gaps)
        assert common.plain_spacing(t) == want, repr(t)
