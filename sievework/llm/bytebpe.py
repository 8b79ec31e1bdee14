"""Byte-level BPE ids with a memo of words: each distinct word of a worker is encoded once.

The vocabulary is the tokenizers library's JSON file. Where its merges are in the order of its ids (checked
on loading), single words go through tiktoken, which has less cost a call; all else goes through tokenizers.
"""

from __future__ import annotations

import json
import os
import sys
from array import array

import numpy as np

from .common import Memo, kept_here, plain_spacing

_OPEN: dict[str, "WordIds"] = kept_here(__name__)
#: Fixed value: the pre-token pattern of byte-level BPE without a prefix space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordIds:
    """``encode(text)``: the ids as little-endian unsigned 32-bit bytes, equal to encoding the whole text.

    A single blank or line feed between two non-blank characters is a border of pre-tokens of this
    tokenizer's pattern, so words between such borders are encoded apart. Texts with any other white
    space, or with the text of a special token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.wordwise = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
        self.quick = self._quick(spec["model"]) if self.wordwise else None
        self.newline = self._ids("\n")
        self.ends = {c: self._ids(c) for c in ".,;:!?"}
        self.inner = Memo(lambda w: self._word(" " + w), 800_000)
        self.first = Memo(self._word, 100_000)

    def _quick(self, model: dict):
        import tiktoken

        letters, vocab = byte_letters(), model["vocab"]
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in made or made != sorted(made) or sys.byteorder != "little" or array("I").itemsize != 4:
            return None
        special = set(self.special)
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if self.quick is None:
            return self._ids(word)
        if word.lstrip(" ").isalpha():
            return array("I", self.quick._encode_single_piece(word)).tobytes()
        if word[-1:] in self.ends and word[-2:-1].isalpha():
            return (self.inner[word[1:-1]] if word[0] == " " else self.first[word[:-1]]) + self.ends[word[-1]]
        return array("I", self.quick.encode_ordinary(word)).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.wordwise or not plain_spacing(text) or any(s in text for s in self.special):
            return self._ids(text)
        inner, first, out = self.inner.__getitem__, self.first, []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first[words[0]] + b"".join(map(inner, words[1:])))
        return self.newline.join(out)


def word_ids(path: str) -> WordIds:
    """One per worker and path."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
