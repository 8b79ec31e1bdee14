"""Token counts that follow edits: a segment tree of pre-tokens for each document.

The leaves are blocks of pre-tokens (the byte-level pattern's matches) with their lengths and token counts;
inner nodes hold sums. An edit replaces a range of characters. Matching starts again at the first pre-token
whose match could see the edit (two characters of context before it) and ends where a new border falls on an
old one behind the edit, since the pattern looks at nothing before its start. Only this region is encoded
again; the sums on the paths above it are updated.

Null and empty texts have no tokens; edits on them are insertions. Edits beyond the end are clipped to it.
Repeated rows keep one row each. Null edits are none. Very long texts are counted whole. An empty table gives an
empty result. Columns other than those named are not read. The text of a special token (such as that of the end id)
counts as plain text here, while packing takes it as the token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import PATTERN, WordIds, default_path, word_ids
from .common import Memo, map_text

PRE_TOKEN = regex.compile(PATTERN)
BLOCK = 32


class PreTokenCounter:
    """Tokens in each pre-token, with a memo."""

    def __init__(self, ids: WordIds):
        self.ids = ids
        self.memo = Memo(self._count, 600_000)

    def _count(self, pre: str) -> int:
        ids = self.ids
        return len(ids.quick._encode_single_piece(pre)) if ids.quick is not None else len(ids._ids(pre)) // 4


class TokenTree:
    """A document's text and its tree. ``count`` is the root's sum; ``encoded`` counts characters encoded after edits."""

    def __init__(self, text: str, counter: PreTokenCounter):
        self.counter, self.encoded = counter, 0
        self._build(text)

    def _build(self, text: str) -> None:
        pre = PRE_TOKEN.findall(text)
        self.text = text
        self._plant(list(map(len, pre)), list(map(self.counter.memo.__getitem__, pre)))

    def _plant(self, sizes: list[int], counts: list[int]) -> None:
        """A new tree over the sizes and token counts of all pre-tokens."""
        self.blocks = [(sizes[k : k + BLOCK], counts[k : k + BLOCK]) for k in range(0, len(sizes), BLOCK)] or [([], [])]
        n = 1 << (len(self.blocks) - 1).bit_length()
        self.leaves, self.chars, self.tokens = n, [0] * (2 * n), [0] * (2 * n)
        for b, (size, count) in enumerate(self.blocks):
            self.chars[n + b], self.tokens[n + b] = sum(size), sum(count)
        for v in range(n - 1, 0, -1):
            self.chars[v], self.tokens[v] = self.chars[2 * v] + self.chars[2 * v + 1], self.tokens[2 * v] + self.tokens[2 * v + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    def _find(self, char: int) -> tuple[int, int]:
        """The block that holds a character and the block's first character; past the end, the last block."""
        if char >= self.chars[1]:
            last = len(self.blocks) - 1
            return last, self.chars[1] - self.chars[self.leaves + last]
        v, at = 1, 0
        while v < self.leaves:
            v *= 2
            if char - at >= self.chars[v]:
                at += self.chars[v]
                v += 1
        return v - self.leaves, at

    def _set(self, block: int, size: list[int], count: list[int]) -> None:
        self.blocks[block] = (size, count)
        v = self.leaves + block
        self.chars[v], self.tokens[v] = sum(size), sum(count)
        while v > 1:
            v //= 2
            self.chars[v], self.tokens[v] = self.chars[2 * v] + self.chars[2 * v + 1], self.tokens[2 * v] + self.tokens[2 * v + 1]

    def _borders(self, block: int, at: int) -> Iterator[tuple[int, int, int, int]]:
        """(block, index, first character, size) of the pre-tokens from a block on."""
        while block < len(self.blocks):
            for k, n in enumerate(self.blocks[block][0]):
                yield block, k, at, n
                at += n
            block += 1

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by new."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        if not self.text:
            self.encoded += len(text)
            return self._build(text)
        b0, at0 = self._find(max(0, start - 2))
        b0, at0 = (b0 - 1, at0 - self.chars[self.leaves + b0 - 1]) if b0 and at0 == max(0, start - 2) else (b0, at0)
        first = None
        for block, k, at, n in self._borders(b0, at0):
            if at + n + 2 > start:
                first = (block, k, at)
                break
        if first is None:  # the last pre-token ends more than two characters before: only an insertion at the end
            return self._build(text)
        sizes, counts, pos = [], [], first[2]
        stop: tuple[int, int] | None = None
        walk = self._borders(first[0], at0 if first[0] == b0 else first[2] - sum(self.blocks[first[0]][0][: first[1]]))
        step = next(walk, None)
        while pos < len(text):
            n = len(PRE_TOKEN.match(text, pos).group())
            sizes.append(n)
            counts.append(self.counter.memo[text[pos : pos + n]])
            pos += n
            if pos - shift >= end and pos >= start + len(new):
                while step is not None and step[2] < pos - shift:
                    step = next(walk, None)
                if step is not None and step[2] == pos - shift:
                    stop = (step[0], step[1])
                    break
        self.encoded += sum(sizes)
        fb, fk = first[0], first[1]
        lb, lk = stop if stop else (len(self.blocks) - 1, len(self.blocks[-1][0]))
        tail = (self.blocks[lb][0][lk:], self.blocks[lb][1][lk:])
        head = (self.blocks[fb][0][:fk], self.blocks[fb][1][:fk])
        self.text = text
        for b in range(fb + 1, lb + 1):
            self._set(b, [], [])
        if lb > fb:
            self._set(lb, *tail)
            tail = ([], [])
        self._set(fb, head[0] + sizes + tail[0], head[1] + counts + tail[1])
        if len(self.blocks[fb][0]) > 16 * BLOCK:
            self._plant([n for s, _ in self.blocks for n in s], [n for _, c in self.blocks for n in c])


def count_edited(docs: DataFrame, edits_col: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_edits, n_chars_edited (length after the edits), n_chars_encoded.

    edits_col: an array of (from, to, new) in code points, applied one after the other, each to the text so far.
    """
    path = tokenizer or default_path()
    kind = "array<struct<from:int,to:int,new:string>>"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PreTokenCounter(word_ids(path))
        for b in batches:
            out = []
            for text, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                tree = TokenTree(text or "", counter)
                before, edits = tree.count, [e for e in edits or [] if e is not None]
                for e in edits:
                    tree.edit(e["from"] or 0, e["to"] or 0, e["new"] or "")
                out.append((before, tree.count, len(edits), len(tree.text), tree.encoded))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], pa.int64()) for k in range(5))], names=["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_chars_edited", "n_chars_encoded"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).cast(kind).alias("edits"))
    return map_text(narrow, step, "doc_id long, n_tokens long, n_tokens_edited long, n_edits long, n_chars_edited long, n_chars_encoded long")
