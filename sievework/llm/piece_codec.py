"""Exact encoding and decoding of a merge-type (BPE) piece model with byte fallback.

Encoding by backtracking: an Aho-Corasick automaton over the vocabulary gives the matches at each position;
the longest is taken if it is compatible with the token before it, which is checked by merging the two again;
else a shorter one is tried, else the position is marked failed in a bit field and the token before is taken
back. Where every two adjacent tokens are compatible, the tokens are those that merging finds.

A text is cut only where no piece of the vocabulary spans the cut, so its parts encode apart; parts are kept
in a bounded memo. Null and empty texts have no ids and decode to the empty text. Characters outside the
vocabulary become byte pieces. Very long texts are encoded whole, in time that grows with their length. Repeated
rows keep one row each, an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, kept_here, map_text, plain_spacing

SPACE = "▁"
_OPEN: dict[str, "PieceCodec"] = kept_here(__name__)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        kind = pb.ModelProto.SentencePiece
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != pb.TrainerSpec.BPE or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback, no normalisation and a dummy prefix is needed")
        self.pieces = [p.piece for p in model.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL}
        self.unknown = {i: " ⁇ " for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN}
        self.ids, self.score = {}, {}
        for i, p in enumerate(model.pieces):
            if p.type == kind.NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
        self.spans = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.line_apart = not any("\n" in p or SPACE in p[1:].lstrip(SPACE) for p in self.ids)
        self.pair_ok = Memo(lambda pair: self.merge(pair[0] + pair[1]) == list(pair), 400_000)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if self.merge(p) == [p]:  # others are never what merging ends with
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.part = Memo(self._part, 300_000)
        self.inner = Memo(lambda w: self._render(SPACE + w), 500_000)
        self.outer = Memo(self._render, 100_000)

    def merge(self, text: str) -> list[str]:
        """Merging from single characters: always the best-scored pair, the leftmost on a tie."""
        t, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(t) - 1):
                s = score.get(t[i] + t[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return t
            t[at : at + 2] = [t[at] + t[at + 1]]

    def _tokens(self, part: str) -> list[str]:
        """Tokens of a part, by backtracking. Each prefix has one valid encoding, so a failed position never gets better."""
        n = len(part)
        at: list[list[str]] = [[] for _ in range(n + 1)]
        for end, p in self.automaton.iter(part):
            at[end - len(p) + 1].append(p)  # by rising length
        failed, pos, stack, ok = bytearray((n >> 3) + 1), 0, [], self.pair_ok
        while pos < n:
            left = at[pos]
            while left:
                token = left.pop()
                end = pos + len(token)
                if not failed[end >> 3] >> (end & 7) & 1 and (not stack or ok[stack[-1], token]):
                    stack.append(token)
                    pos = end
                    break
            else:
                c = part[pos]
                if c not in self.score:  # outside the vocabulary: nothing merges with it
                    stack.append(c)
                    pos += 1
                else:
                    failed[pos >> 3] |= 1 << (pos & 7)
                    pos -= len(stack.pop())
        return stack

    def _cuts(self, chunk: str) -> list[str]:
        """The chunk cut between characters that no piece holds side by side."""
        out, a, spans = [], 0, self.spans
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in spans:
                out.append(chunk[a:k])
                a = k
        out.append(chunk[a:])
        return out

    def _part(self, part: str) -> tuple[str, str]:
        """Ids of a part joined by commas, and what they decode to, with blanks for the space mark."""
        tokens, ids = self._tokens(part), self.ids
        try:
            return ",".join([str(ids[t]) for t in tokens]), "".join(tokens).replace(SPACE, " ")
        except KeyError:
            n = [i for t in tokens for i in ([ids[t]] if t in ids else [self.byte_id[b] for b in t.encode("utf-8", "surrogatepass")])]
            return ",".join(map(str, n)), self._decode(n)

    def _render(self, chunk: str) -> tuple[str, str]:
        cuts = self._cuts(chunk)
        if len(cuts) == 1:
            return self.part[chunk]
        both = [self.part[c] for c in cuts]
        return ",".join([a for a, _ in both]), "".join([b for _, b in both])

    def _decode(self, ids: list[int]) -> str:
        """The pieces of ids in a row, blanks for the space mark, before the dummy prefix is taken off."""
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_lenient(bytes(raw)))
                raw.clear()
            if i not in self.silent:
                out.append(self.unknown.get(i) or self.pieces[i])
        if raw:
            out.append(_lenient(bytes(raw)))
        return "".join(out).replace(SPACE, " ")

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self._render(SPACE + text.replace(" ", SPACE))[0].split(",")] if text else []

    def decode(self, ids: list[int]) -> str:
        text = self._decode(ids)
        return text[1:] if text.startswith(" ") else text

    def both(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the decoded text."""
        if not text:
            return 0, "", ""
        if not self.line_apart or SPACE in text or not plain_spacing(text):
            ids = self.encode(text)
            return len(ids), ",".join(map(str, ids)), self.decode(ids)
        inner, outer = self.inner.__getitem__, self.outer
        parts, first = [], True
        for line in text.split("\n"):
            words = line.split(" ")
            if first:
                parts += map(inner, words)
                first = False
            else:
                parts.append(outer["\n"])
                parts.append(outer[words[0]])
                parts += map(inner, words[1:])
        ids = ",".join([a for a, _ in parts])
        decoded = "".join([b for _, b in parts])
        return ids.count(",") + 1, ids, decoded[1:] if decoded[:1] == " " else decoded


def _lenient(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def codec(path: str | None = None) -> PieceCodec:
    """One per worker and model."""
    path = path or default_path()
    if path not in _OPEN:
        _OPEN[path] = PieceCodec(path)
    return _OPEN[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and either ids (array of int) and decoded (text) or, with ``digests``, their SHA-256."""
    model = model or default_path()
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in batches:
            n, x, y = [], [], []
            for text in b.column(1).to_pylist():
                count, ids, decoded = own.both(text)
                n.append(count)
                x.append(hashlib.sha256(ids.encode()).hexdigest() if digests else [int(i) for i in ids.split(",") if i])
                y.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest() if digests else decoded)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string() if digests else pa.list_(pa.int32())), pa.array(y, pa.string())], names=["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])])

    return map_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), step, schema)
