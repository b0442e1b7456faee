"""Operator 4: byte-level BPE by prefix dynamic programming.

For every prefix of a piece of bytes, exactly one token can end its encoding: the token whose predecessor, itself the
last token of the shorter prefix, does not merge with it. ``last[i]`` stores that token, so the encoding of every prefix
can be read off backwards, appending bytes only extends ``last``, and an edit re-encodes from the edit on (and
stops early in the tail when it is aligned again). Two tokens stand side by side when undoing their merges, latest
first, never shows a pair at their border that would have been merged earlier.

Defined cases: a null text is empty; an empty text has no tokens; very long pieces cost time in proportion to their
length; repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from stavelake.llm.common import table
from stavelake.llm.tokens import slices

CACHE_PIECES = 500_000
CACHED_PIECE_BYTES = 64


class Vocabulary:
    """Ranks, and for each token the two tokens that merge into it."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            self.tokens[rank] = word
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, self.ranks))
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for word, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(word) > 1:
                self._learn(word, rank)
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _learn(self, word: bytes, rank: int) -> None:
        """The last merge that builds ``word`` from tokens of lower rank."""
        pieces = [bytes([b]) for b in word]
        while len(pieces) > 2:
            pairs = [(self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))]
            low, i = min(pairs)
            if low >= rank:
                raise ValueError("a token that its merges cannot build")
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        pair = tuple(self.ranks[x] for x in pieces)
        self.parts[rank] = pair
        self.merges[pair] = rank

    def _border(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two tokens."""
        limit = 1 << 31
        while True:
            merged = self.merges.get((a, b))
            if merged is not None and merged < limit:
                return False
            # Undo the later of the two merges: of equal ranks the left one came first. A pair at the border then
            # must not have come before it, and of equal ranks the border's pair comes before the right one.
            if a > b:
                if a not in self.parts:
                    return True
                limit, a = a, self.parts[a][1]
            else:
                if b not in self.parts:
                    return True
                limit, b = b + 1, self.parts[b][0]

    def extend(self, piece: bytes, last: list[int], to: int | None = None) -> None:
        """Appends the last token of each further prefix of ``piece`` to ``last`` (``last[0]`` is unused)."""
        get, known, border, longest, push = self.ranks.get, self._fits, self._border, self.longest, last.append
        if len(known) > 2_000_000:
            known.clear()
        for end in range(len(last), (len(piece) if to is None else to) + 1):
            start = 0
            if end > longest:
                start = end - longest
            token = get(piece[start:end])
            while True:
                if token is not None:
                    if not start:
                        break
                    key = last[start] << 20 | token
                    fits = known.get(key)
                    if fits is None:
                        fits = known[key] = border(last[start], token)
                    if fits:
                        break
                start += 1
                token = get(piece[start:end])
            push(token)

    def read(self, last: list[int], end: int) -> list[int]:
        """The encoding of the prefix of ``end`` bytes."""
        out = []
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        last = [-1]
        self.extend(piece, last)
        return self.read(last, len(piece))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, out = self._cache.get, []
        for piece in self.pattern.findall(text):
            out.append(get(piece) or self._piece(piece))
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece that the newer half of the cache lacks. Two halves keep what is used often."""
        ids = self._cache.get(piece) or self._older.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = np.array(self.encode_piece(raw), "<u4").tobytes()
            if len(raw) > CACHED_PIECE_BYTES:
                return ids
        if len(self._cache) >= CACHE_PIECES:
            self._older = self._cache.copy()
            self._cache.clear()
        self._cache[piece] = ids
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class EditableText:
    """A text with its encoding: appends and edits re-encode only what can change."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.pieces, self.tables = vocabulary, [], []
        self._grow(text)

    def _grow(self, text: str) -> None:
        for piece in self.vocabulary.pattern.findall(text):
            raw = piece.encode()
            last = [-1]
            if self._spare and raw.startswith(self._spare[0]):  # the grown last piece keeps its table
                last = self._spare[1]
            self._spare = None
            self.vocabulary.extend(raw, last)
            self.pieces.append(piece)
            self.tables.append(last)

    _spare: tuple[bytes, list[int]] | None = None

    def append(self, text: str) -> None:
        """Only the last two pieces can change: what stands before them ended at a character that stays."""
        held = self.pieces[-2:]
        kept_tables = self.tables[-2:]
        del self.pieces[-2:], self.tables[-2:]
        if held:
            self._spare = (held[0].encode(), kept_tables[0])
        self._grow("".join(held) + text)
        self._spare = None

    def replace(self, start: int, end: int, text: str) -> None:
        """Characters start to end become ``text``; pieces before the edit and, once aligned again, after it stay."""
        at, first = 0, 0
        while first < len(self.pieces) and at + len(self.pieces[first]) <= start:
            at += len(self.pieces[first])
            first += 1
        for _ in range(2):
            if first:
                first -= 1
                at -= len(self.pieces[first])
        whole = "".join(self.pieces[first:])
        edited = whole[: start - at] + text + whole[end - at :]
        shift = len(edited) - len(whole)
        old, position = {}, 0
        for i, piece in enumerate(self.pieces[first:]):
            old[position + shift] = i + first
            position += len(piece)
        safe, position, fresh = start - at + len(text), 0, []
        for found in self.vocabulary.pattern.finditer(edited):
            if found.start() >= safe and found.start() in old:
                i = old[found.start()]
                fresh_tables = [self._table(x) for x in fresh]
                self.tables[first:i], self.pieces[first:i] = fresh_tables, fresh
                return
            fresh.append(found.group())
        self.tables[first:], self.pieces[first:] = [self._table(x) for x in fresh], fresh

    def _table(self, piece: str) -> list[int]:
        last = [-1]
        self.vocabulary.extend(piece.encode(), last)
        return last

    def ids(self) -> list[int]:
        return [t for table_, piece in zip(self.tables, self.pieces) for t in self.vocabulary.read(table_, len(piece.encode()))]


@functools.lru_cache(maxsize=1)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def tokenized(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every document. The file is on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for part, column in slices(batches):
            sizes, ids_hash, text_hash, ids = [], [], [], []
            for text in column.to_pylist():
                raw = v.encode(text)
                found = np.frombuffer(raw, "<u4")
                sizes.append(len(found))
                ids_hash.append(hashlib.sha256(raw).hexdigest())
                text_hash.append(hashlib.sha256(v.decode(found)).hexdigest())
                if with_ids:
                    ids.append(found.astype(np.int32))
            out = [part.column(part.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"), *public_vocabulary())
