"""Byte-level BPE by the backtracking method, and columns of token ids.

A piece of text is covered by longest vocabulary matches, found for all its positions by one pass of an
Aho-Corasick automaton. A match may follow another only if the two could stand side by side in the result of
the merges; a table of merges answers that for any pair. Where no match fits, the last one is shortened to
its next prefix in the vocabulary. Each position is left at most once, so a piece takes linear time and comes
out exactly as merging by rank would have it.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# White space by its Unicode property, and the pieces within a run of other characters.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
#: Characters of the longest chunk, and number of chunks, that a worker remembers; others are encoded anew.
MEMO_CHARACTERS, MEMO_ENTRIES = 48, 250_000
#: Token ids or bytes of text after which a worker hands on a batch.
FLUSH = 2_000_000


def byte_symbols() -> dict[str, int]:
    """Symbol of each byte in byte-level vocabularies: itself where printable, else the next of 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Tables of one vocabulary: tokens as bytes, their merges, prefixes, automaton and decoding offsets."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbols = byte_symbols()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = model["vocab"]
        self.single = [names[s] for s, _ in sorted(symbols.items(), key=lambda x: x[1])]
        tokens: dict[int, bytes] = {names[s]: bytes([b]) for s, b in symbols.items()}
        self.parts = {i: (i, i) for i in tokens}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = {i: -1 for i in tokens}
        for rank, (left, right) in enumerate(merges):
            a, b, whole = names[left], names[right], names[left + right]
            tokens[whole] = tokens[a] + tokens[b]
            self.parts.setdefault(whole, (a, b))
            self.merged.setdefault((a, b), whole)
            self.rank.setdefault(whole, rank)
        self.ids = {text: i for i, text in tokens.items()}
        self.text = tokens
        self.shorter: dict[int, int] = {}
        for i, text in tokens.items():
            for n in range(len(text) - 1, 0, -1):
                if (prefix := self.ids.get(text[:n])) is not None:
                    self.shorter[i] = prefix
                    break
        self.automaton = ahocorasick.Automaton()
        for i, text in tokens.items():
            self.automaton.add_word(text.decode("latin-1"), (len(text), i))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}
        self.known_sizes: dict[str, bytes] = {}
        # Decoding: all tokens' bytes in one buffer, and where each begins.
        self.lengths = np.zeros(max(tokens) + 1, dtype=np.int64)
        for i, text in tokens.items():
            self.lengths[i] = len(text)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        # Each token's length as an item of an array, to be joined with others.
        self.item = np.dtype(np.uint8 if self.lengths.max() < 256 else np.uint32)
        self.items = [n.tobytes() for n in self.lengths.astype(self.item)]
        self.buffer = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(max(tokens) + 1)), dtype=np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the two tokens side by side."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= 2 * MEMO_ENTRIES:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the two tokens' latest merges step by step. A merge across the seam that comes before the merge
        # undone last would have been made first, and the tokens would never have met.
        bound = len(self.merged)
        while True:
            across = self.merged.get((left, right))
            if across is not None and self.rank[across] < bound:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                bound, left = a, self.parts[left][1]
            else:
                # Of equal merges the left one is made first: one across the seam precedes the right token's.
                bound, right = b + 1, self.parts[right][0]

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest: list[int] = [0] * n
        reach = bytearray(n) if n < 256 else [0] * n
        for end, (size, token) in self.automaton.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = min(size, 255), token
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(self.text[token])
            if open_[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif token in self.shorter:
                token = self.shorter[token]
            else:
                open_[at] = 0
                token = out.pop()
                at -= len(self.text[token])

    def chunk(self, text: str) -> list[int]:
        """Token ids of a run of characters, with the blank before it, or of white space."""
        pieces = PIECES.findall(text) or [text]
        found = self.piece(pieces[0].encode()) if len(pieces) == 1 else list(chain.from_iterable([self.piece(p.encode()) for p in pieces]))
        if len(text) <= MEMO_CHARACTERS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[text] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text without special tokens; none for an empty or null text."""
        if not text:
            return []
        memo, chunk = self.memo.get, self.chunk
        return list(chain.from_iterable([memo(c) or chunk(c) for c in CHUNKS.findall(text)]))

    def _sizes(self, text: str, whole: bool) -> bytes:
        """Sizes of the tokens of a piece, if it is a whole one, or of a chunk. Both share one memo, as a piece by itself is a chunk of that piece."""
        if whole:
            found = b"".join([self.items[i] for i in self.piece(text.encode())])
        else:
            memo, pieces = self.known_sizes.get, PIECES.findall(text) or [text]
            found = b"".join([memo(p) or self._sizes(p, True) for p in pieces])
            if len(pieces) == 1:
                return found
        if len(text) <= MEMO_CHARACTERS:
            if len(self.known_sizes) >= MEMO_ENTRIES:
                self.known_sizes.clear()
            self.known_sizes[text] = found
        return found

    def sizes(self, text: str | None) -> np.ndarray:
        """Bytes of each token of a text: the lengths of what ``encode`` gives, without lists of ids. Pieces are
        remembered, too, since new chunks, as addresses and numbers, are mostly made of known ones."""
        if not text:
            return np.empty(0, self.item)
        memo = self.known_sizes.get
        return np.frombuffer(b"".join([memo(c) or self._sizes(c, False) for c in CHUNKS.findall(text)]), dtype=self.item)

    def decode(self, ids: list[int]) -> str:
        """The text of token ids, by offsets into the buffer of all tokens."""
        i = np.asarray(ids, dtype=np.int64)
        sizes = self.lengths[i]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[i] - (ends - sizes), sizes)
        return self.buffer[take].tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, once per process."""
    return Encoder(path)


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(``key``, ``ids``): the token ids of each row's text, without special tokens.

    Empty and null texts have no ids: an empty list. Every row gives a row, repeated ones too; texts are
    encoded whole at any length; other columns are not read.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            ids, ends, first = array("i"), [0], 0
            for row, t in enumerate(batch.column("t")):
                ids.extend(encode(t.as_py()))
                ends.append(len(ids))
                if len(ids) >= FLUSH:
                    yield _lists(batch.column("k").slice(first, row + 1 - first), ids, ends)
                    ids, ends, first = array("i"), [0], row + 1
            if first < batch.num_rows:
                yield _lists(batch.column("k").slice(first), ids, ends)

    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def _lists(keys: pa.Array, ids: array, ends: list[int]) -> pa.RecordBatch:
    values = pa.array(np.frombuffer(ids, dtype=np.int32) if len(ids) else np.empty(0, np.int32))
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["k", "ids"])


def token_counts(df: DataFrame, keys: list[str], text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The keys with ``tokens``, the number of token ids of each row's text; 0 for empty and null texts."""
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t"))
    schema = ", ".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            sizes = pa.array([len(encode(t.as_py())) for t in batch.column("t")], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(f"k{i}") for i in range(len(keys))] + [sizes], names=[f"k{i}" for i in range(len(keys))] + ["tokens"])

    counted = rows.mapInArrow(run, f"{schema}, tokens int")
    return counted.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "tokens")
