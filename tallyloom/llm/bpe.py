"""Exact byte-level BPE in linear time: a backtracking encoder over Aho-Corasick matches.

A sequence of tokens is the one BPE produces exactly when every two neighbours in it are compatible:
BPE, run on their joined bytes, keeps the border between them. The encoder walks from the left,
takes the longest token at each place whose pair with the token before it is compatible, shortens it
when it isn't, and steps back when nothing fits. Places that failed once are never tried again, so
the work is linear. All longest tokens of a piece come from one Aho-Corasick pass; decoding gathers
bytes through an offset table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

#: Where the public vocabularies lie; a parameter of every function that needs one.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the pattern that splits a text into pieces, which tokens never cross.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker; the memory is emptied when full, which changes no result.
REMEMBERED = 150_000
#: Longer pieces are encoded each time.
SHORT = 48


class BytePairs:
    """The tables of one vocabulary: ranks, last merges, next shorter prefixes, matcher, offsets."""

    def __init__(self, vocabulary: bytes):
        import ahocorasick
        import regex

        self.rank: dict[bytes, int] = {}
        for line in vocabulary.splitlines():
            if line:
                token, number = line.split()
                self.rank[base64.b64decode(token)] = int(number)
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, number in self.rank.items():
            self.token[number] = token
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.token])]).astype(np.int64)
        self.joined = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.merged: dict[tuple[int, int], int] = {}
        self.left = list(range(len(self.token)))
        self.right = list(range(len(self.token)))
        self.known: dict[tuple[int, int], bool] = {}
        for number, token in enumerate(self.token):
            if len(token) > 1:
                self._last_merge(number, token)
        self.known.clear()
        self.shorter = [next((p for k in range(len(t) - 1, 0, -1) if (p := self.rank.get(t[:k])) is not None), -1) for t in self.token]
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, number in self.rank.items():
            self.matcher.add_word(token.decode("latin-1"), number)
        self.matcher.make_automaton()
        self.split = regex.compile(PIECES).findall
        self.memory: dict[str, tuple[int, ...]] = {}

    def _last_merge(self, number: int, token: bytes) -> None:
        """The merge that makes a token: its only split into two earlier, compatible tokens."""
        for k in range(1, len(token)):
            a, b = self.rank.get(token[:k], number), self.rank.get(token[k:], number)
            if a < number and b < number and self.compatible(a, b):
                self.left[number], self.right[number] = a, b
                self.merged[a, b] = number
                return

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps the border between two neighbouring tokens.

        Undoes, latest merge first, the merges on both sides of the border; the border falls if two
        parts that stood there together merge earlier than either would have been merged away.
        """
        if (answer := self.known.get((a, b))) is not None:
            return answer
        x, y, before, keeps = a, b, len(self.token), True
        while True:
            made = self.merged.get((x, y))
            if made is not None and made < before:
                keeps = False
                break
            if x > y:
                before, x = x, self.right[x]
                if x != before:
                    continue
                # a single byte can't be undone; the other side is
                before, y = y + 1, self.left[y]
                if y + 1 == before:
                    break
            else:
                before, y = y + 1, self.left[y]
                if y + 1 != before:
                    continue
                before, x = x, self.right[x]
                if x == before:
                    break
        if len(self.known) > 2_000_000:
            self.known.clear()
        self.known[a, b] = keeps
        return keeps

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        size = len(data)
        longest = [-1] * size
        token = self.token
        for end, number in self.matcher.iter(data.decode("latin-1")):
            longest[end + 1 - len(token[number])] = number
        shorter, known, compatible = self.shorter, self.known, self.compatible
        dead = bytearray(size + 1)
        out: list[int] = []
        at, number = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while number >= 0:
                end = at + len(token[number])
                if not dead[end] and (last < 0 or (known[last, number] if (last, number) in known else compatible(last, number))):
                    break
                number = shorter[number]
            if number >= 0:
                out.append(number)
                at = end
                if at == size:
                    return out
                number = longest[at]
            else:
                dead[at] = 1
                back = out.pop()
                at -= len(token[back])
                number = shorter[back]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts have none. Lone surrogates count as U+FFFD."""
        ids: list[int] = []
        if not text:
            return ids
        memory = self.memory
        for piece in self.split(text):
            got = memory.get(piece)
            if got is None:
                got = tuple(self.piece(piece.encode("utf-8", "replace")))
                if len(piece) <= SHORT:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = got
            ids += got
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a list of ids, gathered through the offset table."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return self.joined[shift + np.arange(int(sizes.sum()))].tobytes()


_tables: dict[int, BytePairs] = {}


def tables(vocabulary: bytes) -> BytePairs:
    """The tables of a vocabulary, built once in a process."""
    key = hash(vocabulary)
    if key not in _tables:
        _tables[key] = BytePairs(vocabulary)
    return _tables[key]


def read_vocabulary(name: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def shared_vocabulary(df: DataFrame, name: str = VOCABULARY, folder: str = TOKENIZER_DIR):
    """A broadcast of the vocabulary file: under 1 MB, fixed, whatever the data."""
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(name, folder))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens.

    Null and empty texts get an empty list. Strings that look like special tokens are ordinary
    text. Every row is encoded, also repeated ones and null keys; other columns are not read.
    Nothing is shuffled.
    """
    shared = shared_vocabulary(df, name, folder)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(shared.value)
        for batch in batches:
            lists = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int32)
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["k", "ids"])

    out = df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, text): the texts of lists of ids; a null list gives null, an empty one the empty text.
    Bytes that are no UTF-8 come out as U+FFFD."""
    shared = shared_vocabulary(df, name, folder)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(shared.value)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    return df.select(df[key].alias("k"), df[ids].alias("i")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def count(df: DataFrame, keep: list[str], text: str = "text", name: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(keep, n_tokens): the number of ids of each row's text, 0 for null and empty texts."""
    shared = shared_vocabulary(df, name, folder)
    kinds = ", ".join(f"`c{i}` {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(shared.value)
        for batch in batches:
            sizes = pa.array([len(bpe.encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*(f"c{i}" for i in range(len(keep))), "n_tokens"])

    out = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(keep)], df[text].alias("t")).mapInArrow(run, f"{kinds}, n_tokens long")
    return out.select(*[out[f"c{i}"].alias(c) for i, c in enumerate(keep)], "n_tokens")
