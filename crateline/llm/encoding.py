"""Encoding whole texts with a public byte-level BPE tokenizer.

The encoding of a text is computed as a monoid tree reduction: the text is cut
into leaves of fixed length, the leaves are encoded, and neighbours are joined
pairwise up the tree. A cut may fall inside a word, so a join re-encodes a
window around it; the window grows on either side until it reaches a place
where the tokenizer's splitting pattern must always split. Pieces before and
behind such a place never influence each other, so the tokens outside the
window provably stay as they are. Decoding concatenates up the same tree.

Defined results: NULL and empty texts have the empty list of ids. Strings of
special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateline.operators.partitions import spread

#: Where the vocabulary lies unless told otherwise.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Characters of a leaf, and the first reach of a joining window to either side.
LEAF_CHARS, FIRST_REACH = 4096, 32


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a vocabulary file and the bytes that each id stands for, once per worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if not os.path.exists(path):  # a worker that has the vocabularies as an installed package
        import public_tokenizers

        path = public_tokenizers.path(os.path.basename(path))
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    lengths = np.zeros(max(vocabulary.values(), default=0) + 2, dtype=np.int64)
    for token, number in vocabulary.items():
        lengths[number] = len(token)  # one character per byte in this vocabulary
    return tokenizer, lengths


def _kind(c: str) -> str:
    """L(etter), N(umber), O(ther visible), or ? where the pattern's view may differ between Unicode versions."""
    first = unicodedata.category(c)[0]
    return {"L": "L", "N": "N", "P": "O", "S": "O"}.get(first, "?")


def must_split(text: str, i: int) -> bool:
    """Whether the splitting pattern starts a new piece at ``i`` in any context.

    No piece of the pattern holds a space behind something visible, nor
    characters of two different kinds, but for a contraction such as ``'s``.
    """
    before, here = text[i - 1], text[i]
    kind = _kind(before)
    if kind == "?":
        return False
    if here in " \n":
        return True
    other = _kind(here)
    return other not in ("?", kind) and not (before == "'" and other == "L")


def _stable_before(text: str, start: int, end: int) -> int:
    """The last sure splitting place in (start, end), searched in growing windows; else ``start``."""
    reach, at = FIRST_REACH, end - 1
    while at > start:
        stop = max(start, end - reach)
        while at > stop:
            if must_split(text, at):
                return at
            at -= 1
        reach *= 4
    return start


def _stable_behind(text: str, start: int, end: int) -> int:
    """The first sure splitting place in (start, end), searched in growing windows; else ``end``."""
    reach, at = FIRST_REACH, start + 1
    while at < end:
        stop = min(end, start + reach)
        while at < stop:
            if must_split(text, at):
                return at
            at += 1
        reach *= 4
    return end


@dataclass
class _Node:
    start: int
    end: int
    ids: np.ndarray


class TreeEncoder:
    """Encodes texts by tree reduction; exact for every text."""

    def __init__(self, path: str = DEFAULT_VOCABULARY, leaf_chars: int = LEAF_CHARS):
        self.tokenizer, self.lengths = load_tokenizer(path)
        self.leaf_chars = leaf_chars

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.asarray(e.ids, dtype=np.int32) for e in encode(texts, add_special_tokens=False)]

    def _cut(self, ids: np.ndarray, size: int) -> int:
        """How many tokens make up the first ``size`` bytes."""
        ends = np.cumsum(self.lengths[ids])
        k = int(np.searchsorted(ends, size)) + 1 if size else 0
        if size and ends[k - 1] != size:
            raise AssertionError("a sure splitting place lies inside a token")
        return k

    def _join(self, text: str, pairs: list[tuple[_Node, _Node]]) -> list[_Node]:
        windows = []
        for left, right in pairs:
            a = _stable_before(text, left.start, left.end)
            b = _stable_behind(text, right.start, right.end)
            windows.append((a, b))
        middles = self._direct([text[a:b] for a, b in windows])
        out = []
        for (left, right), (a, b), middle in zip(pairs, windows, middles, strict=True):
            head = left.ids[: self._cut(left.ids, len(text[left.start : a].encode()))]
            tail = right.ids[self._cut(right.ids, len(text[right.start : b].encode())) :]
            out.append(_Node(left.start, right.end, np.concatenate([head, middle, tail])))
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        leaves, spans = [], []
        for text in texts:
            text = text or ""
            cuts = range(0, len(text), self.leaf_chars)
            spans.append([(i, min(len(text), i + self.leaf_chars)) for i in cuts])
            leaves += [text[a:b] for a, b in spans[-1]]
        encoded = iter(self._direct(leaves) if leaves else [])
        out = []
        for text, cuts in zip(texts, spans, strict=True):
            nodes = [_Node(a, b, next(encoded)) for a, b in cuts]
            while len(nodes) > 1:
                pairs = [(nodes[i], nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
                nodes = self._join(text, pairs) + (nodes[-1:] if len(nodes) % 2 else [])
            out.append(nodes[0].ids if nodes else np.empty(0, dtype=np.int32))
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ``ids``: the bytes of both halves, concatenated up the tree."""
        pieces = [self._bytes(i) for i in ids]
        while len(pieces) > 1:
            pieces = [b"".join(pieces[i : i + 2]) for i in range(0, len(pieces), 2)]
        return (pieces[0] if pieces else b"").decode("utf-8", errors="replace")

    def _bytes(self, number: int) -> bytes:
        table = byte_alphabet()
        return bytes(table[c] for c in self.tokenizer.id_to_token(int(number)))


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: visible Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


#: Characters handed to the tokenizer at once.
_CHUNK_CHARS = 2_000_000


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= _CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_ids(df: DataFrame, id_column: str, text_column: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every text."""
    slim = spread(df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                ids = encoder.encode(texts[a:b])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), listed], ["doc_id", "ids"])

    return slim.mapInArrow(encode, "doc_id bigint, ids array<int>")


def token_counts(df: DataFrame, id_column: str, text_column: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): how many tokens every text has."""
    slim = spread(df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                sizes = pa.array([len(x) for x in encoder.encode(texts[a:b])], type=pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sizes], ["doc_id", "n_tokens"])

    return slim.mapInArrow(count, "doc_id bigint, n_tokens bigint")
