"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie of bytes. Where a longest match ends, the failure link of the node leads to the node of what is
left over after the pieces that can be popped by then, and their number is stored beside it; so each byte of a word is
read once and no piece is ever built.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Words whose length is remembered in a worker; then it starts anew.
REMEMBERED = 200_000


class Automaton(NamedTuple):
    child: list[dict[int, int]]
    fail: list[int]  # -1: nothing can be matched
    popped: list[int]
    start: int  # of words
    go_on: int  # of what follows within a word


def build(pieces: Iterable[bytes], mark: bytes = b"") -> Automaton:
    """The automaton of a vocabulary; with ``mark`` (such as ``##``), pieces within a word are those that begin with it."""
    child: list[dict[int, int]] = [{}, {}] if mark else [{}]
    start, go_on = 0, len(child) - 1
    final = set()
    for piece in pieces:
        node = start
        if mark and piece.startswith(mark):
            node, piece = go_on, piece[len(mark) :]
        if not piece:
            continue
        for byte in piece:
            if (after := child[node].get(byte)) is None:
                after = child[node][byte] = len(child)
                child.append({})
            node = after
        final.add(node)
    fail, popped = [-1] * len(child), [0] * len(child)
    level = list(dict.fromkeys((start, go_on)))
    while level:
        below = []
        for node in level:
            for byte, after in child[node].items():
                below.append(after)
                if after in final:
                    fail[after], popped[after] = go_on, 1
                    continue
                z, n = fail[node], popped[node]
                while z >= 0 and byte not in child[z]:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[after], popped[after] = child[z][byte], n
        level = below
    return Automaton(child, fail, popped, start, go_on)


def length(word: bytes, a: Automaton) -> int:
    """Pieces of the greedy longest-match cut of a word; 1, the unknown piece, if there is none."""
    node, n = a.start, 0
    for byte in word:
        while (after := a.child[node].get(byte)) is None:
            n += a.popped[node]
            node = a.fail[node]
            if node < 0:
                return 1
        node = after
    while node != a.go_on:
        if node == a.start and not n:
            return 0
        n += a.popped[node]
        node = a.fail[node]
        if node < 0:
            return 1
    return n


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(path: str = VOCABULARY, end: str = "</w>") -> list[bytes]:
    """Pieces of a byte-level vocabulary file as bytes; the mark of a word's end is dropped."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    bare = (name.removesuffix(end) for name in names)
    return sorted({bytes(letters[c] for c in name) for name in bare if name and all(c in letters for c in name)})


class Lengths(dict):
    """Word -> pieces, computed when first asked for."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = length(word, self.automaton)
        return n


def token_counts(docs: DataFrame, pieces: list[bytes] | None = None, mark: bytes = b"", lower: bool = True) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row of ``docs`` (doc_id, text; further columns are ignored).

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z as a-z if ``lower``. A word that the pieces can't cut is one unknown token. Null
    and empty texts have none; an empty table gives an empty one. The vocabulary's automaton is broadcast: its size is
    the vocabulary's.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(build(pieces if pieces is not None else vocabulary(), mark))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lengths(automaton.value)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                found = (data.lower() if lower else data).split()
                words.append(len(found))
                tokens.append(sum(map(known.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_words long, n_tokens long").fields])
    return docs.select("doc_id", "text").mapInArrow(count, schema)
