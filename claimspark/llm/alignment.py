"""Alignment of two tokenizers over the same bytes, and how often token pairs meet in the whole corpus.

Both token sequences of a text cover the same bytes, so the text falls into groups at the offsets where both have a token's end.
Long stretches are one to one. There the two arrays of ends are equal at a constant index shift: a probe compares slices
at that shift and doubles while they are equal, then halves to the first difference, so that a stretch is jumped in few
comparisons. What follows is an irregular group; it is resolved token by token, and the shift is updated.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import discard, materialise
from claimspark.llm.hashing import lists
from claimspark.llm.token_count import byte_letters

BYTE_FILE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters that are encoded at once; a longer run without a place to cut is one piece.
PIECE = 1 << 16
#: Texts that become one batch of results, and pieces, or their characters, that are encoded in one call.
ROWS, CALL_TEXTS, CALL_CHARS = 1024, 256, 1 << 18
#: A pair's number has so many bits at most.
PAIR_BITS = 48
#: Pairs whose counts are broadcast: the most frequent ones, 17 bytes each. All others are joined.
HOT = 1 << 20
#: Pairs that a task holds before it passes partial counts on.
HELD = 1 << 21
#: How byte-level tokenizers cut a text before merging. Fixed value.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs that the quicker encoder isn't made for.
LONG, LONG_BLANK = 400, re.compile(r"\s{200}")
#: Slices of ends that are compared at first.
LEAST = 8
#: Groups of more pairs than this are counted by distinct ids on either side.
WIDE = 4096


class Tokenizers:
    """The two tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        self.byte_file, self.piece_file = byte_file, piece_file

    @cached_property
    def _byte(self):  # noqa: ANN202
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.byte_file)
        found.encode_special_tokens = True
        return found

    @cached_property
    def _quick(self):  # noqa: ANN202
        """The same encoder from the same file by ranks, where merges have ids in their order and cuts are the usual ones."""
        import tiktoken

        with open(self.byte_file, encoding="utf-8") as f:
            made = json.load(f)
        model, cut = made["model"], made["pre_tokenizer"] or {}
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not made["normalizer"] and not model.get("ignore_merges")
        tokens, vocab = self.byte_tokens, model["vocab"]
        merged = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        if not usual or not all(vocab[m] == 256 + k for k, m in enumerate(merged)) or any(len(t) != 1 for t in tokens[:256]):
            return None
        ranks = {tokens[k]: k for k in range(256 + len(model["merges"]))}
        return tiktoken.Encoding("bytes", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def _piece(self):  # noqa: ANN202
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=self.piece_file)

    @cached_property
    def byte_tokens(self) -> list[bytes]:
        letters = byte_letters()
        with open(self.byte_file, encoding="utf-8") as f:
            made = json.load(f)
        names = made["model"]["vocab"] | {t["content"]: t["id"] for t in made.get("added_tokens", ())}
        out = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            out[number] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        return out

    @cached_property
    def piece_tokens(self) -> list[bytes]:
        m = self._piece
        return [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    @cached_property
    def cuttable(self) -> bool:
        """Whether no piece holds a space after anything else, so that a text may be cut before a single space."""
        return not any(b" " in p.lstrip(b" ") for p in self.piece_tokens)

    def pieces(self, text: str) -> list[str]:
        """Parts of a text, without the space before each, that both tokenizers encode as they would within the whole."""
        if len(text) <= PIECE or not self.cuttable:
            return [text]
        out, begin = [], 0
        while len(text) - begin > PIECE:
            at = text.find(" ", begin + PIECE // 2)
            while at >= 0 and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace() or at + 1 == len(text)):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            out.append(text[begin:at])
            begin = at + 1
        return [*out, text[begin:]]

    def quick(self, text: str) -> bool:
        """Whether the quicker encoder takes the text; it knows all bytes, so that its tokens always give the text back."""
        return self._quick is not None and max(map(len, text.split()), default=0) < LONG and not LONG_BLANK.search(text)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both for a space and each text, and whether the quicker encoder took it."""
        quick = list(map(self.quick, texts))
        ids = [self._quick.encode_ordinary(f" {t}") if q else self._byte.encode(f" {t}", add_special_tokens=False).ids for t, q in zip(texts, quick)]
        return ids, self._piece.encode(texts, num_threads=1), quick


def runs(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(i, n, j) of each run: a stretch of ``n`` one-to-one groups from those indices on, or with ``n`` 0 one group of more tokens.

    ``a`` and ``b`` are ascending ends of tokens; the last ones are equal.
    """
    starts_a, sizes, starts_b = [], [], []
    i = j = 0
    while i < len(a):
        starts_a.append(i)
        starts_b.append(j)
        if a[i] == b[j]:
            # At this index shift: slices double while they are equal, then halve to the first difference.
            p, q, step = i + 1, j + 1, LEAST
            while (same := a[p : p + step]) == b[q : q + step]:
                p, q = p + len(same), q + len(same)
                if len(same) < step:
                    break
                step *= 2
            while step > LEAST:
                step //= 2
                if (same := a[p : p + step]) == b[q : q + step]:
                    p, q = p + len(same), q + len(same)
            for x, y in zip(a[p : p + LEAST], b[q : q + LEAST]):
                if x != y:
                    break
                p, q = p + 1, q + 1
            sizes.append(p - i)
            i, j = p, q
            continue
        while (x := a[i]) != (y := b[j]):
            if x < y:
                i += 1
            else:
                j += 1
        sizes.append(0)
        i, j = i + 1, j + 1
    return starts_a, sizes, starts_b


class Text:
    """What is gathered of a text, call by call."""

    def __init__(self) -> None:
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.digest = hashlib.sha256()

    def add(self, n_a: int, n_b: int, written: str, n_groups: int, keys: np.ndarray, times: np.ndarray) -> None:
        self.digest.update((";" * bool(self.n_groups) + written).encode())
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups, self.n_links + int(times.sum())
        self.pairs.append((keys, times))

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs, a number each, ascending, and how often they are linked."""
        return self.pairs[0] if len(self.pairs) == 1 else _added([k for k, _ in self.pairs], [n for _, n in self.pairs])


def _added(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their times."""
    both, at = np.unique(np.concatenate(keys), return_inverse=True)
    return both, np.bincount(at, np.concatenate(times), len(both)).astype(np.int64)


def _places(lead: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each of ``lead`` on."""
    return np.repeat(lead - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _pairs(of: np.ndarray, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs of every part, the part's number above PAIR_BITS bits, ascending, and their links."""
    wide = n_a * n_b > WIDE
    each = np.repeat(np.where(wide, 0, n_b), n_a)
    left = np.repeat(a * width + (np.repeat(of, n_a) << PAIR_BITS), each)
    keys, times = np.unique(left + b[_places(np.repeat(first_b, n_a), each)], return_counts=True)
    if not wide.any():
        return keys, times
    more = []
    for g in np.flatnonzero(wide):
        (u, m), (v, n) = (np.unique(x[f : f + c], return_counts=True) for x, f, c in ((a, first_a[g], n_a[g]), (b, first_b[g], n_b[g])))
        more.append((((of[g] << PAIR_BITS) + u[:, None] * width + v).ravel(), np.outer(m, n).ravel()))
    return _added([keys, *(k for k, _ in more)], [times, *(n for _, n in more)])


class Aligner:
    """The tables of a worker, and the work on a call's parts."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.t = tokenizers
        a, b = tokenizers.byte_tokens, tokenizers.piece_tokens
        self.width = len(b)
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
        # How a token is written: a byte token within its group or at its end, then a piece likewise.
        self.written = [f"{k}{end}" for n, end in ((len(a), ","), (len(a), "|"), (len(b), ","), (len(b), ";")) for k in range(n)]

    def call(self, parts: list[tuple[Text, str]]) -> set[Text]:
        """Adds the parts to their texts; returns the texts that a tokenizer doesn't give back."""
        found = [(text, f" {part}".encode(), x, y, quick) for (text, part), x, y, quick in zip(parts, *self.t.encode([p for _, p in parts]))]
        joined = lambda tokens, ids: b"".join(map(tokens.__getitem__, ids))
        bad = {text for text, whole, x, y, quick in found if joined(self.t.piece_tokens, y) != whole or not quick and joined(self.t.byte_tokens, x) != whole}
        found = [f for f in found if f[0] not in bad]
        if not found:
            return bad
        lens_a, lens_b = (np.array([len(f[k]) for f in found]) for k in (2, 3))
        a, b = (np.fromiter(chain.from_iterable(f[k] for f in found), np.int64, n) for k, n in ((2, lens_a.sum()), (3, lens_b.sum())))
        # Parts end with a token in both sequences, so that one pass aligns them all and no group leaves its part.
        starts_a, sizes, starts_b = (np.array(x, np.int64) for x in runs(np.cumsum(self.size_a[a]).tolist(), np.cumsum(self.size_b[b]).tolist()))
        count = np.maximum(sizes, 1)
        first_a, first_b = _places(starts_a, count), _places(starts_b, count)
        n_a, n_b = np.diff(first_a, append=len(a)), np.diff(first_b, append=len(b))
        of = np.searchsorted(np.cumsum(lens_a), first_a, "right")

        base = len(self.size_a)
        code_a, code_b = a.copy(), b + 2 * base
        code_a[first_a + n_a - 1] += base
        code_b[first_b + n_b - 1] += self.width
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(first_b, n_a)] = code_a
        codes[np.arange(len(b)) + np.repeat(first_a + n_a, n_b)] = code_b
        codes = codes.tolist()

        keys, times = _pairs(of, a, b, first_a, first_b, n_a, n_b, self.width)
        bounds = np.searchsorted(keys, np.arange(len(found) + 1) << PAIR_BITS)
        keys &= (1 << PAIR_BITS) - 1
        ends, groups = np.cumsum(lens_a + lens_b), np.bincount(of, minlength=len(found))
        for k, (text, *_) in enumerate(found):
            written = "".join(map(self.written.__getitem__, codes[ends[k] - lens_a[k] - lens_b[k] : ends[k]]))
            inside = slice(bounds[k], bounds[k + 1])
            text.add(int(lens_a[k]), int(lens_b[k]), written[:-1], int(groups[k]), keys[inside], times[inside])
        return bad

    def texts(self, texts: list[str | None]) -> list[Text | None]:
        """Each text's alignment, or none where there are no tokens."""
        out = [Text() if x else None for x in texts]
        bad: set[Text] = set()
        call, chars = [], 0
        for text, value in zip(out, texts):
            for part in self.t.pieces(value) if text else ():
                if call and (len(call) >= CALL_TEXTS or chars + len(part) > CALL_CHARS):
                    bad |= self.call(call)
                    call, chars = [], 0
                call.append((text, part))
                chars += len(part)
        if call:
            bad |= self.call(call)
        return [None if x in bad else x for x in out]


def _text(value: bytes | None) -> str | None:
    try:
        return value.decode() if value else None
    except UnicodeDecodeError:
        return None


def groups(docs: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row of ``docs`` (doc_id, text).

    ``row`` numbers the rows; it is stable only in what has been written. ``pairs`` are the distinct linked id pairs, the
    byte id times the number of pieces plus the piece id, and ``times`` their links.
    """
    t = Tokenizers(byte_file, piece_file)
    fields = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    schema = T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], *T.StructType.fromDDL(fields).fields])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, none = Aligner(t), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            for begin in range(0, len(column), ROWS):
                found = aligner.texts([_text(x.as_py()) for x in column.slice(begin, ROWS)])
                linked = [x.linked() if x else none for x in found]
                n = np.array([len(p) for p, _ in linked])
                numbers = [[getattr(x, c) if x else 0 for x in found] for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + len(found)), pa.int64()), batch.column(0).slice(begin, ROWS), *(pa.array(x, pa.int64()) for x in numbers),
                    pa.array([x.digest.hexdigest() if x else "" for x in found], pa.string()),
                    lists(pa.array(np.concatenate([p for p, _ in linked])), n), lists(pa.array(np.concatenate([m for _, m in linked]).astype(np.int32)), n),
                ], schema.names)
                row += len(found)

    return docs.select("doc_id", "text").mapInArrow(align, schema)


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) of each linked pair: how many rows hold it, and whether that is the highest number of its byte id.

    Tasks add up theirs in numpy, so what is shuffled is a row for each pair and task at most.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, new, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            late, times = np.unique(np.concatenate([np.zeros(0, np.int64), *new]), return_counts=True)
            both, at = np.unique(np.concatenate((keys, late)), return_inverse=True)
            return both, np.bincount(at, np.concatenate((n, times)), len(both)).astype(np.int64)

        for batch in batches:
            new.append(_flat(batch.column(0)))
            held += len(new[-1])
            if held >= HELD:
                keys, n = merged()
                new, held = [], 0
                if len(keys) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])
                    keys = n = np.zeros(0, np.int64)
        keys, n = merged()
        for k in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], ["pair", "n"])

    counts = aligned.select("pairs").mapInArrow(fold, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("a", F.expr(f"pair div {width}"))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs`` (doc_id, text).

    A is the byte-level tokenizer over a space and the text, B the piece one, which adds that space. Further columns are
    ignored. Texts that are null, empty, not UTF-8, or that a tokenizer doesn't give back byte for byte have no tokens:
    zeros, and an empty digest. Every row counts as a document, equal ones too; null ids stay. An empty table gives an
    empty one. The HOT most frequent pairs' counts are broadcast; those of all others are joined, and no such pair
    is in more than one HOT-th of all links.
    """
    spark = docs.sparkSession
    width = len(Tokenizers(byte_file, piece_file).piece_tokens)
    aligned = materialise(groups(docs, byte_file, piece_file), "aligned")
    counts = materialise(pair_counts(aligned, width), "pairs")
    hot = counts.orderBy(F.desc("n"), "pair").limit(HOT).toArrow()
    order = np.argsort(hot["pair"].to_numpy())
    known = spark.sparkContext.broadcast(tuple(hot[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def places(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = known.value[0]
        at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        return at, keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = _flat(batch.column(1)), _flat(batch.column(2))
            at, has = places(pairs)
            n, best = (np.where(has, known.value[k][at], 0).astype(np.int64) if len(known.value[0]) else np.zeros(len(pairs), np.int64) for k in (1, 2))
            upto = batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
            total = lambda x: pa.array(np.diff(np.concatenate(([0], np.cumsum(x)))[upto]))
            yield pa.RecordBatch.from_arrays([batch.column(0), total(times * best), total(times * n)], ["row", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = _flat(batch.column(1)), _flat(batch.column(2))
            rows = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
            left = ~places(pairs)[1]
            yield pa.RecordBatch.from_arrays([pa.array(x[left]) for x in (rows, pairs, times.astype(np.int64))], ["row", "pair", "times"])

    lists = aligned.select("row", "pairs", "times")
    part = lists.mapInArrow(add, "row long, n_best long, count_sum long")
    rest = lists.mapInArrow(others, "row long, pair long, times long").join(counts, "pair")
    rest = rest.select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = materialise(part.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "sums")
    known.destroy()
    discard(counts)
    return aligned.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
