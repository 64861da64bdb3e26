"""Benchmark decontamination: BM25 over the test items, searched by block-max WAND with every passage of every text.

The inverted index is of the test items, in parts of PART items of like length; frequencies and the mean length that BM25 weighs
terms by are of all items, so that no score depends on the parts. Passages are windows of two segments, each as long as the
items of a part may be, so that some window holds any copied item whole. For all windows of a batch numpy sums the terms'
block maxima; windows that no block lets reach the threshold end there. The others run block-max WAND, which returns every
item above the threshold, and the items found are verified on the words: shingles of the whole, and words of question and
answer alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm import hashing
from claimspark.llm.common import discard, materialise

K1, B = 1.2, 0.75
#: Scores count in parts of the score that the item itself would get.
LEAST_SCORE = 0.6
SHINGLE, LEAST_SHARE = 5, 0.8
#: Items of one index part and blocks in it; parts that are broadcast at once, for one reading of all texts.
PART, BLOCKS, AT_ONCE = 4096, 32, 8
#: Words of a segment: the least, and from one length of items to the next.
SEGMENT, LONGER = 64, 4


class Item(NamedTuple):
    item_id: int | None
    shingles: frozenset[int]
    width: int
    question: frozenset[int]
    answer: frozenset[int]


class Index(NamedTuple):
    items: list[Item]
    terms: np.ndarray  # hashes, sorted
    places: list[np.ndarray]  # of each term: items, ascending
    gains: list[np.ndarray]  # and what it adds to the score of each
    most: np.ndarray  # its largest gain
    block: np.ndarray  # terms x BLOCKS: its largest gain in each block of items
    size: int  # items of a block
    segment: int  # words


def tokens(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return hashing.words(data, np.array([0, len(data)])).hash


def grams(words: np.ndarray, width: int) -> set[int]:
    value = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        value = hashing.mix(value * hashing.BASE + words[j : len(words) - width + 1 + j])
    return set(value.tolist())


def parts(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the shortest run of last sentences, or else of words, that has a quarter of the words."""
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    ends = [m.end() for m in re.finditer(r"[.?!][\x20\x09-\x0D]+(?=[^\x20\x09-\x0D])", text)]
    for end in reversed(ends):
        if len(text[:end].split()) <= cut:
            return text[:end], text[end:]
    return " ".join(words[:cut]), " ".join(words[cut:])


class Weights(NamedTuple):
    """What BM25 needs of all items: their number, their mean length, and of a part's terms how many items hold each."""

    n: int
    mean: float
    often: dict[int, int]


def weigh(texts: list[np.ndarray]) -> Weights:
    """The weights of items whose words are given."""
    term, often = np.unique(np.concatenate([np.unique(w) for w in texts]), return_counts=True)
    return Weights(len(texts), sum(map(len, texts)) / len(texts), dict(zip(term.tolist(), often.tolist(), strict=True)))


def segment_of(words: int) -> int:
    """The segment's length for items of so many words."""
    out = SEGMENT
    while out < words:
        out *= LONGER
    return out


def build(rows: list[tuple[int | None, str]], weights: Weights | None = None) -> Index | None:
    """The index of items (item_id, text); items without words are left out. Without ``weights`` these items are all there are."""
    texts = [(i, text, tokens(text or "")) for i, text in rows]
    texts = [x for x in texts if len(x[2])]
    if not texts:
        return None
    weights = weights or weigh([w for *_, w in texts])
    items, n = [], len(texts)
    for i, text, words in texts:
        width = min(SHINGLE, len(words))
        question, answer = (frozenset(tokens(p).tolist()) for p in parts(text))
        items.append(Item(i, frozenset(grams(words, width)), width, question, answer))
    posts: dict[int, list[tuple[int, int]]] = {}
    for k, (*_, words) in enumerate(texts):
        for term, tf in zip(*np.unique(words, return_counts=True), strict=True):
            posts.setdefault(int(term), []).append((k, int(tf)))
    terms = np.array(sorted(posts), np.uint64)
    size = -(-n // BLOCKS)
    places, gains, own = [], [], np.zeros(n)
    for term in terms.tolist():
        at, tf = (np.array(x) for x in zip(*posts[term], strict=True))
        often = weights.often[term]
        idf = np.log(1 + (weights.n - often + 0.5) / (often + 0.5))
        long = np.array([len(texts[k][2]) for k in at])
        gain = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * long / weights.mean))
        own[at] += gain
        places.append(at)
        gains.append(gain)
    gains = [g / own[at] for at, g in zip(places, gains, strict=True)]
    block = np.zeros((len(terms), BLOCKS), np.float32)
    for t, (at, gain) in enumerate(zip(places, gains, strict=True)):
        np.maximum.at(block[t], at // size, gain)
    return Index(items, terms, places, gains, np.array([g.max() for g in gains]), block, size, segment_of(max(len(w) for *_, w in texts)))


def wand(index: Index, query: list[int], least: float = LEAST_SCORE) -> list[tuple[int, float]]:
    """(item, score) of every item that the distinct terms ``query`` give ``least`` or more."""
    lists = [[0, t] for t in query]
    found = []
    at = lambda x: int(index.places[x[1]][x[0]])

    def seek(x: list[int], item: int) -> None:
        x[0] += int(np.searchsorted(index.places[x[1]][x[0] :], item))

    while True:
        lists = sorted((x for x in lists if x[0] < len(index.places[x[1]])), key=at)
        bound, pivot = 0.0, -1
        for k, x in enumerate(lists):
            bound += index.most[x[1]]
            if bound >= least - 1e-9:
                pivot = k
                break
        if pivot < 0:
            return found
        item = at(lists[pivot])
        while pivot + 1 < len(lists) and at(lists[pivot + 1]) == item:
            pivot += 1
        if sum(float(index.block[x[1], item // index.size]) for x in lists[: pivot + 1]) < least - 1e-6:
            # No item before the block's end, or before the next list's item, can get there.
            after = (item // index.size + 1) * index.size
            if pivot + 1 < len(lists):
                after = min(after, at(lists[pivot + 1]))
            for x in lists[: pivot + 1]:
                seek(x, max(after, item + 1))
        elif at(lists[0]) == item:
            score = sum(float(index.gains[x[1]][x[0]]) for x in lists[: pivot + 1])
            if score >= least - 1e-9:
                found.append((item, score))
            for x in lists[: pivot + 1]:
                x[0] += 1
        else:
            for x in lists[:pivot]:
                if at(x) < item:
                    seek(x, item)


def search(indexes: list[Index], data: np.ndarray, at: np.ndarray) -> list[tuple[int, Item, float, float]]:
    """(document, item, score, share of its shingles) of the verified items of documents in ``data`` at ``at``."""
    w = hashing.words(data, at)
    return sorted((x for index in indexes for x in _searched(index, w)), key=lambda x: (x[0], x[1].item_id is None, x[1].item_id or 0))


def _searched(index: Index, w: hashing.Words) -> list[tuple[int, Item, float, float]]:
    count = np.diff(w.first)
    segments = np.maximum(1, -(-count // index.segment))
    base = np.concatenate(([0], np.cumsum(segments)))
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(doc)) - w.first[doc]
    where = base[doc] + place // index.segment
    term = np.minimum(np.searchsorted(index.terms, w.hash), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[term] == w.hash)
    if not len(known):
        return []
    bound = np.zeros((int(base[-1]) + 1, BLOCKS), np.float32)
    # A term counts once in a segment, as it does in a query.
    segment, once = np.divmod(np.unique(where[known] * len(index.terms) + term[known]), len(index.terms))
    begins = np.flatnonzero(np.diff(segment, prepend=-1))
    bound[segment[begins]] = np.add.reduceat(index.block[once], begins)
    last = base[1:] - 1
    window = bound[:-1] + bound[1:]
    window[last] = bound[last]
    best: dict[tuple[int, int], tuple[float, float]] = {}
    owner = np.repeat(np.arange(len(count)), segments)
    for s in np.flatnonzero(window.max(1) >= LEAST_SCORE - 1e-4):
        d = int(owner[s])
        low = int(w.first[d] + (s - base[d]) * index.segment)
        high = min(low + 2 * index.segment, int(w.first[d + 1]))
        query = np.unique(term[low:high][index.terms[term[low:high]] == w.hash[low:high]])
        if index.block[query].sum(0).max() < LEAST_SCORE - 1e-4:
            continue
        for item, score in wand(index, query.tolist()):
            it = index.items[item]
            words = set(w.hash[low:high].tolist())
            share = len(it.shingles & grams(w.hash[low:high], it.width)) / len(it.shingles)
            whole = all(len(part & words) >= LEAST_SHARE * len(part) for part in (it.question, it.answer))
            if share >= LEAST_SHARE and whole and share > best.get((d, item), (0.0, 0.0))[1]:
                best[d, item] = (score, share)
    return [(d, index.items[item], *x) for (d, item), x in best.items()]


def _indexes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """Index parts, AT_ONCE of them at a time; items go by their length and a hash of their text to parts of about PART."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                term, _ = np.unique(tokens(text.as_py() or ""), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64))], ["term"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array([len(tokens(x.as_py() or "")) for x in batch.column(1)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words), pa.array([segment_of(n) for n in words.tolist()], pa.int64())], ["item_id", "text", "words", "segment"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(measure, "item_id long, text string, words long, segment long").where("words > 0")
    items = materialise(items, "items")
    # One row for each length of segments.
    sizes = items.groupBy("segment").agg(F.count("*").alias("n"), F.sum("words").alias("words")).orderBy("segment").collect()
    n, words = sum(r["n"] for r in sizes), sum(r["words"] for r in sizes)
    often = materialise(items.select("text").mapInArrow(count, "term long").groupBy("term").agg(F.count("*").alias("n")), "terms")
    held: list[Index] = []
    for size in sizes:
        parts = -(-size["n"] // PART)
        for k in range(parts):
            rows = items.where((F.col("segment") == size["segment"]) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)).select("item_id", "text")
            terms = often.join(rows.select("text").mapInArrow(count, "term long").distinct(), "term").collect()
            found = sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            index = build(found, Weights(n, words / n, {int(np.uint64(r["term"] & (2**64 - 1))): r["n"] for r in terms}))
            held += [index] if index else []
            if len(held) == AT_ONCE:
                yield held
                held = []
    if held:
        yield held
    discard(items, often)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, share) of the test items that rows of ``docs`` (doc_id, text) hold.

    score is the best window's BM25 score against the item's own, share the part of its shingles found there. Null
    and empty texts and items hold nothing; null ids stay null; a repeated row appears again. Further columns are ignored.
    Without items, or without rows, the result is empty.
    """
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("item_id long, score double, share double").fields])
    out = docs.sparkSession.createDataFrame([], schema)
    for indexes in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, end, data, at in hashing.slices(batch.column(1)):
                    found = search(shared.value, data, at)
                    if found:
                        doc, item, score, share = zip(*found, strict=True)
                        ids = batch.column(0).slice(row, end - row).take(pa.array(doc))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([i.item_id for i in item], pa.int64()), pa.array(score), pa.array(share)], schema.names)

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(find, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns.

    Null and empty texts hold none; rows count one by one, repeated ones too, and ids and further columns don't matter. Without
    items all rows stay; an empty table gives an empty one.
    """
    place = docs.columns.index("text")
    for indexes in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for row, _, data, at in hashing.slices(batch.column(place)):
                    good[[row + d for d, *_ in search(shared.value, data, at)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
