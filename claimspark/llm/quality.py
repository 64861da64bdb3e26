"""Quality classifier: a byte-level convolutional network in numpy.

Filters over runs of WIDTH bytes are applied at every place of the whole text; overlapping chunks of CHUNK bytes each
keep every filter's largest value; the chunks' values are averaged and their largest taken; a logistic layer turns
both into one probability. Nothing but the text's bytes enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm import hashing
from claimspark.llm.common import free_name

FILTERS, WIDTH = 16, 5
#: A chunk is PARTS blocks of BLOCK bytes; the next begins STEP blocks later.
BLOCK, PARTS, STEP = 64, 8, 4
CHUNK = BLOCK * PARTS
#: The fit uses about so many labelled rows (by a hash of the id), whole, of those whose texts have at most so many bytes. The
#: bounds keep the fit's memory the same at any size of the corpus; scores are of all texts, whole.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 1 << 15
STEPS, BATCH, RATE = 300, 64, 0.01
THRESHOLD = 0.7
#: Blocks filtered at once: what that takes fits into a cache, however long a text is.
PIECE = 256


class Net(NamedTuple):
    table: np.ndarray  # WIDTH x 256 x FILTERS: what each byte at each place of a run adds to each filter
    bias: np.ndarray
    weight: np.ndarray  # of the filters' means, then of their largest values
    shift: np.ndarray


def held_out(doc_id: str) -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _paired(table: np.ndarray) -> list[np.ndarray]:
    """The table for two bytes at once, as far as WIDTH allows: half as many look-ups."""
    two = [(table[j][:, None] + table[j + 1][None]).reshape(-1, FILTERS) for j in range(0, WIDTH - 1, 2)]
    return [*two, table[-1]] if WIDTH % 2 else two


def _filtered(data: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Each filter at each place but the last WIDTH - 1."""
    n = len(data) - WIDTH + 1
    at = data.astype(np.intp)
    pair = at[:-1] * 256 + at[1:]
    out, part = np.zeros((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
    for j, table in enumerate(tables):
        index = pair if len(table) > 256 else at
        out += np.take(table, index[2 * j : 2 * j + n], 0, out=part, mode="clip")
    return out


def _largest(value: np.ndarray) -> np.ndarray:
    """The maximum of each block, by halves."""
    for _ in range(BLOCK.bit_length() - 1):
        value = np.maximum(value[0::2], value[1::2])
    return value


def score_slice(data: np.ndarray, at: np.ndarray, net: Net, tables: list[np.ndarray]) -> np.ndarray:
    """The probability of each document that lies in ``data`` at the offsets ``at``."""
    size = np.diff(at)
    blocks = (size + WIDTH) // BLOCK + 1  # each document is followed by WIDTH zeros at least
    ends = np.cumsum(blocks)
    starts = ends - blocks
    padded = np.zeros(int(ends[-1]) * BLOCK + WIDTH - 1, np.uint8)
    padded[np.arange(len(data)) + np.repeat(starts * BLOCK - at[:-1], size)] = data
    value = np.empty((int(ends[-1]), FILTERS), np.float32)
    for k in range(0, len(value), PIECE):
        piece = _filtered(padded[k * BLOCK : (k + PIECE) * BLOCK + WIDTH - 1], tables)
        # Runs that begin in a document's last zeros would reach into the next one.
        last = ends[np.searchsorted(ends, k, "right") : np.searchsorted(ends, k + PIECE, "right")] - k
        piece[(last[:, None] * BLOCK - np.arange(1, WIDTH)).ravel()] = -np.inf
        value[k : k + PIECE] = _largest(piece)
    value = np.maximum(value + net.bias, 0)
    chunks = np.maximum(1, -(-(blocks - PARTS) // STEP) + 1)
    doc = np.repeat(np.arange(len(size)), chunks)
    first = np.concatenate(([0], np.cumsum(chunks)[:-1]))
    begin = starts[doc] + (np.arange(len(doc)) - first[doc]) * STEP
    edges = np.stack([begin, np.minimum(begin + PARTS, ends[doc])], 1).ravel()
    pooled = np.maximum.reduceat(np.concatenate([value, np.zeros((1, FILTERS), np.float32)]), edges)[::2]
    both = np.concatenate([np.add.reduceat(pooled, first) / chunks[:, None], np.maximum.reduceat(pooled, first)], 1)
    return 1 / (1 + np.exp(-np.clip(both @ net.weight + net.shift, -30, 30)))


def score_texts(texts: list[str | None], net: Net) -> np.ndarray:
    """The same for a list of texts; null is empty."""
    column, tables = pa.array(texts, pa.string()), _paired(net.table)
    return np.concatenate([score_slice(data, at, net, tables) for *_, data, at in hashing.slices(column)] or [np.zeros(0)])


def fit(chunks: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Net:
    """The network of least logistic loss (Adam) for documents given as arrays of chunks (n x CHUNK bytes)."""
    rng = np.random.default_rng(seed)
    net = Net(*(x.astype(np.float32) for x in (rng.normal(0, 0.1, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1))))
    if not len(labels):
        return net._replace(weight=np.zeros(2 * FILTERS, np.float32))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net]
    n = CHUNK - WIDTH + 1
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(labels), BATCH)
        parts = [chunks[i] for i in pick]
        count = np.array([len(p) for p in parts])
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        data, doc = np.concatenate(parts), np.repeat(np.arange(BATCH), count)
        wide = data.astype(np.intp)
        value = sum(np.take(net.table[j], wide[:, j : n + j], 0, mode="clip") for j in range(WIDTH))
        where = value.argmax(1)  # chunk x filter
        top = np.take_along_axis(value, where[:, None], 1)[:, 0] + net.bias
        pooled = np.maximum(top, 0)
        both = np.concatenate([np.add.reduceat(pooled, first) / count[:, None], np.maximum.reduceat(pooled, first)], 1)
        p = 1 / (1 + np.exp(-np.clip(both @ net.weight + net.shift, -30, 30)))
        error = ((p - labels[pick]) / BATCH).astype(np.float32)
        into = error[:, None] * net.weight
        best = (pooled == both[doc, FILTERS:]) & (pooled > 0)
        grad_top = (into[doc, :FILTERS] / count[doc][:, None] + into[doc, FILTERS:] * best) * (top > 0)
        grad = np.zeros_like(net.table)
        rows, filters = np.arange(len(data))[:, None], np.arange(FILTERS)[None, :]
        for j in range(WIDTH):
            np.add.at(grad[j], (data[rows, where + j], np.broadcast_to(filters, where.shape)), grad_top)
        grads = (grad + 1e-5 * net.table, grad_top.sum(0), both.T @ error + 1e-4 * net.weight, error.sum(keepdims=True))
        for param, g, (m, v) in zip(net, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def cut(text: bytes) -> np.ndarray:
    """All chunks of a text (n x CHUNK); the last is filled up with zeros."""
    data = np.frombuffer(text, np.uint8)
    n = max(1, -(-(len(data) + WIDTH - CHUNK) // (STEP * BLOCK)) + 1)
    out = np.zeros((n, CHUNK), np.uint8)
    for k in range(n):
        part = data[k * STEP * BLOCK :][:CHUNK]
        out[k, : len(part)] = part
    return out


def train(docs: DataFrame, labels: DataFrame) -> Net | None:
    """Fit on a bounded sample of the labelled rows that are not held out; None if there are none.

    An id with both labels is left out; of an id's several texts the least counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("_most"))
    known = known.where("quality = _most").drop("_most")
    rows = max(1, known.count())
    share = min(1.0, SAMPLE_ROWS / rows)
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    # What is broadcast has about SAMPLE_ROWS rows.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(known), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = sorted((r["doc_id"], r["quality"], r["text"]) for r in sample.collect())
    if not found:
        return None
    return fit([cut(text.encode()) for *_, text in found], np.array([q for _, q, _ in found], np.float32))


def scored(docs: DataFrame, net: Net | None, column: str = "score") -> DataFrame:
    """``docs`` with the double ``column``: the probability of each text, empty and null ones too; 0.5 without a network."""
    if net is None:
        return docs.withColumn(column, F.lit(0.5))
    model = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    place = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _paired(model.value.table)
        for batch in batches:
            for row, end, data, at in hashing.slices(batch.column(place)):
                yield pa.RecordBatch.from_arrays([*batch.slice(row, end - row).columns, pa.array(score_slice(data, at, model.value, tables).astype(float))], schema.names)

    return docs.mapInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text; further columns are ignored).

    ``labels`` (doc_id, quality): rows of null id or of a quality other than 0 and 1 are left out, and ids with both; without any
    labelled row every score is 0.5. Null and empty texts are scored as empty. An empty table gives an empty one.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that the classifier doesn't reject, with their columns.

    Without any usable label nothing can be rejected, so all rows stay. Null and empty texts are scored as empty; rows count one by
    one, repeated ones too, and null ids don't matter. An empty table gives an empty one.
    """
    net = train(docs, labels)
    if net is None:
        return docs
    score = free_name(docs, "score")
    return scored(docs, net, score).where(F.col(score) >= THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))
