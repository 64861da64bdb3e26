"""Product quantisation of integer vectors with per-dimension value dictionaries.

Vectors are cut into equal parts, and a codebook of each part's position is improved in rounds. In a batch every dimension has
few distinct integers; their squared differences to all entries are tabulated once, so that the distance of a part
to an entry is a gather from those tables by dictionary codes and a sum over the part's dimensions. Everything is integers:
the result is the same for any order and any partitions of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import discard, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers beyond it would let a squared distance leave 64 bits.
LARGEST = 1 << 27
#: Rows whose dictionaries and distances are held at once.
BLOCK = 4096
#: Rows of one label meet its sum in so many groups.
SALTS = 32

#: Codebooks: PARTS x entries x positions within a part.
Books = np.ndarray


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that count: floor(scale * component) of each.

    Vectors that are null or hold null or non-finite components don't count; nor do those of another width than the
    first that counts (least vec_id, nulls last, then the wider) or of a width that the parts don't divide.
    """
    x = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    fit = F.expr(f"x is not null and size(x) > 0 and size(x) % {PARTS} = 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    x = x.where(fit)
    first = x.select(F.isnull("vec_id").alias("late"), "vec_id", F.size("x").alias("n")).orderBy("late", "vec_id", F.desc("n")).limit(1).collect()
    width = first[0].n if first else 0
    fits = F.when(F.exists("x", lambda c: F.abs(c * scale) >= LARGEST), F.raise_error(f"op13: {scale} times a component is {LARGEST} or more"))
    return x.where(F.size("x") == width).select("vec_id", "label", F.coalesce(fits.cast("array<long>"), F.transform("x", lambda c: F.floor(c * scale))).alias("v"))


def _dictionary(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, code of each) of a column of integers: by presence where their range is small."""
    low = int(x.min())
    span = int(x.max()) - low + 1
    if span > 8 * len(x) + 1024:
        return np.unique(x, return_inverse=True)
    seen = np.zeros(span, bool)
    seen[x - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[x - low]


def assigned(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row and part: the nearest entry, ties to the lower index."""
    parts, _, inner = books.shape
    entry, error = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for p in range(parts):
        total = np.zeros((len(x), books.shape[1]), np.int64)
        for d in range(inner):
            values, code = _dictionary(x[:, p * inner + d])
            total += ((values[:, None] - books[p, :, d]) ** 2)[code]
        entry[:, p] = total.argmin(1)
        error[:, p] = total.min(1)
    return entry, error


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, len(batch), BLOCK):
            part = batch.slice(k, BLOCK)
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _first(vectors: DataFrame) -> Books | None:
    """The parts of the vectors of the least ids, nulls last, equal ids by their components."""
    found = vectors.select(F.isnull("vec_id").alias("late"), "vec_id", "v").orderBy("late", "vec_id", "v").limit(ENTRIES).collect()
    if not found:
        return None
    x = np.array([r.v for r in found], np.int64)
    return np.ascontiguousarray(x.reshape(len(x), PARTS, -1).transpose(1, 0, 2))


def _improved(vectors: DataFrame, books: Books) -> Books:
    """Each entry replaced by the floor of the mean of its parts; tasks add up theirs, a few numbers for each entry."""
    parts, entries, inner = books.shape

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, x in _blocks(batches, 0):
            entry, _ = assigned(x, books)
            for p in range(parts):
                np.add.at(total[p], entry[:, p], x[:, p * inner : (p + 1) * inner])
                count[p] += np.bincount(entry[:, p], minlength=entries)
        used = np.repeat(count.ravel() > 0, inner)
        columns = (np.flatnonzero(used), total.ravel()[used], np.repeat(count.ravel(), inner)[used])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["at", "total", "n"])

    out = books.copy()
    sums = vectors.select("v").mapInArrow(fold, "at long, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    for at, total, n in sums.collect():
        out.flat[at] = total // n
    return out


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(vectors: DataFrame) -> Books | None:
    """Codebooks of ``vectors`` (vec_id, v) after all rounds; None without rows. Only sums for each entry reach the driver."""
    books = _first(vectors)
    for _ in range(ROUNDS if books is not None else 0):
        books = _improved(vectors, books)
    return books


def encode(vectors: DataFrame, books: Books) -> DataFrame:
    """``vectors`` (vec_id, label, v) with code and error in place of v."""
    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], *T.StructType.fromDDL("code string, error long").fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 2):
            entry, error = assigned(x, books)
            codes = [row.tobytes().hex() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(error.sum(1))], schema.names)

    return vectors.select("vec_id", "label", "v").mapInArrow(task, schema)


def decode(codes: DataFrame, books: Books) -> DataFrame:
    """``codes`` with v, the vector that each code stands for."""
    parts, entries, inner = books.shape
    table = F.array(*(F.array(*(F.array(*map(F.lit, books[p, e].tolist())) for e in range(entries))) for p in range(parts)))
    entry = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.element_at(F.element_at(table, p + 1), F.conv(F.substring("code", 2 * p + 1, F.lit(2)), 16, 10).cast("int") + 1))
    return codes.withColumn("v", F.flatten(entry))


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row of ``vectors`` (vec_id, embedding, label) that counts.

    Which rows count: see :func:`integers`. A component of which SCALE times is LARGEST or more is an error. Repeated rows
    and ids each count and appear again; null ids and null labels are values like others (ids last). With fewer than
    ENTRIES rows each codebook has as many entries as there are rows. Further columns are ignored; an empty table gives
    an empty one.
    """
    rows = materialise(integers(vectors), "integers")
    books = train(rows)
    schema = T.StructType([vectors.schema["vec_id"], *T.StructType.fromDDL("code string, error long, label_error long, codebooks_sha256 string").fields])
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    coded = materialise(encode(rows, books).withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")), "codes")
    discard(rows)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
