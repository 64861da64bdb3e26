"""Near duplicates by circulant MinHash: two permutations give all coordinates of a signature.

The first permutation, of the 64-bit numbers, takes the structure out of the shingles' hashes; the second one is shifted
circularly, once for each coordinate: coordinate k of a set is the least second(first(x) + k mod 2**64) of its shingles x.
Bands of the signature are buckets; documents that link share one with a probability of 1 - (1 - s**ROWS)**BANDS, which at
similarity s = 0.85 misses 6 of 10**11. Buckets are joined exactly, on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm import hashing
from claimspark.llm.common import materialise
from claimspark.llm.links import all_shingles, classes, labelled, nodes, prefix_sizes

BANDS, ROWS = 32, 4
#: Odd factors and a sum make each permutation one of its own.
FIRST, SECOND = (0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def permuted(x: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """A permutation of the 64-bit numbers: products with odd numbers, sums and shifted sums can all be undone."""
    x = (x + np.uint64(key[1])) * np.uint64(key[0])
    x ^= x >> np.uint64(32)
    x *= np.uint64(key[1] | 1)
    x ^= x >> np.uint64(29)
    return x


def signatures(value: np.ndarray, count: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (sets x coordinates) of consecutive sets of ``count`` hashes each; those of empty sets are 0."""
    out = np.zeros((len(count), coordinates), np.uint64)
    some = count > 0
    if not some.any():
        return out
    start = (np.cumsum(count) - count)[some]
    first = permuted(value, FIRST)
    for k in range(coordinates):
        out[some, k] = np.minimum.reduceat(permuted(first + np.uint64(k), SECOND), start)
    return out


def buckets(signature: np.ndarray) -> np.ndarray:
    """A number for each set and band; unlike bands have unlike numbers."""
    total = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for j in range(ROWS):
        total = hashing.mix(total * hashing.BASE + signature[:, j::ROWS])
    return total


def _profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, node, prefix, bands) of each document; the shingles of least hash stand before all others."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n long, node binary, prefix array<long>, bands array<long>").fields])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, doc, value in all_shingles(batch.column(1), k):
                n = np.bincount(doc, minlength=end - row)
                place = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
                most = prefix_sizes(n, percent)
                prefix = value[place < np.repeat(most, n)].view(np.int64)
                bands = buckets(signatures(value, n))[n > 0].ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, end - row), pa.array(n.astype(np.int64)), pa.array(nodes(value, doc, end - row), pa.binary()),
                    hashing.lists(pa.array(prefix), most), hashing.lists(pa.array(bands), np.where(n > 0, BANDS, 0)),
                ], schema.names)

    return materialise(docs.select("doc_id", "text").mapInArrow(profile, schema), "profiles")


def minhash_components(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text; further columns are ignored).

    n_shingles counts the distinct ``k``-word shingles of the whole text; component_id is the least doc_id that links of
    ``100 * common >= percent * union`` reach, and kept is whether that is the row's own. Texts that are null or without
    words have no shingles, link with nothing and keep their own doc_id. Rows of equal sets are linked; a repeated row
    appears again. A null doc_id takes the least id of its component, or null if there is none: only then it is kept. An
    empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    profile = _profiles(docs, k, percent)
    # Exact copies are one node from here on.
    node = profile.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bands").alias("bands"))
    node = materialise(node, "nodes")
    member = node.select("node", F.explode("bands").alias("s"))
    shared = member.groupBy("s").agg(F.count("*").alias("members")).where("members > 1").select("s")
    member = member.join(shared, "s").join(node.select("node", "n", F.xxhash64("node").alias("pri")), "node").withColumn("pos", F.lit(0))
    out = labelled(profile, node, classes(docs, k, percent, node, materialise(member, "shared")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.isnull("component_id")))
