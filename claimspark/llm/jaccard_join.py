"""Exact Jaccard similarity join of documents on word shingles, as a metric-space join.

Jaccard distance is a metric, and so is the size of the symmetric difference. Two documents x, y link when their
Jaccard similarity is at least t, that is when |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|).

1. Regions. The pivots of the first level are runs of RUN shingles, {s, s'}, that follow each other when a set is put in
   one order of all shingles, the rarest first (by a count sketch over all documents; any one order gives the same
   result, this one the smallest regions). Single shingles don't do: with more documents more of the rare ones are shared
   by chance, until such shares chain nearly all documents together. x falls into the regions of its first runs, up to
   the window within which it meets one of each linked document: see :func:`window`.
2. Within a region documents are the pivots, of classes and of Voronoi cells, recursively: see :mod:`claimspark.llm.links`.
3. Each pair left is decided on the whole shingle sets. Pairs of unlike class meet in the region of their first common
   run, so nothing is lost; pairs inside a class add nothing to it.

Document pivots alone can't divide such tables: nearly every distance is 1, so that each window would hold everything.
Exact copies are one node from the beginning. Hashes of 64 bits stand for the shingles, 128 bits for a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm import hashing
from claimspark.llm.common import bit_map, discard, free_name, materialise, sketch
from claimspark.llm.links import MARKS, SHARE, all_shingles, classes, labelled, marked, nodes, prefix_sizes

#: Counters of the shingle sketch, a power of two, 4 bytes each: what tells common shingles from rare ones. Their number
#: is the same at any size of the table, so what is broadcast is 16 MB and what tasks send follows their number alone.
COUNTERS = 22
#: Runs handled at once, and bits of the largest map of shared ones, a power of two: 8 MB.
RUNS, MOST_MARKS = 1 << 20, 26


def run_length(percent: int) -> int:
    """RUN, how many shingles a pivot of the first level has: 2 from a threshold of 75 on, else 1."""
    return 2 if percent >= 75 else 1


def window(n: np.ndarray, percent: int) -> np.ndarray:
    """Up to which place a set of ``n`` has a run in common with each linked one.

    Let x have a shingles that y hasn't, and y b that x hasn't. In the order of both these cut the common ones into a + b + 1
    runs at most, so of the first (RUN - 1) * (a + b + 1) + 1 common ones RUN follow each other, in both sets, and in x they
    end at place (RUN - 1) * (a + b + 1) + 1 + a at most. As common >= t * union means a + t * b <= (1 - t) * n, that is at most
    RUN * (1 - t) * n + RUN. From t = 0.75 on there are as many common ones: 3 * (a + b), for unlike sets 3 at least.
    """
    run = run_length(percent)
    return np.minimum(n, run * (100 - percent) * n // 100 + run)


def _slot(value: np.ndarray, bits: int) -> np.ndarray:
    return (value >> np.uint64(64 - bits)).astype(np.int64)


def _counts(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    def slots(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (_slot(v, bits) for *_, v in all_shingles(batch.column(0), k))

    return sketch(docs.select("text"), slots, 1 << bits)


def _profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, node, prefix, pri) of each document: set size, set hash, rarest shingles, centrality."""
    counts = docs.sparkSession.sparkContext.broadcast(_counts(docs, k, COUNTERS))
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n long, node binary, prefix array<long>, pri long").fields])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for row, end, doc, value in all_shingles(batch.column(1), k):
                n = np.bincount(doc, minlength=end - row)
                seen = often[_slot(value, COUNTERS)]
                order = np.lexsort((value, seen, doc))
                lead = np.concatenate(([0], np.cumsum(n)[:-1]))
                place = np.arange(len(value)) - np.repeat(lead, n)
                most = np.maximum(prefix_sizes(n, percent), window(n, percent))
                kept = value[order][place < np.repeat(most, n)].astype(np.int64)
                centre = np.zeros(end - row)
                np.add.at(centre, doc, np.log2(seen + 1.0))
                node = nodes(value, doc, end - row)
                tie = np.array([int.from_bytes(x[:5], "little") for x in node], np.int64)
                pri = (np.minimum(centre / np.maximum(n, 1) * 2**17, 2**22 - 1).astype(np.int64) << 40) | tie
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(n.astype(np.int64)), pa.array(node, pa.binary()), hashing.lists(pa.array(kept), most), pa.array(pri)], schema.names)

    out = materialise(docs.select("doc_id", "text").mapInArrow(profile, schema), "profiles")
    counts.destroy()
    return out


def _runs(node: DataFrame, percent: int, names: bool = True, keep=None, bits: int = 0) -> DataFrame:  # noqa: ANN001
    """(node, pos, s): the regions s of each node, by its first runs; pos is 0 where common shingles may come before.

    Without ``names`` (s) alone. With ``keep``, a map of 2**bits, only what is marked there.
    """
    run = run_length(percent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = batch.column(2).offsets.to_numpy()
            value, begin = batch.column(2).flatten().to_numpy().view(np.uint64), begin - begin[0]
            count = np.maximum(np.minimum(np.diff(begin), window(batch.column(1).to_numpy(), percent)) - run + 1, 0)
            total, row = np.concatenate(([0], np.cumsum(count))), 0
            while row < len(count):
                end = max(row + 1, int(np.searchsorted(total, total[row] + RUNS, "right")) - 1)
                doc = np.repeat(np.arange(row, end), count[row:end])
                pos = np.arange(total[row], total[end]) - total[doc]
                s = value[begin[doc] + pos]
                if run > 1:
                    s, pos = hashing.mix(hashing.mix(s) * hashing.BASE + value[begin[doc] + pos + 1]), np.zeros_like(pos)
                if keep is not None:
                    hit = marked(keep.value, _slot(s, bits))
                    doc, pos, s = doc[hit], pos[hit], s[hit]
                columns = [pa.array(s.view(np.int64))]
                if names:
                    columns = [batch.column(0).take(pa.array(doc)), pa.array(pos.astype(np.int32)), *columns]
                yield pa.RecordBatch.from_arrays(columns, ["node", "pos", "s"] if names else ["s"])
                row = end

    return node.select("node", "n", "prefix").mapInArrow(emit, "node binary, pos int, s long" if names else "s long")


def _shared(node: DataFrame, percent: int) -> DataFrame:
    """(s, node, pos, n, pri) of the regions that two nodes or more are in.

    Most runs are one document's alone. So numbers alone are counted, and a map of those that aren't alone spares the rest
    the transport to the exact join.
    """
    s = materialise(_runs(node, percent, names=False).groupBy("s").agg(F.count("*").alias("members")).where("members > 1").select("s"), "runs")
    bits = min(max(MARKS, (16 * s.count()).bit_length()), MOST_MARKS)
    keep = node.sparkSession.sparkContext.broadcast(bit_map(s.select(F.shiftrightunsigned("s", 64 - bits).alias("slot")), bits))
    member = materialise(_runs(node, percent, keep=keep, bits=bits).join(s, "s").join(node.select("node", "n", "pri"), "node"), "shared")
    keep.destroy()
    discard(s)
    return member


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text; further columns are ignored).

    n_shingles counts the distinct ``k``-word shingles; component_id is the least doc_id that links of
    ``100 * common >= percent * union`` reach. Texts that are null or without words have no shingles, link with nothing
    and keep their own doc_id. Rows of equal sets are linked; a repeated row appears again. A null doc_id takes the
    least id of its component, or null if there is none. An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    profile = _profiles(docs, k, percent)
    node = profile.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("pri").alias("pri"), F.first("prefix").alias("prefix"))
    node = materialise(node, "nodes")
    slim = materialise(profile.select("doc_id", "n", "node"), "profiles")
    discard(profile)
    member = _shared(node, percent)
    # A linked partner has at least percent / 100 of the set: SHARE of the rest + SHARE rarest are common.
    node = node.withColumn("prefix", F.slice("prefix", 1, F.expr(f"int(n - (n * {percent} + 99) div 100 + {SHARE})")))
    return labelled(slim, node, classes(docs, k, percent, node, member))


def _whole_row(docs: DataFrame) -> Column:
    """A key of each row that orders them: by doc_id, nulls last, then by digests of text and of the other columns.

    It is never null; rows share it only if all their columns are equal.
    """
    others = F.to_json(F.struct(*(F.col(c) for c in docs.columns if c != "text")))
    # The digest of a null text is left out, so that it differs from that of an empty one.
    digest = F.unhex(F.concat_ws("", F.md5("text"), F.md5(others)))
    return F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id").alias("id"), digest.alias("digest"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, all_without_id: bool = True) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, null last, of equals the least digest of the row.

    Rows count, not ids: repeated ids are told apart by their texts. Rows of null doc_id all stay, or with
    ``all_without_id`` false count as any others. Texts without words link with nothing, so all of them stay but for rows
    that are equal in every column. All columns stay.
    """
    key = free_name(docs, "_row")
    rows = docs.withColumn(key, _whole_row(docs))
    keep = jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), k, percent).where("doc_id = component_id").select(F.col("doc_id").alias(key))
    if all_without_id:
        rows, keep = rows.where("doc_id is not null"), keep.where(f"not {key}.no_id")
    # Equal rows are combined before the shuffle, so that a much repeated one isn't one task.
    kept = rows.dropDuplicates([key]).join(keep, key, "left_semi").select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null")) if all_without_id else kept
