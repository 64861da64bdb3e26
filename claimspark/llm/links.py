"""Classes of documents that Jaccard links connect, from regions in which every linked pair meets.

The callers divide the documents into regions so that two linked documents share one (by rare shingles, or by bands of
signatures). Here they are joined exactly, without a pair for every two members:

1. Regions that share members are one cluster. A cluster of bounded size is compared at once, each set being sent there
   once, however many regions it is in: a member is compared with all others by gathers from the cluster's own numbering
   of shingles, until all that is left is one class. One link for each two classes joined is what leaves.
2. Of larger clusters each region is joined for itself. The most central member is the pivot, and its distance to every
   member that the windows leave is found exactly. Members that link with it are one class, whose inner pairs nobody needs.
   Members of other classes (*outside*) are joined with the whole region, but only with those whose distance to the pivot
   differs from theirs by 1 - t at most (triangle inequality), whose size and place allow it, and that aren't in their
   class already.
3. Where outside times size is above PAIRS, the region is divided first: some outside members become pivots, everyone goes
   to the Voronoi cell of the nearest one and is replicated to each cell whose border is within the window 2 (1 - t)
   (and whose radius it is near enough to), and each cell is a region of its own, which is divided again. A cell that
   hasn't become much smaller than its region isn't divided any further: its members are about equally far from each
   other, and are joined as in 2.
4. Each pair left is decided on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm import hashing
from claimspark.llm.common import bit_map, discard, materialise
from claimspark.llm.graph import components

#: Bits of the map of wanted documents, a power of two: 2 MB.
MARKS = 24
#: Common shingles that the first of two documents must show before their whole sets are fetched.
SHARE = 4
#: Members of a cluster that is compared at once, in one task, and the shingles of their sets together.
CLUSTER, CLUSTER_SHINGLES = 8192, 1 << 22
#: Combinations of outside members and members above which a region is divided, pivots of a division, and what share of its
#: region's combinations a cell may have to be divided again.
PAIRS, PIVOTS, SHRUNK = 1 << 22, 32, 0.8


def all_shingles(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for row, end, data, at in hashing.slices(column):
        yield row, end, *hashing.shingle_sets(hashing.words(data, at), k)


def nodes(value: np.ndarray, doc: np.ndarray, n: int) -> list[bytes]:
    """128 bits for each of ``n`` sets."""
    out = np.zeros((n, 2), np.uint64)
    for j, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        total = np.zeros(n, np.uint64)
        np.add.at(total, doc, hashing.mix(value ^ np.uint64(salt)))
        out[:, j] = hashing.mix(total)
    return [x.tobytes() for x in out]


def _marks(keys: DataFrame) -> np.ndarray:
    """A bit map of bounded size of the only column of ``keys``."""
    return bit_map(keys.select(_mark(keys.columns[0]).alias("slot")), MARKS)


def _mark(column: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - MARKS)


def marked(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def _marked(rows: DataFrame, marks) -> DataFrame:  # noqa: ANN001
    """Rows whose first column is marked, and few others, so that the rest is spared the transport to an exact join."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:]).filter(pa.array(marked(marks.value, batch.column(0).to_numpy())))

    return rows.select(_mark(rows.columns[0]).alias("slot"), *rows.columns).mapInArrow(keep, rows.schema)


def _sets(docs: DataFrame, k: int, marks) -> DataFrame:  # noqa: ANN001
    """(node, shingles) of the documents whose ids are marked, and of few others."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).filter(pa.array(marked(marks.value, batch.column(0).to_numpy())))
            for row, end, doc, value in all_shingles(texts, k):
                n = np.bincount(doc, minlength=end - row)
                yield pa.RecordBatch.from_arrays([pa.array(nodes(value, doc, end - row), pa.binary()), hashing.lists(pa.array(value.astype(np.int64)), n)], ["node", "shingles"])

    return docs.select(_mark("doc_id").alias("slot"), "text").mapInArrow(emit, "node binary, shingles array<long>")


def _once(docs: DataFrame, k: int, wanted: DataFrame, marks) -> DataFrame:  # noqa: ANN001
    """(node, shingles) of the ``wanted`` nodes, of which ``marks`` has the documents."""
    return _sets(docs, k, marks).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _whole(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the ``wanted`` ones (node, rep)."""
    wanted = materialise(wanted, "wanted")
    texts = docs.sparkSession.sparkContext.broadcast(_marks(wanted.select("rep")))
    sets = materialise(_once(docs, k, wanted, texts), "sets")
    texts.destroy()
    discard(wanted)
    return sets


def spanning(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (a, b) between sets: as many as make the classes that all links make.

    A set that isn't in the largest class is compared with all; what remains in that class needs no comparison of its own.
    """
    size = np.array(list(map(len, sets)))
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    root, members = list(range(len(sets))), [1] * len(sets)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    held, out, largest = np.zeros(len(values), np.int32), [], 0
    # Whoever is passed over in the largest class may be outside of it later, when another one has become larger.
    todo = list(range(len(sets)))
    while todo:
        passed, done = [], False
        for a in todo:
            if done and find(a) == find(largest):
                passed.append(a)
                continue
            done = True
            own = code[first[a] : first[a] + size[a]]
            held[own] = 1
            common = np.add.reduceat(held[code], first)
            held[own] = 0
            for b in np.flatnonzero(100 * common >= percent * (size[a] + size - common)).tolist():
                if (x := find(a)) != (y := find(b)):
                    if members[x] < members[y]:
                        x, y = y, x
                    root[y] = x
                    members[x] += members[y]
                    out.append((a, b))
                    if members[x] > members[find(largest)]:
                        largest = x
        todo = passed if any(find(a) != find(largest) for a in passed) else []
    return out


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what ``edges`` connect: each a with the least of its bs, and these with it. A node has few."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"), F.collect_set("b").alias("hubs"))
    return low.select("a", F.col("low").alias("b")).unionByName(low.select(F.explode("hubs").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())


def _clustered(docs: DataFrame, k: int, percent: int, node: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, rest): links (a, b) that make the classes of each cluster of bounded size, and what of ``member`` is in larger ones."""
    hub = member.groupBy("s").agg(F.min("node").alias("hub"))
    near = components(_stars(member.join(hub, "s").select(F.col("node").alias("a"), F.col("hub").alias("b")))).withColumnRenamed("label", "cluster")
    inside = materialise(near.join(node.select("node", "n", "rep"), "node"), "clusters")
    size = inside.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    size = size.withColumn("small", F.expr(f"members <= {CLUSTER} and shingles <= {CLUSTER_SHINGLES}"))
    asked = materialise(inside.join(size.where("small").select("cluster"), "cluster", "left_semi"), "asked")
    rest = materialise(member.join(inside.join(size.where("not small").select("cluster"), "cluster", "left_semi").select("node"), "node", "left_semi"), "rest")
    texts = docs.sparkSession.sparkContext.broadcast(_marks(asked.select("rep")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        names, found = group["node"].tolist(), spanning(group["shingles"].tolist(), percent)
        return pd.DataFrame({"a": [names[a] for a, _ in found], "b": [names[b] for _, b in found]}, dtype=object)

    # Read once, so the sets aren't written first.
    sets = _once(docs, k, asked, texts)
    links = materialise(asked.select("cluster", "node").join(sets, "node").groupBy("cluster").applyInPandas(compare, "a binary, b binary"), "links")
    texts.destroy()
    discard(inside, asked)
    return links, rest


def _common(pairs: DataFrame, lists: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b, na, nb) with ``common``, the number of values that the two nodes' lists share.

    Values that the list of ``a`` repeats count as shared, so that shortened hashes never make the number too small.
    """
    a, b = (lists.select(F.col("node").alias(x), F.col(column).alias(f"list_{x}")) for x in "ab")
    twice = F.size("list_a") - F.size(F.array_distinct("list_a"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", (F.size(F.array_intersect("list_a", "list_b")) + twice).cast("long").alias("common"))


def _compare(docs: DataFrame, k: int, percent: int, pairs: DataFrame, node: DataFrame, every: bool = False) -> DataFrame:
    """Those of ``pairs`` that can link, or ``every`` one, with ``common``, the size of the intersection of their whole sets.

    If two sets have m values in common, the n - m + SHARE first in any one order (``prefix``) share SHARE; that spares most pairs the
    transport of whole sets.
    """
    spark = docs.sparkSession
    ends = lambda df: df.select(F.col("a").alias("node")).union(df.select("b")).distinct()
    marks = spark.sparkContext.broadcast(_marks(ends(pairs)))
    # The upper halves of the hashes do for that.
    brief = _marked(node.select("node", "rep", F.transform("prefix", lambda x: F.shiftright(x, 32).cast("int")).alias("brief")), marks)
    able = pairs
    if not every:
        able = _common(pairs, brief, "brief").where(F.col("common") >= F.least(F.lit(SHARE), F.expr(f"({percent} * greatest(na, nb) + 99) div 100")))
        able = materialise(able.drop("common"), "able")
    sets = _whole(docs, k, brief.select("node", "rep").join(ends(able), "node", "left_semi"))
    out = materialise(_common(able, sets, "shingles"), "compared")
    marks.destroy()
    discard(sets, *([] if every else [able]))
    return out


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of ``n``, in any one order of all, must have SHARE in common with those of a linked one."""
    return np.minimum(n, n - -(-n * percent // 100) + SHARE)


def classes(docs: DataFrame, k: int, percent: int, node: DataFrame, member: DataFrame) -> DataFrame:
    """(node, label) of the nodes that link with any other.

    ``node`` (node, rep, n, prefix) has each distinct set once, ``member`` (s, node, n, pri, pos) its regions s, as
    materialised by the caller, and deleted here once read; pos is how many of the node's shingles come before s, 0 if that
    is unknown, and pri orders the members of a region.
    """
    links, rest = _clustered(docs, k, percent, node, member)
    discard(member)
    if rest.isEmpty():
        label = components(links)
    else:
        more, kept = _region_links(docs, k, percent, node, rest)
        label = components(_stars(links.unionByName(more)))
        discard(*kept)
    discard(links)
    return label


def _region_links(docs: DataFrame, k: int, percent: int, node: DataFrame, member: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(links, tables that they are read from): links (a, b) that make the classes of the members of each region; ``member`` is deleted."""
    size = lambda m, n: (100 * F.least(m, n) >= percent * F.greatest(m, n))
    # The first common shingle at places i and j: at most least(m - i, n - j) are common, and i + j others are not.
    window = lambda m, n, i, j: F.expr(f"{100 + percent} * ({i} + {j}) <= {100 - percent} * ({m} + {n}) and {100 + percent} * least({m} - {i}, {n} - {j}) >= {percent} * ({m} + {n})")
    linked = F.expr(f"100 * common >= {percent} * (na + nb - common)")
    distance = 1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    reach = (100 - percent) / 100 + 1e-9

    top = member.groupBy("s").agg(F.max("pri").alias("top"))
    member, bare = materialise(member.join(top, "s"), "regions"), member
    discard(bare)
    pivot = member.where("pri = top").select("s", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    near = member.select("s", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    near = near.join(pivot, "s").where((F.col("a") != F.col("b")) & size("na", "nb") & window("na", "nb", "pa", "pb"))
    near = materialise(near.select("a", "b", "na", "nb").distinct(), "near")
    star = _compare(docs, k, percent, near, node)
    discard(near)
    links = star.where(linked).select("a", "b")
    label = components(_stars(links))

    # The pivot's region again, each member with its class and its distance to the pivot where it is known.
    far = star.select(F.col("a").alias("node"), F.col("b").alias("pivot"), distance.alias("d"))
    inside = member.join(label, "node", "left").select("s", "node", "n", "pos", (F.col("pri") == F.col("top")).alias("first"), F.coalesce("label", "node").alias("label"))
    mixed = inside.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("first"), F.col("label"))).alias("main"), F.min(F.when(F.col("first"), F.col("node"))).alias("pivot"))
    inside = inside.where("not first").join(mixed.where("low <> high").select("s", "main", "pivot"), "s").join(far, ["node", "pivot"], "left")
    inside = inside.select("s", "node", "n", "pos", "label", "d", (F.col("label") != F.col("main")).alias("out"), F.lit(float("inf")).alias("above"))
    inside = materialise(inside, "inside")
    discard(member)

    kept, rests = [star], []
    while True:
        large = inside.groupBy("s").agg((F.count_if("out") * F.count("*")).alias("pairs"), F.first("above").alias("above"))
        large = large.where(f"pairs > {PAIRS} and pairs <= {SHRUNK} * above").select("s", "pairs")
        more = not large.isEmpty()
        ready = inside.join(large, "s", "left_anti") if more else inside
        x = ready.where("out").select("s", *(F.col(c).alias(f"{c}_x") for c in ("node", "n", "pos", "label", "d")))
        rest = x.join(ready, "s").where((F.col("label_x") != F.col("label")) & size("n_x", "n") & window("n_x", "n", "pos_x", "pos") & F.expr(f"d_x is null or d is null or abs(d_x - d) <= {reach}"))
        ends = [F.struct(F.col(f"node{e}").alias("node"), F.col(f"n{e}").alias("n")) for e in ("_x", "")]
        rest = rest.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()
        rests.append(materialise(rest.select("a.node", F.col("b.node").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).withColumnRenamed("node", "a"), "rest"))
        if not more:
            break
        cells, measured = _divided(docs, k, percent, node, inside.join(large, "s"), distance, reach)
        discard(inside)
        # What links with a pivot need not be compared again.
        kept.append(measured)
        links = links.unionByName(measured.where(linked).select("a", "b"))
        old, label = label, components(_stars(links))
        discard(old)
        inside = cells.drop("label").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        inside = materialise(inside.select("s", "node", "n", "pos", "label", "d", "out", "above"), "inside")
        discard(cells)
    discard(inside)
    every = rests[0]
    for r in rests[1:]:
        every = every.unionByName(r)
    pairs = _compare(docs, k, percent, every.distinct(), node).where(linked)
    discard(*rests)
    discard(label)
    return links.unionByName(pairs.select("a", "b")), [pairs, *kept]


def _divided(docs: DataFrame, k: int, percent: int, node: DataFrame, region: DataFrame, distance: Column, reach: float) -> tuple[DataFrame, DataFrame]:
    """(cells, measured): ``region`` (s, node, n, pos, label, out, pairs) by Voronoi cells, and the members' sets beside the pivots'.

    An outside member is outside in its own cell alone; there it meets everyone who can link with it.
    """
    pick = [F.max_by(F.when(F.col("out"), F.struct("node", "n")), F.when(F.col("out"), F.xxhash64("node", F.lit(i)))).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = region.groupBy("s").agg(*pick).select("s", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS))))).alias("p"))
    all_of = materialise(region.join(pivots.select("s", F.col("p.node").alias("pivot"), F.col("p.n").alias("nb")), "s"), "cells")
    ends = all_of.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("na"), "nb").distinct()
    measured = _compare(docs, k, percent, ends, node, every=True)
    d = measured.select(F.col("a").alias("node"), F.col("b").alias("pivot"), distance.alias("e"))
    placed = all_of.drop("d").join(d, ["node", "pivot"], "left").withColumn("d", F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("e")))
    home = placed.groupBy("s", "node").agg(F.min(F.struct("d", "pivot")).alias("home"))
    placed = placed.join(home, ["s", "node"]).withColumn("own", F.col("out") & (F.col("pivot") == F.col("home.pivot")))
    radius = placed.where("own").groupBy("s", "pivot").agg(F.max("d").alias("radius"))
    placed = placed.join(radius, ["s", "pivot"]).where(f"d <= home.d + 2 * {reach} and d <= radius + {reach}")
    cell = F.xxhash64("s", "pivot").alias("s")
    cells = materialise(placed.select(cell, "node", "n", "pos", "label", "d", F.col("own").alias("out"), F.col("pairs").cast("double").alias("above")), "cells")
    discard(all_of)
    return cells, measured


def labelled(profile: DataFrame, node: DataFrame, label: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``profile`` (doc_id, n, node): the least doc_id of each class."""
    least = node.join(label, "node").groupBy("label").agg(F.min("rep").alias("component_id"))
    least = node.join(label, "node", "left").join(least, "label", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    return profile.join(least, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
