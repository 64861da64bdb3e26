"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and the fast Hadamard transform rotate each unit vector; its hash is the signed axis it is
nearest to. A table's bucket is one such hash of each of ROTATIONS rotations; queries look into the buckets of the axes
that come next as well (multiprobe). What travels to the buckets is a code of each vector, one byte a component, with a bound on
what the code leaves out; so candidates are ranked between a lower and an upper bound of their cosines, and all that may be
among the best are kept. A query's best buckets of one table are ranked ahead: what they give for certain is its floor in all other
buckets, so that a task sends nothing that can't be among the nearest of all, however many tasks a query's buckets lie in. Only of those the whole vectors are fetched, and ranked by the exact cosines in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import discard, materialise

#: One rotation a table keeps recall high for neighbours of low cosine (0.3 in 64 dimensions), at the price of large buckets.
#: Queries look into the best PROBE_SHARE of a table's buckets.
TABLES, ROTATIONS, PROBE_SHARE = 4, 1, 0.25
NEAREST = 5
#: Vectors of a bucket that are ranked at once; larger buckets are dealt to several groups, each of which meets all queries.
GROUP = 4096
#: Buckets of the first table that are ranked ahead, for a floor below which nothing can be among a query's nearest.
AHEAD = 16
SEED = 11
#: What rounding can make of two equal cosines in float32.
ROUNDING = 2e-6


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (a power of two wide)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def rotated(x: np.ndarray, table: int, turn: int) -> np.ndarray:
    """Pseudo-random rotation ``turn`` of ``table``: rows are filled up with zeros to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng([SEED, table, turn])
    out = np.zeros((len(x), d))
    out[:, : x.shape[1]] = x
    for _ in range(3):
        out = hadamard(out * rng.choice([-1.0, 1.0], d)) / np.sqrt(d)
    return out


def probes(x: np.ndarray, table: int, n: int) -> np.ndarray:
    """The ``n`` best buckets of each row in ``table`` (rows x n): the sums of squares of the axes' coordinates rank them."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    codes, gains = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for turn in range(ROTATIONS):
        y = rotated(x, table, turn)
        both = np.concatenate([y, -y], 1)
        top = np.argsort(-both, 1, kind="stable")[:, :n]
        value = np.take_along_axis(both, top, 1)
        codes = (codes[:, :, None] * (2 * d) + top[:, None, :]).reshape(len(x), -1)
        gains = (gains[:, :, None] + (value * np.abs(value))[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-gains, 1, kind="stable")[:, :n]
        codes, gains = np.take_along_axis(codes, best, 1), np.take_along_axis(gains, best, 1)
    return codes


def probes_of(width: int) -> int:
    """Buckets of a table that a query of ``width`` components looks into."""
    axes = 2 << max(1, (width - 1).bit_length())
    return max(1, round(PROBE_SHARE * axes**ROTATIONS))


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, errors) of unit vectors: bytes, what one is worth, and the length of what they leave out."""
    scale = np.abs(x).max(1) / 127
    code = np.round(x / scale[:, None]).astype(np.int8)
    return code, scale.astype(np.float32), np.linalg.norm(x - code * scale[:, None].astype(np.float32).astype(float), axis=1).astype(np.float32)


HASHED = "width int, tab int, bucket long, key long, code binary, scale float, error float"


def _hashed(vectors: DataFrame, asked: bool, whole: bool = False, ahead: bool = False) -> DataFrame:
    """Each vector (key, v) as a unit vector's code, in its bucket of each table, or if ``asked`` in all buckets that it looks into.

    With ``ahead`` the first table's alone, and of those that it looks into the AHEAD best.

    With ``whole``, all vectors of one length are one bucket of table -1.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(v) for v in batch.column(1)], np.int64)
            keys, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            for width in np.unique(size).tolist():
                rows = np.flatnonzero(size == width)
                for k in range(0, len(rows), 1024):
                    pick = rows[k : k + 1024]
                    x = flat[first[pick][:, None] + np.arange(width)].astype(float)
                    # The largest component is taken out first, so that no square overflows.
                    x /= np.abs(x).max(1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    code, scale, error = coded(x)
                    packed = pa.array([c.tobytes() for c in code], pa.binary())
                    for table in [-1] if whole else range(1 if ahead else TABLES):
                        n = min(probes_of(width), AHEAD) if ahead else probes_of(width)
                        bucket = np.zeros((len(x), 1), np.int64) if whole else probes(x, table, n if asked else 1)
                        m = np.repeat(np.arange(len(x)), bucket.shape[1])
                        columns = [np.full(len(m), width, np.int32), np.full(len(m), table, np.int32), bucket.ravel(), keys[pick][m]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), packed.take(pa.array(m)), pa.array(scale[m]), pa.array(error[m])], [c.split()[0] for c in HASHED.split(", ")])

    return vectors.select("key", "v").mapInArrow(task, HASHED)


def _floors(index: DataFrame, queries: DataFrame, nearest: int) -> DataFrame:
    """(key, floor): a cosine that the ``nearest`` + 1 best of the query ``key`` reach, where the buckets ranked ahead hold so many."""
    found = _ranked(_hashed(index, False, ahead=True), _hashed(queries, True, ahead=True), nearest)
    # A vector is in one bucket of a table, so that no two rows of a query are the same one's.
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
    found = found.withColumn("place", place).where(F.col("place") <= nearest + 1)
    return found.where(F.col("place") == nearest + 1).select(F.col("query").alias("key"), F.col("low").alias("floor"))


def _ranked(index: DataFrame, queries: DataFrame, nearest: int) -> DataFrame:
    """(query, key, low, high): what may be among the ``nearest`` + 1 best of each query in the buckets that it looks into.

    Queries may have a floor that these best reach; it's null where none is known.

    Rows of both sides are sorted by bucket and read one bucket after the other; a task keeps the best of each of its queries,
    however many buckets they look into.
    """
    by = ["width", "tab", "bucket"]
    spark = index.sparkSession
    size = index.groupBy(*by).agg(F.count("*").alias("n"))
    size = materialise(size.select(*by, F.ceil(F.col("n") / GROUP).cast("int").alias("groups")), "buckets")
    dealt = index.join(size, by).withColumn("lot", F.pmod(F.xxhash64("key"), F.col("groups")).cast("int"))
    sent = queries.join(size, by).withColumn("lot", F.explode(F.expr("sequence(0, groups - 1)")))
    # Only groups that some query looks into are ranked.
    dealt = dealt.join(queries.select(*by).distinct(), by, "left_semi")
    columns = [*by, "lot", "key", "code", "scale", "error"]
    floor = F.coalesce("floor", F.lit(float("-inf"))) if "floor" in queries.columns else F.lit(float("-inf"))
    both = dealt.select(F.lit(False).alias("asked"), *columns, F.lit(float("-inf")).cast("float").alias("floor"))
    both = both.unionByName(sent.select(F.lit(True).alias("asked"), *columns, floor.cast("float").alias("floor")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def meet(rows: pa.Table) -> None:
            asked = rows.column("asked").to_numpy()
            if asked.all() or not asked.any():
                return
            width = rows.column("width")[0].as_py()
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(-1, width).astype(np.float32) * rows.column("scale").to_numpy()[:, None]
            key, error, floor = (rows.column(c).to_numpy() for c in ("key", "error", "floor"))
            q, x = np.flatnonzero(asked), np.flatnonzero(~asked)
            for k in range(0, len(q), 256):
                part = q[k : k + 256]
                score = code[part] @ code[x].T
                slack = error[part][:, None] + error[x][None] + error[part][:, None] * error[x][None] + np.float32(ROUNDING)
                low, high = score - slack, score + slack
                m = min(nearest + 1, len(x))
                last = np.maximum(np.partition(low, len(x) - m, 1)[:, len(x) - m], floor[part]) if m > nearest else floor[part]
                for row, at in enumerate(part.tolist()):
                    good = np.flatnonzero(high[row] >= last[row])
                    if len(good):
                        add(int(key[at]), key[x[good]], low[row, good], high[row, good])

        def add(query: int, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            if query in kept:
                old = kept[query]
                key, one = np.unique(np.concatenate([old[0], key]), return_index=True)
                low, high = np.concatenate([old[1], low])[one], np.concatenate([old[2], high])[one]
            if len(low) > nearest + 1:
                good = high >= np.partition(low, len(low) - nearest - 1)[len(low) - nearest - 1]
                key, low, high = key[good], low[good], high[good]
            kept[query] = (key, low, high)

        held: list[pa.RecordBatch] = []
        names = None
        for batch in batches:
            names = batch.schema.names
            where = np.stack([batch.column(c).to_numpy() for c in ("width", "tab", "bucket", "lot")], 1)
            edges = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), len(where)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if held and any(held[-1].column(names.index(c))[-1].as_py() != part.column(names.index(c))[0].as_py() for c in ("width", "tab", "bucket", "lot")):
                    meet(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            meet(pa.Table.from_batches(held))
        for query, (key, low, high) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), query)), pa.array(key), pa.array(low), pa.array(high)], ["query", "key", "low", "high"])

    group = [*by, "lot"]
    sorted_ = both.repartition(n, *group).sortWithinPartitions(*group)
    return sorted_.mapInArrow(best, "query long, key long, low float, high float")


def nearest_neighbours(vectors: DataFrame, every: int = 50, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``vectors`` (vec_id, embedding) whose id ``every`` divides.

    Candidates are all other rows; score is the cosine in double precision, ties go to the smaller vec_id. Vectors that
    are null, zero or hold null or non-finite components take no part, nor do rows of null id; vectors of other lengths
    than the query's are no candidates. Rows of one id count once (the least vector). Queries for which the tables find
    fewer than ``nearest`` are ranked against all rows. Equal vectors are one entry of the index with the ``nearest`` + 1
    least ids, of which no more can be among a query's nearest. Further columns are ignored; an empty table gives an empty one.
    """
    # The vectors as they are: doubles only where they are worked on.
    good = vectors.select("vec_id", F.col("embedding").alias("v")).where("vec_id is not null and size(v) > 0")
    good = good.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0))
    good = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    # 128 bits tell vectors apart.
    good = materialise(good.withColumn("print", F.struct(F.xxhash64(F.lit(1), "v").alias("a"), F.xxhash64("v", F.lit(2)).alias("b"))), "vectors")
    ids = good.groupBy("print").agg(F.count("*").alias("n"), F.min("vec_id").alias("key"))
    several = good.join(ids.where("n > 1").select("print"), "print", "left_semi").select("print", "vec_id")
    order = Window.partitionBy("print").orderBy("vec_id")
    least = several.withColumn("place", F.row_number().over(order)).where(F.col("place") <= nearest + 1)
    more = materialise(least.join(ids.select("print", "key"), "print").select("key", "vec_id"), "copies")
    index = good.join(ids.select("key"), F.col("vec_id") == F.col("key"), "left_semi").select(F.col("vec_id").alias("key"), "v")
    queries = good.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("key"), "v")
    floors = materialise(_floors(index, queries, nearest), "floors")
    asked = _hashed(queries, True).join(floors, "key", "left")
    hits = materialise(_ranked(_hashed(index, False), asked, nearest), "hits")
    discard(floors)

    def top(found: DataFrame) -> DataFrame:
        found = found.groupBy("query", "key").agg(F.max("low").alias("low"), F.max("high").alias("high"))
        row = Window.partitionBy("query").orderBy(F.desc("low"), "key")
        found = found.withColumn("place", F.row_number().over(row))
        # What can't be told from the last entry needed is settled below.
        last = F.max(F.when(F.col("place") == nearest + 1, F.col("low"))).over(Window.partitionBy("query"))
        found = found.withColumn("last", last).where(F.col("last").isNull() | (F.col("high") >= F.col("last"))).select("query", "key")
        copies = found.join(more, "key").select("query", "vec_id")
        found = found.select("query", F.col("key").alias("vec_id")).union(copies).distinct().where("query <> vec_id")
        found = materialise(found, "pairs")
        named = found.select("vec_id").union(found.select("query")).distinct()
        wanted = _measured(good.join(named, "vec_id", "left_semi"))
        a = wanted.select(F.col("vec_id").alias("query"), F.col("v").alias("x"), F.col("norm").alias("nx"))
        b = wanted.select("vec_id", F.col("v").alias("y"), F.col("norm").alias("ny"))
        score = _dot("x", "y") / (F.col("nx") * F.col("ny"))
        found = found.join(a, "query").join(b, "vec_id").select(F.col("query").alias("query_id"), "vec_id", score.alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")

    result = materialise(top(hits), "nearest")
    enough = result.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= nearest)
    short = materialise(queries.join(enough, F.col("key") == F.col("query_id"), "left_anti"), "short")
    discard(hits)
    if short.isEmpty():
        return result
    rest = top(_ranked(_hashed(index, False, True), _hashed(short, True, True), nearest))
    return result.join(short, F.col("query_id") == F.col("key"), "left_anti").unionByName(rest)


def _dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)


def _measured(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, norm): vectors whose squares would leave the range of a double are scaled, which no cosine notices."""
    most = F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c.cast("double"))))
    out = vectors.select("vec_id", "v", most.alias("most"))
    odd = ~F.col("most").between(1e-100, 1e100)
    out = out.select("vec_id", F.when(odd, F.transform("v", lambda c: c.cast("double") / F.col("most"))).otherwise(F.col("v").cast("array<double>")).alias("v"))
    return out.withColumn("norm", F.sqrt(_dot("v", "v")))
