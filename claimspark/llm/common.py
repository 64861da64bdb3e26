"""Helpers that the training-data operators share: tables, shared storage, bounded sketches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.sources.shared import shared_folder as shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for ``tables``, once nothing reads it any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this module's own making through the file system that Spark writes it with."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it while the input has a column that clashes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


BLOCK = 1 << 16


def sketch(df: DataFrame, slots: Callable[[pa.RecordBatch], Iterable[np.ndarray]], width: int) -> np.ndarray:
    """Counters of a one-row count-min sketch over all rows: every task folds its partition into ``width`` counters.

    What reaches the driver is the sum, ``width`` numbers whatever the input's size. ``slots`` gives the counter of each
    item of a batch, some items at a time.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has fewer items than 2**31.
        total = np.zeros(width, np.int32)
        for batch in batches:
            for part in slots(batch):
                slot, n = np.unique(part, return_counts=True)
                total[slot] += n.astype(np.int32)
        step = min(BLOCK, width)
        for k in range(0, width, step):
            part = total[k : k + step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["at", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64) for x in group["counts"])
        total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return pd.DataFrame({"at": [group["at"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    # Two steps, so that no task meets more than some dozens of partial sketches' blocks at once.
    parts = df.mapInArrow(fold, "at int, counts binary").withColumn("lot", F.spark_partition_id())
    some = parts.groupBy("at", F.expr("lot div 64")).applyInPandas(lambda g: add(g), "at int, counts binary")
    out = np.zeros(width, np.int32)
    for row in some.groupBy("at").applyInPandas(add, "at int, counts binary").collect():
        part = np.frombuffer(zlib.decompress(row["counts"]), np.int32)
        out[row["at"] : row["at"] + len(part)] = part
    return out


def bit_map(df: DataFrame, bits: int) -> np.ndarray:
    """A map of 2**bits bits, packed into bytes: those that the only column of ``df`` numbers are set.

    Tasks and then groups of them fold theirs into one, so that what reaches the driver is the map alone.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[batch.column(0).to_numpy()] = True
        packed = np.packbits(seen)
        step = min(BLOCK, len(packed))
        for k in range(0, len(packed), step):
            part = packed[k : k + step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["at", "bits"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        both = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in group["bits"]])
        return pd.DataFrame({"at": [group["at"].iloc[0]], "bits": [zlib.compress(both.tobytes(), 1)]})

    parts = df.mapInArrow(fold, "at int, bits binary").withColumn("lot", F.spark_partition_id())
    some = parts.groupBy("at", F.expr("lot div 64")).applyInPandas(lambda g: join(g), "at int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in some.groupBy("at").applyInPandas(join, "at int, bits binary").collect():
        part = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        out[row["at"] : row["at"] + len(part)] = part
    return out
