"""Landed inputs: JSON artifacts, queue messages, images, and delimited text with its rows' ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.operators.tabular import COLUMNS

#: Bytes of an image that is taken up.
IMAGE_BYTES = 15 << 20


def artifact(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """The rows of a JSON array; none without a path; an error for what isn't such an array."""
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def messages(rows: DataFrame, body: str, runtime: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) scan requests: source_id, reason (scheduled or manual) and requested_at out of JSON.

    Rejected rows keep their body and say why. With ``runtime``, a message for the other runtime's source is rejected too.
    """
    read = rows.withColumn("_m", F.from_json(body, "sourceId string, reason string, requestedAt string, runtime string"))
    why = F.when(F.col("_m.sourceId").isNull() | (F.col("_m.sourceId") == ""), "no source").when(~F.coalesce(F.col("_m.reason").isin("scheduled", "manual"), F.lit(False)), "unknown reason").when(F.nullif(F.col("_m.requestedAt"), F.lit("")).isNull(), "no time")
    why = why if runtime is None else why.when(~F.coalesce(F.col("_m.runtime"), F.lit("standard")).eqNullSafe(runtime), "wrong runtime")
    read = read.withColumn("rejected", why)
    good = read.where("rejected is null").select(*(c for c in rows.columns if c != body), F.col("_m.sourceId").alias("source_id"), F.col("_m.reason").alias("reason"), F.col("_m.requestedAt").alias("requested_at"))
    return good, read.where("rejected is not null").drop("_m")


def images(spark: SparkSession, path: str, most: int = IMAGE_BYTES) -> DataFrame:
    """(path, mime, base64) of image files; larger ones are left out unread."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(ending.isin("jpg", "jpeg"), "image/jpeg").when(ending.isin("png", "gif", "webp"), F.concat(F.lit("image/"), ending))
    return files.select("path", mime.alias("mime"), F.base64("content").alias("base64")).where("mime is not null")


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows (row_index and six columns) of a delimited file: fields trimmed, blank records dropped, the first record a header.

    row_index counts the records that aren't blank, the header being 1. A file is one reader's task, as quoted fields may
    hold line ends; many files are read side by side, each with numbers of its own.
    """
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    rows = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)
    rows = rows.select(F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"), *(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in COLUMNS))
    rows = rows.where(F.concat(*map(F.col, COLUMNS)) != "")
    # Numbers grow within a file, which one task reads.
    at = F.row_number().over(Window.partitionBy("_file").orderBy("_at")) + 1
    return rows.select(at.alias("row_index"), *COLUMNS)
