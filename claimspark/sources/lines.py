"""Text sources: lines of landed pages with their places, and delimited files with quoted fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, line_no, line) of each line that isn't blank; CR, LF and CRLF end lines."""
    cut = docs.select(key, F.posexplode(F.split(column, "\r\n|\r|\n")).alias("line_no", "line"))
    return cut.withColumn("line", F.trim("line")).where("line <> ''")


def delimited(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with header: quotes may hold line ends and doubled quotes; fields are trimmed, blank rows dropped."""
    schema = ", ".join(f"{c} string" for c in columns)
    rows = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.dropna("all")
