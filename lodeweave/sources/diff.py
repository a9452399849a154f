"""Changed lines of a unified diff, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.fusion import fill_header


def changed_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(path, line) of the new side of a zero-context diff.

    A ``+++ b/path`` line names the file of the hunks after it; a hunk
    ``+c,d`` covers d lines from c, and one that only deletes (d = 0) covers
    line c, after which the deleted lines were.  Deleted files have no lines.
    """
    numbered = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n long, line string")
    return parse_diff(numbered.withColumn("part", F.lit(0)))


def parse_diff(numbered: DataFrame) -> DataFrame:
    """(path, line) from (part, n, line): diffs of several parts are parsed side by side."""
    header = F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]*)", 1))
    named = fill_header(numbered, ["part"], "n", header, "path").where(F.col("line").startswith("@@ "))
    first = F.regexp_extract("line", r"^@@ [^+]*\+(\d+)", 1).cast("int")
    size = F.coalesce(F.nullif(F.regexp_extract("line", r"^@@ [^+]*\+\d+,(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    hunks = named.where("path <> '/dev/null'").select("path", first.alias("first"), F.greatest(size, F.lit(1)).alias("size"))
    return hunks.select("path", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("line")).distinct()
