"""Predictions fused with observations, and rows labelled by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fuse(static: DataFrame, observed: DataFrame, keys: list[str], label_col: str = "label") -> DataFrame:
    """Distinct ``keys`` of both tables labelled ``confirmed``, ``predicted`` (static only) or ``observed`` (observed only)."""
    s = static.select(*keys).distinct().withColumn("__s", F.lit(True))
    o = observed.select(*keys).distinct().withColumn("__o", F.lit(True))
    both = s.join(o, keys, "full")
    label = F.when(F.col("__s") & F.col("__o"), "confirmed").when(F.col("__s"), "predicted").otherwise("observed")
    return both.withColumn(label_col, label).select(*keys, label_col)


def first_match(rules: list[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    """The label of the first rule that holds."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for rule, label in rules[1:]:
        out = out.when(rule, F.lit(label))
    return out.otherwise(F.lit(None) if otherwise is None else otherwise)


def multiset_digest(digest: Column) -> Column:
    """Aggregate: a hash of a multiset of hex SHA-256 digests, whatever their order, by sums that combine before the shuffle."""
    parts = (F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4))
    return F.sha2(F.concat_ws("-", F.count(digest).cast("string"), *parts), 256)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per ``keys``: the first in ``order``, chosen by a partial aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*(o.alias(f"__o{i}") for i, o in enumerate(order)), *(F.col(c) for c in rest))
    best = df.groupBy(*keys).agg(F.min(row).alias("__r"))
    return best.select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*df.columns)


def fill_header(df: DataFrame, group: list[str], order: str, header: Column, out_col: str) -> DataFrame:
    """``df`` with ``out_col``: the last non-null ``header`` at or before each row of its group."""
    from pyspark.sql import Window

    over = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out_col, F.last(header, ignorenulls=True).over(over))


def sole_value(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, sole): the one distinct ``value`` of each group, null where there are several."""
    n = F.count_distinct(F.col(value))
    return df.groupBy(*keys).agg(F.when(n == 1, F.min(value)).alias("sole"))


def covered_lines(changed: DataFrame, coverage: DataFrame) -> DataFrame:
    """(path, line, status, tests): distinct (path, line) of ``changed`` with the sorted ids (nodeid) that ``coverage`` has for them."""
    ran = coverage.groupBy("path", "line").agg(F.array_sort(F.collect_set("nodeid")).alias("tests"))
    out = changed.select("path", "line").distinct().join(ran, ["path", "line"], "left")
    status = F.when(F.col("tests").isNull(), "uncovered").otherwise("covered")
    return out.select("path", "line", status.alias("status"), F.coalesce("tests", F.array().cast("array<string>")).alias("tests"))


def coverage_totals(lines: DataFrame) -> DataFrame:
    """(path, covered, uncovered) of ``covered_lines``; a file without a covered line has 0."""
    count = lambda status: F.sum((F.col("status") == status).cast("long"))
    return lines.groupBy("path").agg(count("covered").alias("covered"), count("uncovered").alias("uncovered"))


def counts_by(df: DataFrame, key: str, kinds: str) -> DataFrame:
    """(key, n, kinds): rows per ``key`` and the sorted distinct ``kinds`` among them."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(kinds)).alias(kinds))
