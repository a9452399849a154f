"""Joins on dotted names that have no equality key, turned into equi-joins by exploding suffixes or prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffixes(name: Column, sep: str = ".") -> Column:
    """``a.b.c`` gives ``[a.b.c, b.c, c]``."""
    parts = F.split(name, "\\" + sep if sep in ".|" else sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), sep))


def prefixes(name: Column, sep: str = ".") -> Column:
    """``a.b.c`` gives ``[a, a.b, a.b.c]``."""
    parts = F.split(name, "\\" + sep if sep in ".|" else sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))


def unique_suffix_table(ids: DataFrame, id_col: str) -> DataFrame:
    """(spelling, id, matches): every suffix of every id; ``id`` is the exact match, else the only one, else null."""
    each = ids.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    each = each.select("id", F.explode(suffixes(F.col("id"))).alias("spelling"))
    return each.groupBy("spelling").agg(
        F.count("*").alias("matches"), F.min("id").alias("first"), F.max(F.col("id") == F.col("spelling")).alias("exact")
    ).select("spelling", F.when(F.col("exact"), F.col("spelling")).when(F.col("matches") == 1, F.col("first")).alias("id"), "matches")


def unique_suffix_join(left: DataFrame, name_col: str, ids: DataFrame, id_col: str, out_col: str) -> DataFrame:
    """``left`` with ``out_col``: the id equal to ``name_col``, else the only id that ends in ``.name``, else null."""
    table = unique_suffix_table(ids, id_col).where("id is not null").select(
        F.col("spelling").alias("__spelling"), F.col("id").alias(out_col),
    )
    return left.join(table, left[name_col] == table["__spelling"], "left").drop("__spelling")


def prefix_semi_join(left: DataFrame, name_col: str, ids: DataFrame, id_col: str, flag_col: str) -> DataFrame:
    """``left`` with ``flag_col``: whether ``name_col`` is an id or a package (dotted prefix) of one."""
    known = ids.select(F.explode(prefixes(F.col(id_col))).alias("__known")).distinct().withColumn(flag_col, F.lit(True))
    joined = left.join(known, left[name_col] == known["__known"], "left").drop("__known")
    return joined.withColumn(flag_col, F.coalesce(flag_col, F.lit(False)))


def longest_prefix_join(
    left: DataFrame, key_col: str, name_col: str, ids: DataFrame, id_col: str, out_col: str, sep: str = ".",
) -> DataFrame:
    """``left`` with ``out_col``: the longest id that is ``name_col`` or a prefix of it at a ``sep``, else null.

    ``key_col`` identifies the rows of ``left``.
    """
    tried = left.select(F.col(key_col).alias("__key"), F.explode(prefixes(F.col(name_col), sep)).alias("__prefix"))
    known = ids.select(F.col(id_col).alias("__id")).distinct()
    best = tried.join(known, tried["__prefix"] == known["__id"]).groupBy("__key").agg(F.max_by("__id", F.length("__id")).alias(out_col))
    return left.join(best, left[key_col] == best["__key"], "left").drop("__key")
