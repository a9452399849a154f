"""Exact de-duplication of whole texts that survives a group of copies of any size.

Copies are combined three times, each time comparing digest and full text:

1. locally: the partial aggregate of each scan task leaves one row per text;
2. per salt: tasks are dealt over a few salts, and rows of one (digest, salt)
   meet, so a text that every task holds arrives at several reducers;
3. globally: at most ``salts`` winners per text meet under the digest alone.

Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import SPACE
from lodeweave.workspace import materialize

SALTS = 16


def normalized(text: Column) -> Column:
    """The text that decides equality: each run of white space is one space, null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("t"))
    return text.select("id", "t", F.unhex(F.sha2("t", 256)).alias("digest"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the smallest id of the rows with an equal text.  Null text
    counts as empty.  Rows that repeat an id are rows of their own: each is
    counted in ``group_size``, and all rows that carry the smallest id are
    ``kept``.  A null id is never the smallest unless the group has no other,
    and such a row is kept only then.  Other columns of ``docs`` are not read.
    An empty table gives an empty result.
    """
    salted = (
        _keyed(docs, id_col, text_col)
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "t")
        .agg(F.min("id").alias("keep"), F.count("*").alias("n"))
    )
    winners = salted.repartition("digest").groupBy("digest", "t").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    per_digest = materialize(
        winners.groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep").alias("keep"), F.min("n").alias("n")), "exact"
    )
    clear = _keyed(docs, id_col, text_col).select("id", "digest").join(per_digest.where("texts = 1"), "digest")
    found = clear.select("id", "digest", "keep", "n")
    clashes = per_digest.where("texts > 1").select("digest")
    if not clashes.isEmpty():
        # Different texts under one digest: here the text is part of the key.
        clashing = _keyed(docs, id_col, text_col).join(clashes, "digest", "left_semi")
        by_text = clashing.groupBy("digest", "t").agg(F.min("id").alias("keep"), F.count("*").alias("n"))
        found = found.union(clashing.join(by_text, ["digest", "t"]).select("id", "digest", "keep", "n"))
    return found.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row with a smaller id has; columns unchanged.

    Rows that repeat both id and text are not told apart: all of them stay
    or all go.  Rows that share only an id are judged each by its own text.
    """
    dropped = exact_groups(docs, id_col, text_col).where(~F.col("kept"))
    dropped = dropped.select(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__digest")).distinct()
    digest = F.unhex(F.sha2(normalized(docs[text_col]), 256))
    return docs.join(dropped, docs[id_col].eqNullSafe(dropped["__id"]) & (digest == dropped["__digest"]), "left_anti")
