"""Stored facts of a tree and their repair: only files that changed are parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.fusion import first_match, multiset_digest
from lodeweave.plans.engine import Engine
from lodeweave.plans.facts import facts, split
from lodeweave.schema import RAW, SCHEMA_VERSION
from lodeweave.sources import tree
from lodeweave.workspace import delete, exists, materialize, names_in, touch

_DONE = "DONE"


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "sha") -> DataFrame:
    """(key, status): added, removed, changed or same, by a full outer join of two manifests."""
    a, b = old.select(key, F.col(value).alias("__old")), new.select(key, F.col(value).alias("__new"))
    status = first_match(
        [(F.col("__old").isNull(), "added"), (F.col("__new").isNull(), "removed"), (~F.col("__old").eqNullSafe(F.col("__new")), "changed")],
        F.lit("same"),
    )
    return a.join(b, key, "full").select(key, status.alias("status"))


def fingerprint(files: DataFrame) -> str:
    """A hash of a tree's paths and file hashes, whatever their order, and of the schema version."""
    row = F.sha2(F.concat_ws("\x1f", F.lit(str(SCHEMA_VERSION)), "path", "sha"), 256)
    return files.agg(multiset_digest(row).alias("h")).first()["h"]


def clean(spark: SparkSession, folder: str | None) -> None:
    if folder:
        delete(spark, folder)


def _generations(spark: SparkSession, home: str) -> list[int]:
    """Numbers of the generations that were written to the end, ascending."""
    numbers = [int(n[1:]) for n in names_in(spark, home) if n[:1] == "g" and n[1:].isdigit()]
    return sorted(n for n in numbers if exists(spark, f"{home}/g{n}/{_DONE}"))


def refresh(spark: SparkSession, files: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(facts, changed paths) of ``files``, from the store where a file's hash is as stored; the store is then replaced.

    A store of another schema version, or a broken one, is rebuilt.
    """
    home = f"{folder.rstrip('/')}/v{SCHEMA_VERSION}"
    whole, current = _generations(spark, home), None
    if whole:
        try:
            old = f"{home}/g{whole[-1]}"
            old_files, old_facts = spark.read.parquet(f"{old}/files"), spark.read.schema(RAW).parquet(f"{old}/facts")
            old_files.count()
            current = whole[-1]
        except Exception:
            current = None
    if current is None:
        fresh, changed = facts(files), files.select("path")
    else:
        status = materialize(snapshot_diff(old_files, files), "diff")
        changed = status.where("status <> 'same'").select("path")
        again = files.join(status.where("status in ('added', 'changed')"), "path", "left_semi")
        fresh = old_facts.join(status.where("status = 'same'"), "path", "left_semi").unionByName(facts(again))
    generation = f"g{whole[-1] + 1 if whole else 1}"
    fresh.write.mode("overwrite").parquet(f"{home}/{generation}/facts")
    files.drop("text").write.mode("overwrite").parquet(f"{home}/{generation}/files")
    # The marker is written last, so readers see the old generation or the whole new one; the old one stays for those that read it now.
    touch(spark, f"{home}/{generation}/{_DONE}")
    for number in whole[:-1]:
        delete(spark, f"{home}/g{number}")
    return spark.read.schema(RAW).parquet(f"{home}/{generation}/facts"), changed


def engine(spark: SparkSession, root: str, folder: str) -> Engine:
    files = materialize(tree.read_tree(spark, root), "files")
    stored, _ = refresh(spark, files, folder)
    return Engine(spark, files, tree.source_roots(root), tree.console_targets(root), root, stored=split(stored))
