"""Connected components of an undirected link table, smallest node as label."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.workspace import discard, materialize, ship


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (
        both.where("b > a")
        .join(low, "a")
        .where("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` hold a > b; each node hands its smaller neighbours to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    handed = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.union(low.select("a", F.col("m").alias("b"))).distinct()


def _smallest_of_each(edges: pd.DataFrame) -> pd.DataFrame:
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(edges["a"].tolist(), edges["b"].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return pd.DataFrame([(n, find(n)) for n in list(parent)], columns=["node", "component"])


def connected_components(links: DataFrame, left: str, right: str, max_rounds: int = 60, local_edges: int = 0) -> DataFrame:
    """(node, component) for every node that ``links`` mentions.

    At most ``local_edges`` distinct links are handed to one task as a whole.

    Alternating large-star and small-star rounds; the number of rounds grows
    with the logarithm of the longest path.  Every round is written to the
    shared folder, and only one pair of sums per round reaches the driver.
    Minima are pre-aggregated before the shuffle and the joins are of a kind
    whose large partitions Spark splits, so a node with very many links does
    not land in one task.  Self-links and repeated links are harmless; rows
    with a null end are ignored; an empty table gives an empty result.
    """
    edges = materialize(
        links.select(
            F.greatest(left, right).alias("a"), F.least(left, right).alias("b"), F.col(left).isNotNull() & F.col(right).isNotNull()
        )
        .toDF("a", "b", "ok")
        .where("ok")
        .select("a", "b")
        .distinct(),
        "cc",
    )
    if local_edges and edges.limit(local_edges + 1).count() <= local_edges:
        kind = edges.schema["a"].dataType.simpleString()
        ship(edges.sparkSession)
        whole = edges.select(F.lit(0).alias("whole"), "a", "b").groupBy("whole")
        return materialize(whole.applyInPandas(_smallest_of_each, f"node {kind}, component {kind}"), "cc")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    edges = edges.where("a <> b")
    seen = None
    for _ in range(max_rounds):
        last, large = edges, materialize(_large_star(edges), "cc")
        edges = materialize(_small_star(large), "cc")
        discard(last, large)
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a", "a").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def joined_to(links: DataFrame, left: str, right: str, seeds: DataFrame, local_edges: int = 0) -> DataFrame:
    """(node) of everything that ``links`` join, in either direction, to a node of ``seeds`` (node) they mention."""
    parts = materialize(connected_components(links, left, right, local_edges=local_edges), "joined")
    hit = parts.join(seeds, "node", "left_semi").select("component").distinct()
    return parts.join(hit, "component", "left_semi").select("node")
