"""Graph operators over edge tables ``(src, dst)``: closures, reachability, strongly connected components.

Each is a semi-naive loop: one round joins only the nodes that the last
round found.  Rounds are written to the shared folder, so the plan of a round
does not hold those before it and a lost executor costs a re-read.  Minima
and distinct are pre-aggregated before their shuffle; the joins are left to
the optimizer, which broadcasts a small frontier and splits a skewed key.

A round costs a job however little it finds.  A graph of a checked size, at
most ``LOCAL_EDGES`` edges, is therefore handed to one task as a whole, and
so is what is left of a larger one once it has become that small.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.workspace import discard, materialize, ship

#: Edges up to which a graph is walked in one task (about 100 bytes each there).
LOCAL_EDGES = 500_000
#: Rounds after which the visited nodes are written as one table again.
_COMPACT = 8


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _is_small(edges: DataFrame, local_edges: int) -> bool:
    return local_edges > 0 and edges.limit(local_edges + 1).count() <= local_edges


def _walk(edges: pd.DataFrame, roots: pd.DataFrame, max_depth: int | None) -> pd.DataFrame:
    follows: dict = {}
    for src, dst in zip(edges["src"].tolist(), edges["dst"].tolist(), strict=True):
        follows.setdefault(src, []).append(dst)
    level, depth, out = sorted(set(roots["node"].tolist())), 0, []
    seen = set(level)
    while level and (max_depth is None or depth < max_depth):
        depth += 1
        via: dict = {}
        for node in level:  # ascending, so the first to offer a node is the smallest
            for nxt in follows.get(node, ()):
                if nxt not in seen:
                    via.setdefault(nxt, node)
        seen |= via.keys()
        out += [(node, depth, parent) for node, parent in via.items()]
        level = sorted(via)
    return pd.DataFrame(out, columns=["node", "depth", "via"])


def _closure_in_one_task(edges: DataFrame, roots: DataFrame, max_depth: int | None) -> DataFrame:
    kind = edges.schema["dst"].dataType.simpleString()
    ship(edges.sparkSession)
    whole = F.lit(0).alias("whole")
    e = edges.select(whole, "src", "dst").where("src is not null and dst is not null").groupBy("whole")
    r = roots.select(whole, F.col("node").cast(edges.schema["src"].dataType)).where("node is not null").groupBy("whole")
    found = e.cogroup(r).applyInPandas(lambda e, r: _walk(e, r, max_depth), f"node {kind}, depth int, via {kind}")
    return materialize(found, "closure")


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, local_edges: int | None = None) -> DataFrame:
    """(node, depth, via) of every node that ``roots`` (column node) reach, without the roots.

    ``depth`` is the smallest number of edges from a root; ``via`` the smallest
    node one edge nearer.  ``max_depth`` bounds the number of edges; 0 reaches
    nothing.  Cycles end where nothing new is found.
    """
    edges = edges.select("src", "dst")
    if _is_small(edges, LOCAL_EDGES if local_edges is None else local_edges):
        return _closure_in_one_task(edges, roots, max_depth)
    seen = materialize(roots.select("node").where("node is not null").distinct(), "closure")
    frontier, found, depth = seen, [], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        step = step.where("node is not null").join(seen, "node", "left_anti")
        frontier = materialize(step.select("node", F.lit(depth).alias("depth"), "via"), "closure")
        if frontier.isEmpty():
            break
        found.append(frontier)
        seen = seen.union(frontier.select("node"))
        if depth % _COMPACT == 0:
            seen = materialize(seen, "closure")
    if not found:
        return frontier.limit(0) if depth else seen.select("node", F.lit(0).alias("depth"), F.col("node").alias("via")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def reachable(edges: DataFrame, seeds: DataFrame, extra: DataFrame | None = None, local_edges: int | None = None) -> DataFrame:
    """(node) reached from any of ``seeds`` (column node), the seeds included, over ``edges`` and ``extra`` edges."""
    both = edges.select("src", "dst")
    if extra is not None:
        both = both.union(extra.select("src", "dst"))
    seeds = seeds.select("node").where("node is not null").distinct()
    return seeds.union(closure(both, seeds, local_edges=local_edges).select("node"))


def pair_closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, ancestor, depth): all pairs joined by a path, with the length of the shortest.

    For trees and other sparse relations such as base classes; the number of
    pairs is that of the result.  A node on a cycle reaches itself.
    """
    edges = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "pairs")
    frontier = materialize(edges.select(F.col("src").alias("node"), F.col("dst").alias("ancestor"), F.lit(1).alias("depth")), "pairs")
    seen, depth = frontier, 1
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        step = frontier.join(edges, frontier["ancestor"] == edges["src"]).select("node", F.col("dst").alias("ancestor")).distinct()
        step = step.join(seen.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        frontier = materialize(step.select("node", "ancestor", F.lit(depth).alias("depth")), "pairs")
        seen = seen.union(frontier)
        if depth % _COMPACT == 0:
            seen = materialize(seen, "pairs")
    return seen


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left after nodes without a way in or out are taken off, again and again."""
    count, given = edges.count(), edges
    while count:
        last = edges
        ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = materialize(edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"), "scc")
        if last is not given:
            discard(last)
        left = edges.count()
        if left == count:
            break
        count = left
    return edges


def _spread_smallest(edges: DataFrame) -> DataFrame:
    """(node, color): the smallest node from which each node is reached, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    last = colors = materialize(nodes.select("node", F.col("node").alias("color")), "scc")
    while True:
        offered = colors.join(edges, colors["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("offer"))
        after = colors.join(offered, "node", "left").select(
            "node", F.least("color", "offer").alias("color"), (F.col("offer") < F.col("color")).alias("moved"),
        )
        after = materialize(after, "scc")
        discard(last)
        last, colors = after, after.select("node", "color")
        if after.where("moved").isEmpty():
            return colors


def _tarjan(edges: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected components of a whole graph, without recursion."""
    follows: dict = {}
    for src, dst in zip(edges["src"].tolist(), edges["dst"].tolist(), strict=True):
        follows.setdefault(src, []).append(dst)
    order: dict = {}
    low: dict = {}
    open_: list = []
    inside: set = set()
    out = []
    for start in follows:
        if start in order:
            continue
        work = [(start, iter(follows[start]))]
        order[start] = low[start] = len(order)
        open_.append(start)
        inside.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    open_.append(nxt)
                    inside.add(nxt)
                    work.append((nxt, iter(follows.get(nxt, ()))))
                    break
                if nxt in inside:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(open_.pop())
                        inside.discard(members[-1])
                    if len(members) > 1 or node in follows.get(node, ()):
                        least = min(members)
                        out += [(m, least) for m in members]
    return pd.DataFrame(out, columns=["node", "component"])


def _components_in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()
    ship(edges.sparkSession)
    whole = edges.select(F.lit(0).alias("whole"), "src", "dst").groupBy("whole")
    return materialize(whole.applyInPandas(_tarjan, f"node {kind}, component {kind}"), "scc")


def strong_components(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(node, component) of nodes on a cycle; ``component`` is the smallest node of it.  A self-loop is a cycle.

    Trims what cannot be on a cycle, colors each node with the smallest node
    that reaches it, and takes per color what also reaches that node; repeats
    on the rest.
    """
    bound = LOCAL_EDGES if local_edges is None else local_edges
    edges = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "scc")
    if _is_small(edges, bound):
        return _components_in_one_task(edges)
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    rest, parts = _trimmed(edges.where("src <> dst")), []
    while not rest.isEmpty():
        if _is_small(rest, bound):
            parts.append(_components_in_one_task(rest))
            break
        colors = _spread_smallest(rest)
        same = rest.join(colors.withColumnsRenamed({"node": "src", "color": "c"}), "src").join(
            colors.withColumnsRenamed({"node": "dst", "color": "d"}), "dst"
        )
        inside = materialize(same.where("c = d").select("src", "dst", F.col("c").alias("color")), "scc")
        # Within a color, what reaches the color's own node is its component.
        back = reversed_edges(inside)
        roots = colors.where("node = color").select("node")
        reached = materialize(
            roots.union(closure(back, roots, local_edges=local_edges).select("node")), "scc",
        ).join(colors, "node").select("node", F.col("color").alias("component"))
        sizes = reached.groupBy("component").count().where("count > 1").select("component")
        parts.append(materialize(reached.join(sizes, "component", "left_semi").select("node", "component"), "scc"))
        done = reached.select("node")
        rest = rest.join(
            done.withColumnRenamed("node", "src"), "src", "left_anti",
        ).join(done.withColumnRenamed("node", "dst"), "dst", "left_anti")
        rest = _trimmed(materialize(rest.select("src", "dst"), "scc"))
    for part in parts:
        loops = loops.union(part)
    return loops.groupBy("node").agg(F.min("component").alias("component"))


def _cycle_of(group: pd.DataFrame) -> list:
    """A cycle through the component, from its smallest node, larger successors first."""
    follows: dict = {}
    for src, dst in sorted(zip(group["src"], group["dst"], strict=True)):
        follows.setdefault(src, []).append(dst)
    start = min(follows)
    if start in follows[start] and len(follows) == 1:
        return [start]
    path, pending = [], [(start, 0)]
    while pending:
        node, depth = pending.pop()
        del path[depth:]
        if node in path:
            return path[path.index(node) :]
        path.append(node)
        pending += [(nxt, depth + 1) for nxt in follows.get(node, []) if nxt != node or len(follows) == 1]
    return [start]


def cycles(edges: DataFrame) -> DataFrame:
    """(component, size, path array): one cycle per strongly connected component.

    A component goes to one task as a whole; components are as large as the
    cycles of the graph, not as the graph.
    """
    members = materialize(strong_components(edges), "cycles")
    kind = edges.schema["src"].dataType.simpleString()
    inside = (
        edges.select("src", "dst").distinct()
        .join(members.withColumnsRenamed({"node": "src", "component": "c"}), "src")
        .join(members.withColumnsRenamed({"node": "dst", "component": "d"}), "dst")
        .where("c = d")
        .select(F.col("c").alias("component"), "src", "dst")
    )

    ship(edges.sparkSession)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        names = set(group["src"]) | set(group["dst"])
        return pd.DataFrame({"component": [group["component"].iloc[0]], "size": [len(names)], "path": [_cycle_of(group)]})

    return inside.groupBy("component").applyInPandas(one, f"component {kind}, size int, path array<{kind}>")


def unreached(population: DataFrame, live: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows of ``population`` whose ``key`` is no node of ``live``, but for those whose ``owner`` is unreached itself."""
    dead = materialize(population.join(live.select(F.col("node").alias(key)), key, "left_anti"), "dead")
    return dead.join(dead.select(F.col(key).alias(owner)).distinct(), owner, "left_anti").select(*population.columns)


def callers_of(edges: DataFrame, skip_src: DataFrame | None = None, skip_dst: DataFrame | None = None) -> DataFrame:
    """(node, uses): distinct other sources of each target; ``skip_src`` and ``skip_dst`` (node) are left out on their side."""
    e = edges.where("src <> dst")
    for end, skip in (("src", skip_src), ("dst", skip_dst)):
        if skip is not None:
            e = e.join(skip.select(F.col("node").alias(end)), end, "left_anti")
    return e.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("uses"))


def most_used(uses: DataFrame, least: int, limit: int) -> DataFrame:
    """The ``limit`` rows of (node, uses) of most uses, ``least`` at least; of equal ones those of the smaller node."""
    return uses.where(F.col("uses") >= least).orderBy(F.desc("uses"), "node").limit(limit)
