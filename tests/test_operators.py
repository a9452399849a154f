"""Graph and name-join operators against plain Python on random input."""

import random

import pytest

from lodeweave.operators.components import connected_components
from lodeweave.operators.fusion import first_by, fuse
from lodeweave.operators.graph import closure, cycles, pair_closure, reachable, strong_components
from lodeweave.operators.joins import longest_prefix_join, prefix_semi_join, unique_suffix_join


def table(spark, pairs, columns="src long, dst long"):
    return spark.createDataFrame(pairs, columns)


def bfs(pairs, roots, cap=None):
    follows = {}
    for a, b in pairs:
        follows.setdefault(a, set()).add(b)
    depth, level = dict.fromkeys(roots, 0), set(roots)
    d = 0
    while level and (cap is None or d < cap):
        d += 1
        level = {b for a in level for b in follows.get(a, ())} - set(depth)
        depth |= dict.fromkeys(level, d)
    return depth


@pytest.mark.parametrize("seed", [1, 2])
def test_closure(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    e = table(spark, pairs)
    for roots, cap in (([3], None), ([1, 2], 2), ([99], None), ([4], 0)):
        want = bfs(pairs, roots, cap)
        both = [closure(e, table(spark, [(r,) for r in roots], "node long"), cap, local_edges=n).collect() for n in (0, None)]
        assert sorted(both[0]) == sorted(both[1])
        assert {r["node"]: r["depth"] for r in both[0]} == {n: d for n, d in want.items() if d}
        for r in both[0]:
            assert r["via"] == min(a for a, b in pairs if b == r["node"] and want.get(a) == r["depth"] - 1)
    assert {r["node"] for r in reachable(e, table(spark, [(1,)], "node long"), table(spark, [(1, 77)])).collect()} == set(bfs([*pairs, (1, 77)], [1]))


def test_pairs_and_strong_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(14), rng.randrange(14)) for _ in range(20)] + [(20, 20), (21, 22), (22, 21), (30, 31)]
    reach = {(a, b) for a in range(40) for b in bfs(pairs, {y for x, y in pairs if x == a})}
    e = table(spark, pairs)
    assert {(r["node"], r["ancestor"]) for r in pair_closure(e).collect()} == reach
    on_cycle = {a for a, b in reach if a == b}
    want = {a: min(b for b in on_cycle if (a, b) in reach and (b, a) in reach) for a in on_cycle}
    for bound in (0, 8, None):
        assert {r["node"]: r["component"] for r in strong_components(e, local_edges=bound).collect()} == want
    for r in cycles(e).collect():
        path = r["path"]
        assert all((a, b) in pairs for a, b in zip(path, [*path[1:], path[0]], strict=True)) and r["size"] == sum(c == r["component"] for c in want.values())
    assert strong_components(e.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200), (None, 5)]
    both = [(a, b) for a, b in pairs if a is not None] + [(b, a) for a, b in pairs if a is not None]
    want = {a: min(bfs(both, [a])) for a, _ in both}
    for bound in (0, 1000):
        assert {r["node"]: r["component"] for r in connected_components(table(spark, pairs), "src", "dst", local_edges=bound).collect()} == want
    assert connected_components(table(spark, []), "src", "dst").collect() == []


def test_name_joins(spark):
    ids = table(spark, [("alice.main.models",), ("bob.views",), ("carl.views",), ("views",), ("a.b.c",)], "id string")
    left = table(spark, [(1, "main.models"), (2, "views"), (3, "nope"), (4, "alice.main.models.get.x"), (5, None), (6, "a.b"), (7, "odels")], "k long, name string")
    got = {r["k"]: r["hit"] for r in unique_suffix_join(left, "name", ids, "id", "hit").collect()}
    assert got == {1: "alice.main.models", 2: "views", 3: None, 4: None, 5: None, 6: None, 7: None}
    assert {r["k"] for r in prefix_semi_join(left, "name", ids, "id", "inside").where("inside").collect()} == {2, 6}
    got = {r["k"]: r["hit"] for r in longest_prefix_join(left, "k", "name", ids, "id", "hit").collect()}
    assert got[4] == "alice.main.models" and got[2] == "views" and got[1] is None and len(got) == 7


def test_fusion_and_first(spark):
    s, o = table(spark, [(1, 1), (1, 1), (2, 2)]), table(spark, [(2, 2), (3, 3)])
    assert {(r["src"], r["label"]) for r in fuse(s, o, ["src", "dst"]).collect()} == {(1, "predicted"), (2, "confirmed"), (3, "observed")}
    rows = table(spark, [(1, 5), (1, 3), (2, 4)])
    assert {tuple(r) for r in first_by(rows, ["src"], [rows["dst"]]).collect()} == {(1, 3), (2, 4)}
