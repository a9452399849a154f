"""Exact and near copies against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

from lodeweave.llm import exact_dedup, simhash
from lodeweave.llm.common import prepare

from .conftest import corpus


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(docs):
    want = Counter()
    groups = {}
    for i, t in corpus():
        groups.setdefault(normal(t), []).append(i)
    for i, t in corpus():
        members = groups[normal(t)]
        known = [m for m in members if m is not None]
        keep = min(known) if known else None
        want[(i, keep, len(members), i == keep, hashlib.sha256(normal(t).encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(docs, salts=3).collect())
    assert got == want


def test_exact_drop_keeps_columns(docs):
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert len({normal(t) for _, t in kept}) == len({normal(t) for _, t in corpus()})
    assert (504, "other words here") in kept and all(i != 320 for i, _ in kept)


def test_exact_clash_of_digests_compares_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    def same_digest(docs, id_col, text_col):
        return docs.select(F.col(id_col).alias("id"), exact_dedup.normalized(F.col(text_col)).alias("t"), F.lit(b"x").alias("digest"))

    monkeypatch.setattr(exact_dedup, "_keyed", same_digest)
    rows = exact_dedup.exact_groups(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows} == {(1, 1, 2), (2, 2, 1), (3, 1, 2)}


def brute_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def components(fps, bits):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints_and_components(docs, spark):
    prepare(spark)
    want_fp = [(i, brute_fingerprint(t)) for i, t in corpus()]
    part = components({f for _, f in want_fp}, 2)
    least = {}
    for i, f in want_fp:
        if i is not None:
            least[part[f]] = min(i, least.get(part[f], i))
    want = Counter((i, f"{f:016x}", least.get(part[f])) for i, f in want_fp)
    assert Counter(tuple(r) for r in simhash.near_groups(docs).collect()) == want


def linked(spark, fps, bits, **options):
    signed = [simhash._signed(f) for f in fps]
    rows = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, **options).collect()
    pairs = {(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in rows}
    assert all((a ^ b).bit_count() <= bits for a, b in pairs)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    classes = {}
    for f in fps:
        classes.setdefault(find(f), set()).add(f)
    return sorted(map(sorted, classes.values()))


def test_links_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = set(base)
    for b in base[:6]:
        for _ in range(60):
            f = b
            for bit in rng.integers(0, 64, rng.integers(1, 7)):
                f ^= 1 << int(bit)
            fps.add(f)
    for bits in (1, 2):
        want = {}
        for f, c in components(fps, bits).items():
            want.setdefault(c, set()).add(f)
        want = sorted(map(sorted, want.values()))
        assert linked(spark, sorted(fps), bits, crowded=16) == want  # heavy keys take further rings
        assert linked(spark, sorted(fps), bits, segments=5, crowded=10_000) == want


def test_one_key_of_many_fingerprints(spark):
    rng = np.random.default_rng(4)
    low = rng.choice(1 << 20, 5000, replace=False)
    fps = sorted(int(x) << 40 | 0x5A5A5 for x in low)  # all share 44 bits
    member = set(fps)
    near = [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    want = {(a, a ^ d) for a in fps for d in near if a < a ^ d and a ^ d in member}
    rows = simhash.link_fingerprints(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")).collect()
    mask = (1 << 64) - 1
    assert {tuple(sorted((r["a"] & mask, r["b"] & mask))) for r in rows} == want and len(rows) == len(want) > 1000


def test_rings_cover_all_bits():
    for level in range(4):
        ring = simhash._rings(9, level)
        assert sum(ring) == (1 << 64) - 1 and all(7 <= m.bit_count() <= 8 for m in ring)


def test_open_bits_of_the_last_ring():
    fixed = {0}
    for level in range(simhash.LEVELS):
        ring = simhash._rings(simhash.SEGMENTS if level == 0 else simhash.FURTHER, level)
        exact = 4 if level == 0 else 1
        masks = [sum(ring[(k + step) % len(ring)] for step in range(exact)) for k in range(len(ring))]
        fixed = {f | m for f in fixed for m in masks}
    assert 64 - min(f.bit_count() for f in fixed) <= 12


def test_near_drop_and_empty(docs, no_docs, spark):
    prepare(spark)
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).where("doc_id is not null").collect()}
    assert {r["doc_id"] for r in left.collect() if r["doc_id"] is not None} == {i for i, c in groups.items() if i == c}
    assert simhash.near_groups(no_docs).collect() == [] and exact_dedup.exact_groups(no_docs).collect() == []
    assert simhash.drop_near_copies(no_docs).collect() == [] and exact_dedup.drop_exact_copies(no_docs).collect() == []
