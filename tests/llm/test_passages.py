"""Repeated passages and benchmark windows against brute force."""

import re
from collections import Counter

from lodeweave.llm import blocks, decontam, substring
from lodeweave.llm.common import prepare

from .conftest import corpus


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_repeats(rows, width=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if i is not None:
                first[g] = min(i, first.get(g, i))
    out = Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    return out


def test_repeats(docs, no_docs, spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    rows = substring.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows) == brute_repeats(corpus())
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in rows)
    assert substring.remove_repeats(no_docs).collect() == []


def test_repeats_of_nested_and_partial_passages(spark):
    prepare(spark)
    w = [f"w{i}" for i in range(200)]
    texts = [w[:60], w[30:140], ["q"] + w[20:100] + ["r"], w[5:17], ["a"] * 40, ["b"] + ["a"] * 25, w[100:113], w[:13] * 3]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute_repeats(rows)


def test_automata_decide(spark, monkeypatch):
    prepare(spark)
    w = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate([w, w[10:50], ["x"] + w[5:30] + ["y"], w[20:60] * 2])]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(table).collect()) == brute_repeats(rows)
    words = substring.Words([0, 1, 2], [t.encode() for _, t in rows[:3]], 13)
    _, _, least, place, at, doc = substring._distinct(words)
    patterns = substring._passages(words, place, at, doc, substring._confirmed(words, least, place, doc), least)
    windows = [key[i : i + 13] for key in patterns for i in range(len(key) - 12)]
    assert len(windows) == len(set(windows)) == 33  # those that start at words 5 to 37, each in one passage
    assert set(patterns.values()) == {0} and substring._clean_block(words, {}).sum() == 0
    one = dict([next(iter(patterns.items()))])
    assert 0 < substring._clean_block(words, one).sum() < substring._clean_block(words, patterns).sum()


def test_random_passages_in_small_blocks(spark, monkeypatch):
    import random

    prepare(spark)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 5)
    rng = random.Random(8)
    pool = [[rng.choice("abcd") * rng.randint(1, 3) for _ in range(rng.randint(10, 150))] for _ in range(6)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(pool)
            a = rng.randint(0, len(part) - 1)
            text += part[a : a + rng.randint(1, 120)] + [f"u{rng.randint(0, 3)}"] * rng.randint(0, 30)
        rows.append((rng.randint(0, 50), " ".join(text)))
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ranges=3).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute_repeats(rows)


def bench_words(t):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_contamination(rows, items, width=13):
    grams = {}
    for item, t in items:
        w = bench_words(t)
        n = min(len(w), width)
        for k in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = Counter()
    for i, t in rows:
        w = bench_words(t)
        hit, named = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    named |= grams[tuple(w[k : k + n])]
        named = sorted(str(x) for x in named if x is not None)
        out[(i, len(w), len(hit), len(named), ",".join(named), bool(hit) and 20 * len(hit) >= len(w))] += 1
    return out


def items():
    rows = corpus()
    by_id = dict(rows)
    return [(1, by_id[400][:900]), (2, by_id[9].upper()), (10, "ß ß ß"), (3, None), (4, ""), (5, "!!"), (None, by_id[205]), (6, "word"), (6, "other words")]


def test_contamination(docs, no_docs, spark):
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items()], "item_id long, text string, w double")
    want = brute_contamination(corpus(), items())
    for bound in (1 << 20, 0):  # broadcast and shuffled lookup
        got = decontam.contamination(docs, bench, broadcast_windows=bound, broadcast_docs=bound).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in got) == want
    assert decontam.contamination(no_docs, bench).collect() == []
    clean = decontam.contamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(corpus()) and not any(r["contaminated"] for r in clean)


def test_drop_and_remove(docs, spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    bad = {k[0] for k in brute_contamination(corpus(), items()) if k[5]}
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, _ in corpus()} - bad
    kept = {r["doc_id"]: r["kept"] for r in decontam.remove_spans(docs, bench).where("doc_id is not null").collect()}
    assert bench_words(kept[205]) == [] and bench_words(kept[9]) == [] and len(kept[400]) < len(dict(corpus())[400])


def test_removed_spans_leave_the_rest_as_it_was(spark):
    hit = "Alpha, beta; GAMMA (delta) e1 e2 e3 e4 e5 e6 e7 e8 e9"
    rows = [(1, f"Before -- {hit.upper()}!  After\n it."), (1, f"Twice {hit}. {hit} Done"), (1, f"Twice {hit}. {hit} Done"), (2, "Clean Text"), (None, hit), (3, "short ITEM, short"), (4, None)]
    bench = spark.createDataFrame([(1, hit), (2, "item")], "item_id long, text string")
    got = decontam.remove_spans(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "Before -- !  After\n it."), (1, "Twice  Done"), (1, "Twice  Done"), (None, ""), (3, "short , short")])
