"""BPE against tiktoken, unigram counts against a plain dynamic program."""

import re

import pytest

from lodeweave.llm import blocks, bpe, tokencount
from lodeweave.llm.common import prepare

from .conftest import corpus


def test_round_trip_as_the_library(docs, no_docs, spark, monkeypatch):
    import tiktoken

    prepare(spark)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 9)
    ranks, pattern = bpe.default_vocabulary()
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = [(r["doc_id"], r["ids"], bytes(r["decoded"])) for r in bpe.decode(bpe.encode(docs, ranks, pattern), ranks).collect()]
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in corpus()]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert bpe.encode(no_docs).collect() == []


def test_decode_of_odd_ids(spark):
    rows = spark.createDataFrame([(1, [0, 10**9]), (2, None), (3, [])], "doc_id long, ids array<int>")
    ranks, _ = bpe.default_vocabulary()
    first = next(t for t, r in ranks.items() if r == 0)
    found = {r["doc_id"]: r["decoded"] for r in bpe.decode(rows, ranks).collect()}
    assert bytes(found[1]) == first + bpe.REPLACEMENT and found[2] is None and bytes(found[3]) == b""


def test_very_long_runs(spark):
    prepare(spark)
    ranks, _ = bpe.default_vocabulary()
    texts = ["x" + " " * 1_000_000 + "y", " " * 10_000_000, "\n" * 300_000 + "a", "ab" * 200_000, "=" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(bpe.encode(rows, block_bytes=1 << 20), ranks).select("doc_id", "decoded").collect()}
    assert [found[i] for i in range(len(texts))] == texts


def test_plan_grows_with_the_input():
    last = (0, 0, 0)
    for total in (0, 1 << 20, 1 << 30, 1 << 36, 100 << 40):
        now = blocks.plan(total, 3 << 20, 2.5)
        assert all(a >= b for a, b in zip(now, last, strict=True))
        last = now
    assert last[0] == blocks.MAX_BLOCK_BYTES and 2.5 * last[0] / last[1] >= 511


def plain_count(word, scores):
    text, best = tokencount.MARK + word, [(0.0, 0)]
    byte = min(scores.values()) - 1.0
    for at in range(1, len(text) + 1):
        tried = []
        for length in range(1, min(20, at) + 1):
            piece, (value, n) = text[at - length : at], best[at - length]
            if piece in scores:
                tried.append((value + scores[piece], -(n + 1)))
            elif length == 1:
                size = len(piece.encode())
                tried.append((value + size * byte, -(n + size)))
        value, n = max(tried)
        best.append((value, -n))
    return best[-1][1]


@pytest.fixture(scope="module")
def scores():
    return tokencount.default_pieces()


def test_counts(docs, no_docs, spark, scores):
    prepare(spark)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_tokens"]) for r in tokencount.token_counts(docs, scores).collect())
    memo = {}
    want = []
    for i, t in corpus():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for w in words:
            if w not in memo:
                memo[w] = plain_count(w, scores)
        want.append((i is None, i or 0, len(words), sum(memo[w] for w in words)))
    assert got == sorted(want)
    assert tokencount.token_counts(no_docs, scores).collect() == []


def test_trie_scores_each_prefix_once(scores):
    forward = tokencount.Forward(scores)
    trie = tokencount.Trie(forward)
    words = sorted(["alpha", "beta", "alphabet", "gamma", "日本", "alphas", "al", "日本語", "running", "runner", "runs", "x" * 5000, "x" * 5000 + "y", "x" * 4000])
    for w in words:
        assert trie.count(w) == plain_count(w, scores)
    prefixes = {(tokencount.MARK + w)[:k] for w in words for k in range(1, len(w) + 2)}
    assert trie.scored == len(prefixes)
    assert tokencount.counts_of([w.encode() for w in words + words], forward) == {w.encode(): plain_count(w, scores) for w in words}


def test_a_very_long_word_is_counted(spark, scores):
    rows = spark.createDataFrame([(1, "ab" * 150_000), (2, "ab" * 150_000 + "c ab"), (3, "http://example.org/" + "a" * 50)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(rows, scores, block_bytes=10).collect()}
    assert found[1] == plain_count("ab" * 150_000, scores) and found[2] == plain_count("ab" * 150_000 + "c", scores) + plain_count("ab", scores)


def test_ties_count_fewer_pieces():
    scores = {"▁": -1.0, "a": -1.0, "▁a": -2.0}
    assert tokencount.counts_of([b"a"], tokencount.Forward(scores)) == {b"a": 1}
