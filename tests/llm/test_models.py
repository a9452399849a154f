"""The quality classifier and the field over leaf blocks: held-out accuracy, and defined results for odd input."""

import random
import zlib

import numpy as np
import pytest

from lodeweave.llm import htmltext, labelled_pages, quality
from lodeweave.llm.common import prepare


def labelled(n=500):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 80))]
        kind = i % 5
        if kind == 0:
            text = [w + "$$$" for w in text]
        elif kind == 1:
            text = [rng.choice(words)] * 30 + text[:3]
        rows.append((i, " ".join(text), int(kind > 1)))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    prepare(spark)
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (None, "abc", "x"), (1002, "long " * 60_000, "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(2000, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(scored):
    rows, docs, labels = scored
    got = quality.quality(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in [*truth, 1000, 1001, 1002] if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]
    assert sum(right) / len(right) > 0.95
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert by_id[1000] == by_id[1001] and len(by_id[3]) == 1 and len(by_id[None]) == 1


def test_held_out_labels_are_not_learned(scored, spark):
    rows, docs, labels = scored
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    same = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, flipped).score("some words") == quality.fit(docs, same).score("some words")


def test_sample_bounds_and_missing_labels(scored):
    rows, docs, labels = scored
    assert quality.fit(docs, labels.limit(0)).score("x") == 0.5
    assert quality.fit(docs, labels, max_rows=0).score("x") == 0.5
    assert quality.fit(docs, labels.union(labels), max_rows=50).score("x") == quality.fit(docs.union(docs), labels, max_rows=50).score("x")
    assert quality.fit(docs, labels.where("quality = 1")).score("x") > 0.9


def test_keep_good(scored):
    rows, docs, labels = scored
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns and left.schema["score"].dataType.simpleString() == "string"
    bad = {i for i, _, y in rows if not y}
    kept = {r["doc_id"] for r in left.collect()}
    assert len(kept & bad) < 8 and len({i for i, _, y in rows if y} - kept) < 5
    assert quality.keep_good(docs.limit(0), labels).collect() == []


def test_pieces_of_a_long_text_count_like_the_whole(monkeypatch):
    text = "aa bb cc aa aa " * 50 + "ab文c" * 50
    rows, part = quality.bag(text)
    model = quality.Model(np.random.default_rng(1).normal(0, 1, quality.BUCKETS + quality.PAIRS).astype(np.float32), 0.1)
    score = model.score(text)
    word = "ab文c" * 50
    assert len(quality.features(word)) == 1 + sum(len(word) + 2 - n + 1 for n in quality.GRAMS)
    monkeypatch.setattr(quality, "_PIECE", 17)
    monkeypatch.setattr(quality, "WORD_PIECE", 7)
    again = quality.bag(text)
    assert (again[0] == rows).all() and np.allclose(again[1], part) and model.score(text) == pytest.approx(score)
    monkeypatch.setattr(quality, "_CACHED_WORDS", 1)
    assert model.score(text) == pytest.approx(score)
    before = model.score("zz yy " + text)
    assert model.score("other words") and model.score("zz yy " + text) == before and quality.Model(model.margin, 0.1).score("zz yy " + text) == before


def test_middle_of_long_words_is_read():
    ends = "文" * 60
    clean, junk = ends + "良" * 5000 + ends, ends + "×" * 5000 + ends
    model = quality.train([quality.bag(t) for t in (clean[:4000], junk[:4000])] * 20, [1, 0] * 20)
    assert model.score(clean) > 0.7 > 0.3 > model.score(junk)


def test_folded_margin_is_the_softmax_of_the_mean():
    texts = [t for _, t, _ in labelled(60)] + ["", "one"]
    bags, labels = [quality.bag(t) for t in texts], [k % 3 > 0 for k in range(len(texts))]
    vectors, weights, bias = quality.learn(bags, list(map(int, labels)))
    model = quality.train(bags, list(map(int, labels)))
    for text in [*texts, "never seen words", "a a a a"]:
        words = text.split()
        rows = [i for w in words for i in quality.features(w)]
        mean = vectors[rows].mean(axis=0) if rows else np.zeros(quality.WIDTH)
        hashes = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
        pairs = quality.Numbers(None).pairs(hashes) + quality.BUCKETS
        mean = mean + (vectors[pairs].mean(axis=0) if len(pairs) else 0)
        z = weights @ mean + bias
        assert model.score(text) == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-4)
    assert len(set(quality.Numbers(None).pairs(np.array([5, 5, 5], np.uint64)).tolist())) == 1


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    vectors, weights, bias = rng.normal(size=(7, 4)), rng.normal(size=(2, 4)), rng.normal(size=2)
    part = rng.random(7)
    loss, by_weights, by_mean = quality.gradients(vectors, weights, bias, part, 1)
    tiny = 1e-6
    for at in np.ndindex(weights.shape):
        moved = weights.copy()
        moved[at] += tiny
        assert (quality.gradients(vectors, moved, bias, part, 1)[0] - loss) / tiny == pytest.approx(by_weights[at], abs=1e-4)
    for at in np.ndindex(vectors.shape):
        moved = vectors.copy()
        moved[at] += tiny
        assert (quality.gradients(moved, weights, bias, part, 1)[0] - loss) / tiny == pytest.approx(part[at[0]] * by_mean[at[1]], abs=1e-4)


@pytest.fixture(scope="module")
def field():
    return htmltext.default_field()


def test_field_on_pages_it_has_not_seen(field):
    wrong = total = 0
    for html, labels in labelled_pages.labelled_pages(150, seed=99):
        got = field.viterbi(htmltext.features(htmltext.leaf_blocks(html)))
        total += len(labels)
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
    assert wrong / total < 0.01


def test_viterbi_is_the_best_of_all_sequences(field):
    from itertools import product

    ids = htmltext.features(htmltext.leaf_blocks(labelled_pages.labelled_page(12)[0]))[:9]
    emit = field.emissions(ids)

    def value(y):
        return field.start[y[0]] + sum(emit[t][k] for t, k in enumerate(y)) + sum(field.pair[a][b] for a, b in zip(y, y[1:], strict=False))

    best = max(product((0, 1), repeat=len(ids)), key=value)
    assert value(tuple(field.viterbi(ids))) == pytest.approx(value(best))
    single, _ = field.marginals(emit)
    assert single.sum(axis=1) == pytest.approx([1.0] * len(ids))


PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- no -->"
    "<div class='ad'>Buy now!</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>\n  text&nbsp;here.<br>More.<p>Second one, &lt;b&gt; it is.</p></article>"
    "<div class='comments'><p>Great post!</p></div><footer>&copy; x</footer>"
)


def test_main_text(field):
    assert htmltext.main_text(PAGE, field) == "Head & line First bold text here. More. Second one, <b> it is."
    assert [b.text for b in htmltext.leaf_blocks("<p>a<span>b</span> c<div>d</div>e")] == ["ab c", "d", "e"]
    for odd in (None, "", "   ", "<", "<p", "<!--", "</div></div>", "<script>x", "&#0;", "<p>" * 2000, "<a " + "x" * 10_000, "<a " * 100_000, '<a "' * 50_001 + ">", "<!--" * 50_000, "&" * 100_000):
        assert isinstance(htmltext.main_text(odd, field), str)


@pytest.mark.parametrize("before", [
    "<datalist><option value=a>A<option value=b>B</datalist>", "<button>Menu", "<div><select><option>A<option>B</div>", "<select><option>A", "<textarea>note", "<video>old <source src=v>",
    "<canvas>none", "<svg><text>label</text>", "<object>none<button>Menu", "<audio>none", "<button><div>Menu</div></button>", "<video>old<article></article></video>", "<template><p>later</template>",
])
def test_elements_without_end_hide_no_later_text(before):
    page = f"<body><p>One.</p>{before}<article><p>Main text.</p></article><video>later</video></body>"
    assert [b.text for b in htmltext.leaf_blocks(page)] == ["One.", "Main text."]


def test_pages_without_a_wrapper(field):
    prose = ["The river rose twice in one spring and the town moved its market uphill.", "Nobody wrote down who paid for the new square, which is still uneven."]
    bare = "".join(f"<p>{p}</p>" for p in prose)
    assert htmltext.main_text(f"<html><body>{bare}</body></html>", field) == " ".join(prose)
    assert htmltext.main_text(f"<body><h1>Two floods</h1>{bare}</body>", field) == "Two floods " + " ".join(prose)
    assert htmltext.main_text(f"<p>{prose[0]}</p>", field) == htmltext.main_text(prose[0], field) == prose[0]
    page = f"<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>{bare}<div class='comments'><p>Great post!</p></div><footer>All rights reserved.</footer></body>"
    assert htmltext.main_text(page, field) == " ".join(prose)


def test_formulas_are_text():
    assert [b.text for b in htmltext.leaf_blocks("<p>So <math><mi>a</mi><mo>=</mo><mn>1</mn><annotation>a=1</annotation></math> holds.</p>")] == ["So a=1 holds."]
    assert [b.text for b in htmltext.leaf_blocks("<textarea>" * 50_000 + "<p>x")] == ["x"]


def test_extract_text(field, spark):
    prepare(spark)
    rows = [(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None), (None, "v", "", "x"), (3, "w", "<p>" + "word " * 100_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract_text(pages, field)
    assert got.columns == ["page_id", "url", "text"]
    texts = {(r["page_id"], r["url"]): r["text"] for r in got.collect()}
    assert got.count() == 5 and texts[2, None] == "" and texts[None, "v"] == "" and texts[1, "u"].startswith("Head & line")
    assert htmltext.extract_text(pages.limit(0), field).collect() == []
