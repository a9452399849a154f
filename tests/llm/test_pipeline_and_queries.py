"""The pipeline against its stages done by hand, and the registered queries against DuckDB."""

import hashlib
import os
import re

import pytest

from lodeweave.llm import quality
from lodeweave.llm.common import table

from .test_exact_and_near import brute_fingerprint, components
from .test_passages import brute_contamination

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


def test_pipeline(spark):
    import tiktoken

    import corpus_pipeline
    from lodeweave.llm import bpe

    docs = table(spark, SMALL, "documents")
    model = quality.fit(docs, table(spark, SMALL, "labels"))
    kept = {r["doc_id"]: r["text"] for r in docs.collect() if model.score(r["text"]) >= 0.7}
    first = {}
    for i, t in sorted(kept.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    kept = {i: kept[i] for i in first.values()}
    fps = {i: brute_fingerprint(t) for i, t in kept.items()}
    part, least = components(set(fps.values()), 2), {}
    for i, f in fps.items():
        least[part[f]] = min(i, least.get(part[f], i))
    kept = {i: t for i, t in kept.items() if least[part[fps[i]]] == i}
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    clean = {k[0] for k in brute_contamination(list(kept.items()), items) if not k[5]}
    ranks, pattern = bpe.default_vocabulary()
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i in clean:
        ids = library.encode_ordinary(kept[i] or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((kept[i] or "").encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()} == want and want


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op3_decontamination", "op7_exact_dedup", "op9_warc"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from lodeweave.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        path = f"{SMALL}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = queries.queries()[name](spark, SMALL)
    want = con.sql(queries.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.select(*order).collect()), key=key) == sorted(want.select(", ".join(order)).fetchall(), key=key)


def test_page_text(spark):
    from lodeweave.llm import queries

    def article(html):
        import html as entities

        body = html.split("<article>")[1].split("</article>")[0]
        return " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", body)).split())

    truth = {r["page_id"]: article(r["html"]) for r in table(spark, SMALL, "pages").collect()}
    rows = queries.queries()["op10_html_text"](spark, SMALL).collect()
    assert {r["page_id"]: r["text"] for r in rows} == truth and all(r["n_chars"] == len(r["text"]) for r in rows)
