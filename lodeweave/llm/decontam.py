"""Benchmark decontamination: a hash set of test n-grams scanned against every training window.

1. Benchmark items become windows of ``width`` words (an item of fewer words
   is one window), each with a 64-bit hash.
2. Every window of every document is hashed and looked up in the hash set,
   which is broadcast after its size was checked; beyond the bound the lookup
   is an ordinary shuffled join of hashes.  One scan serves windows of all
   lengths.
3. The documents of hits are read again and each hit window is compared word
   for word.
4. Verified windows give hit positions, hit items and the verdict.

Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import lower_ascii
from lodeweave.workspace import materialize

WIDTH = 13
#: A document is contaminated if at least this share of its words is hit: 1 in ``SHARE``.
SHARE = 20
#: Windows of the benchmark up to which their hashes (16 bytes each) are broadcast.
BROADCAST_WINDOWS = 2_000_000
#: Documents with a candidate up to which their keys (two longs each) are broadcast to pick them out.
BROADCAST_DOCS = 2_000_000

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the lower-cased text: letters, digits and all beyond ASCII."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), _NOT_WORD)
    # Only the ends can be empty.
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def scan(split: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, th, pos, length, h) of all windows of the words ``w`` of each row, of each of ``lengths``."""
    size = F.size("w")
    starts = F.sequence(F.lit(0), size - min(lengths))
    window = lambda i, n: F.xxhash64(F.slice("w", i + 1, n))
    # The outer form, since for the other one the optimizer evaluates the array once more to filter it.
    if len(lengths) == 1:
        found = F.when(size >= lengths[0], F.transform(starts, lambda i: window(i, lengths[0])))
        return split.select("id", "th", found.alias("h")).select("id", "th", F.posexplode_outer("h").alias("pos", "h")).select(
            "id", "th", "pos", F.lit(lengths[0]).alias("length"), "h"
        )
    each = lambda i: F.array(*(F.when(i + n <= size, window(i, n)) for n in lengths))
    found = split.select("id", "th", F.when(size >= min(lengths), F.transform(starts, each)).alias("h"))
    found = found.select("id", "th", F.posexplode_outer("h").alias("pos", "h")).select("id", "th", "pos", F.posexplode_outer("h").alias("k", "h"))
    return found.select("id", "th", "pos", F.element_at(F.array(*(F.lit(n) for n in lengths)), F.col("k") + 1).alias("length"), "h")


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, length, h, gram) of the benchmark; items without words have none."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w"))
    items = items.withColumn("length", F.least(F.size("w"), F.lit(width))).where("length > 0")
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("length")), lambda i: F.slice("w", i + 1, F.col("length")))
    each = items.select("item", "length", F.explode(grams).alias("g"))
    return each.select("item", "length", F.xxhash64("g").alias("h"), F.array_join("g", " ").alias("gram")).distinct()


def _covered(spans: Column) -> Column:
    """Number of positions in the union of (start, length) spans."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["pos"] + s["length"] - F.greatest(acc["end"], s["pos"]))).alias("n"),
        F.greatest(acc["end"], s["pos"] + s["length"]).alias("end"),
    )
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    share: int = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text_col: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
    broadcast_docs: int = BROADCAST_DOCS,
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_hit, n_items, items, contaminated, spans.

    ``items`` are the ids, as strings sorted as strings, of the benchmark
    items a window of which occurs in the document; ``n_hit`` counts the words
    inside such windows; ``spans`` are the (pos, length) of the windows in
    words, sorted.  Null and empty texts have no words; a document is
    contaminated if it has a hit and hits are at least 1 in ``share`` of its
    words.  Rows that repeat an id are judged each by its own text.  A null
    item id counts as an item that cannot be named: its windows hit, and it
    is not among ``items``.  An empty benchmark leaves every document clean.
    Other columns of both tables are not read.
    """
    hit = _found(docs, benchmark, width, id_col, text_col, item_col, bench_text_col, broadcast_windows, broadcast_docs)
    return hit.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.array_sort("spans").alias("spans"),
    )


def _found(
    docs: DataFrame, benchmark: DataFrame, width: int, id_col: str, text_col: str, item_col: str, bench_text_col: str, broadcast_windows: int, broadcast_docs: int
) -> DataFrame:
    """(id, th, n_words, spans, items, n_hit) per row of ``docs``; ``th`` is a hash of the text."""
    bench = materialize(benchmark_windows(benchmark, width, item_col, bench_text_col), "decontam")
    # At most ``width`` rows.
    by_length = {r["length"]: r["n"] for r in bench.groupBy("length").agg(F.countDistinct("h").alias("n")).collect()}
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), lower_ascii(text).alias("t"))
    split = text.select("id", "th", words(F.col("t")).alias("w"))
    candidates = None
    if by_length:
        wanted = bench.select("length", "h").distinct()
        if sum(by_length.values()) <= broadcast_windows:
            wanted = F.broadcast(wanted)
        candidates = scan(split, sorted(by_length)).join(wanted, ["length", "h"], "left_semi").select("id", "th", "pos", "length")
    counted = text.select("id", "th", F.size(words(F.col("t"))).cast("long").alias("n_words"))
    no_spans = F.array().cast("array<struct<pos:int,length:int>>")
    if candidates is None:
        hit = counted.withColumns({"spans": no_spans, "items": F.array().cast("array<string>")})
    else:
        per_doc = candidates.groupBy("id", "th").agg(F.collect_set(F.struct("pos", "length")).alias("c"))
        per_doc = materialize(per_doc, "decontam")
        narrowed = text
        if per_doc.count() <= broadcast_docs:
            keys = F.broadcast(per_doc.select(F.col("id").alias("__id"), F.col("th").alias("__th")))
            narrowed = text.join(keys, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left_semi")
        again = narrowed.alias("d").join(
            per_doc.alias("p").hint("merge"), F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.th") == F.col("p.th"))
        )
        again = again.select("d.id", "d.th", "p.c", words(F.col("d.t")).alias("w"))
        shown = F.transform(
            "c",
            lambda s: F.struct(
                s["pos"].alias("pos"), s["length"].alias("length"), F.array_join(F.slice("w", s["pos"] + 1, s["length"]), " ").alias("gram")
            ),
        )
        each = again.select("id", "th", F.explode(shown).alias("s")).select("id", "th", "s.pos", "s.length", "s.gram")
        verified = each.join(bench.select("item", "length", "gram"), ["length", "gram"])
        verified = verified.groupBy("id", "th").agg(
            F.collect_set(F.struct("pos", "length")).alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")
        )
        verified = materialize(verified, "decontam")
        hit = counted.alias("d").join(
            verified.alias("v").hint("merge"), F.col("d.id").eqNullSafe(F.col("v.id")) & (F.col("d.th") == F.col("v.th")), "left"
        ).select(
            "d.id", "d.th", "d.n_words", F.coalesce("v.spans", no_spans).alias("spans"), F.coalesce("v.items", F.array().cast("array<string>")).alias("items")
        )
    return hit.withColumn("n_hit", _covered(F.col("spans")).cast("long"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones; columns unchanged.  An id with a contaminated row goes with all its rows."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated")
    bad = bad.select(F.col(id_col).alias("__id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]), "left_anti")


_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    bench_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, broadcast_docs: int = BROADCAST_DOCS,
) -> DataFrame:
    """(id_col, kept) per row of ``docs`` with a hit: its text as it was, without the words inside hit windows.

    What stands between two removed words goes with them; case, marks and
    white space of the rest stay.  Rows that repeat an id are cut each by its
    own spans, and rows that repeat both id and text each get a row.
    """
    found = _found(docs, benchmark, width, id_col, text_col, item_col, bench_text_col, broadcast_windows, broadcast_docs).where("n_hit > 0")
    gone = F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["length"] - 1)))
    found = materialize(found.groupBy("id", "th").agg(F.first("spans").alias("spans")).select("id", "th", F.array_sort(F.array_distinct(gone)).alias("gone")), "decontam")
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("t"))
    both = texts.alias("d").join(found.alias("f").hint("merge"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.th") == F.col("f.th")))
    parts = both.select("d.id", "f.gone", F.regexp_extract_all("t", F.lit(_WORD), F.lit(0)).alias("w"), F.split("t", _WORD, -1).alias("gap"))
    # For each removed position as many kept ones as lie before it, then those after the last one.
    runs = F.transform("gone", lambda p, k: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get("gone", k - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
    rest = F.array_repeat(F.lit(False), F.size("w") - F.element_at("gone", -1) - 1)
    marked = parts.select("id", "w", "gap", F.concat(F.flatten(runs), rest).alias("cut"))
    piece = F.transform(
        "w",
        lambda w, i: F.when(F.get("cut", i), F.when(F.coalesce(F.get("cut", i + 1), F.lit(False)), F.lit("")).otherwise(F.get("gap", i + 1))).otherwise(F.concat(w, F.get("gap", i + 1))),
    )
    return marked.select(F.col("id").alias(id_col), F.concat(F.get("gap", F.lit(0)), F.array_join(piece, "")).alias("kept"))
