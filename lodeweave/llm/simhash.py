"""SimHash near-duplicates: 64-bit fingerprints linked by pigeonring filtering.

A fingerprint is cut into ``segments`` pieces laid on a ring.  If two
fingerprints differ in at most T bits in all, then from some piece on every
chain of l consecutive pieces differs in at most floor(l * T / segments) bits
(the pigeonring principle).  The longest chain whose budget is zero must
agree exactly and serves as the join key; longer chains are checked against
their budgets, and only what passes them gets the full Hamming check.

The principle holds for any way to cut, so where many fingerprints share a
key they are cut once more, into ``FURTHER`` pieces of other bits: the key is
then that chain and an exact chain of the second ring, and so on until few
share one.  ``LEVELS`` rings leave at most 12 bits open, so no key has more
than 4,096 members.

Only distinct fingerprints are linked, so copies cost nothing, and a
fingerprint has at most 2,080 others within two bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.components import connected_components
from lodeweave.workspace import materialize, ship

BITS = 64
SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Pieces of a ring: of nine, four in a row agree, which is a key of 28 bits.
SEGMENTS = 9
#: Pieces of further rings, and rings in all.  Three pieces fix a third of the open bits for three rows a fingerprint.
FURTHER, LEVELS = 3, 6
#: Fingerprints under one key beyond which it is joined with a chain of a further ring.
CROWDED = 256

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PIECE = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of the ``width``-word shingles of the whole text, zero if it has no word."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[min(width, len(words)) - 1 :].tolist()
    starts = starts.tolist()
    hashed, view = xxhash.xxh64_intdigest, memoryview(flat)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(ends), _PIECE):
        part = [hashed(view[s:e], SEED) for s, e in zip(starts[at : at + _PIECE], ends[at : at + _PIECE], strict=False)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    on = 2 * ones > len(ends)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): the fingerprint of each row's whole text as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.array([fingerprint(texts[i].as_py()) for i in range(len(texts))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _rings(segments: int, level: int) -> list[int]:
    """Bit masks of the pieces of the ring of a level, as even as the division allows: neighbouring bits, then ever other ones."""
    order = range(BITS) if level == 0 else np.random.default_rng(level).permutation(BITS).tolist()
    masks = [0] * segments
    for at, bit in enumerate(order):
        masks[at * segments // BITS] |= 1 << bit
    return masks


def _distance(mask: int | Column) -> Column:
    mask = F.lit(_signed(mask)) if isinstance(mask, int) else mask
    return F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")).bitwiseAND(mask))


def _chains(ring: list[int], budgets: list[int]) -> list[list[tuple[int, int]]]:
    """For each piece the (mask, budget) of the chains that begin there and are not part of the key."""
    found = []
    for first in range(len(ring)):
        mask, chains = 0, []
        for length, budget in enumerate(budgets, 1):
            mask |= ring[(first + length - 1) % len(ring)]
            if budget and length < len(ring):
                chains.append((mask, budget))
        found.append(chains)
    return found


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """(a, b) for every pair of fingerprints within ``max_bits``, a < b.

    A key of the first ring that more than ``crowded`` fingerprints share is
    joined by keys of further rings; the pairs are the same for any bound.
    ``fps`` has one row per distinct fingerprint in column ``fp``.
    ``max_bits`` may be 0 (no links), 1 or 2.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    if segments <= max_bits:
        raise ValueError("there must be more segments than bits that may differ")
    if not max_bits:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    # ``fixed``: the bits of the key; ``path``: which chain of each ring they are, which tells keys of other bits apart.
    left = fps.select("fp", F.lit("").alias("path"), F.lit(0).cast("bigint").alias("fixed"))
    pairs = None
    for level in range(LEVELS):
        ring = _rings(segments if level == 0 else FURTHER, level)
        segments = len(ring)
        budgets = [length * max_bits // segments for length in range(1, segments + 1)]
        exact = sum(1 for b in budgets if b == 0)
        masks = [sum(ring[(first + step) % segments] for step in range(exact)) for first in range(segments)]
        probes = F.array(*(F.struct(F.lit(i).alias("first"), F.col("fixed").bitwiseOR(F.lit(_signed(m))).alias("fixed")) for i, m in enumerate(masks)))
        keyed = left.select("fp", "path", F.explode(probes).alias("p"))
        keyed = keyed.select(
            "fp", F.concat_ws(".", "path", F.col("p.first").cast("string")).alias("path"), F.col("p.first").alias("first"), F.col("p.fixed").alias("fixed"),
            F.col("fp").bitwiseAND(F.col("p.fixed")).alias("key"),
        )
        keyed = materialize(keyed, "ring")
        shared = materialize(keyed.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1"), "ring")
        over = (F.col("n") > crowded) if level + 1 < LEVELS else F.lit(False)
        many = shared.where(over).select("path", "key")
        few = materialize(keyed.join(shared.where(~over).select("path", "key"), ["path", "key"], "left_semi"), "ring")
        a, b = few.alias("a"), few.alias("b")
        passes = F.lit(False)
        for first, chains in enumerate(_chains(ring, budgets)):
            holds = F.col("a.first") == first
            for mask, budget in chains:
                holds = holds & (_distance(mask) <= budget)
            passes = passes | holds
        found = a.join(
            b,
            (F.col("a.path") == F.col("b.path")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & passes
            & (_distance((1 << BITS) - 1) <= max_bits),
        ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
        pairs = found if pairs is None else pairs.union(found)
        if many.isEmpty():
            break
        left = keyed.join(many, ["path", "key"], "left_semi").select("fp", "path", "fixed")
    return pairs.distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """One row per row of ``docs``: id_col, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id that links reach, the row's own
    included.  Null and empty texts have fingerprint zero and are linked like
    any other.  Rows that repeat an id each get a row.  A null id has its
    fingerprint and, unless the component has another row, a null component.
    Other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    each = materialize(fingerprints(docs, id_col, text_col), "simhash")
    distinct = materialize(each.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash")
    linked = connected_components(link_fingerprints(distinct.select("fp"), max_bits, segments), "a", "b")
    of = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    of = materialize(of, "simhash")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    mapping = materialize(of.join(least, "component").select("fp", "component_id"), "simhash")
    return each.join(mapping, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest id; columns unchanged."""
    groups = near_groups(docs, id_col, text_col)
    dropped = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__id")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["__id"], "left_anti")
