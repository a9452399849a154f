"""Substring de-duplication: recurring passages, Aho-Corasick automata, and what is left of each text.

A window is ``width`` consecutive words of one document.  A word is removed
if a window over it also starts in a document with a smaller id.

1. Documents are cut into blocks, which are shuffled once; steps 2 and 4 both
   read this one shuffle.
2. Each block hashes its windows, keeps each distinct one with the smallest
   id that has it, and sends them packed, one row per hash range.
3. Per hash range the smallest id over all blocks is found, the window's owner.
   A window is confirmed as recurring if a document other than its owner has
   it.  Blocks are told the owners of those of their distinct windows that a
   document of another block had earlier.  Such an answer names windows by their rank, not by where they occur.
4. Each block joins its confirmed windows into passages: each distinct window
   is in one passage, and windows are neighbours there if they always are
   neighbours in the block and have one owner.  The passages are compiled into
   automata of bounded size, which are the shard of the corpus' passages that
   can occur in the block; all of its documents are streamed through them.
   What the automata find after a passage's owner is removed, and nothing else.

A block is named by its content, so a block that a lost executor made anew
either equals the one that asked or the job fails; over a written table it is
always equal.  A window that a third of all documents share is one entry per
block in step 2, so no range is larger than the others.  Hashes have ``DIGEST_BYTES`` bytes
(two independent sums of 64-bit word hashes); at 10 bytes two different
windows among 10^10 agree with a chance below 10^-4.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lodeweave.llm.blocks import BLOCK_BYTES, MAX_TASKS, in_blocks, input_bytes, plan, squeeze, unsqueeze
from lodeweave.llm.common import Batcher

WIDTH = 13
DIGEST_BYTES = 10
#: Longest passage, in words, that is one pattern of an automaton.
PASSAGE = 64
#: Words of all patterns of one automaton.
SHARD_WORDS = 300_000
#: Bytes of packed windows to bytes of input, by which hash ranges are planned.
RATIO = 2.5

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Documents of one block as numbered words."""

    def __init__(self, ids: list, texts: list[bytes], width: int):
        numbers: dict[bytes, int] = {}
        self.ids, self.width = ids, width
        coded = []
        for text in texts:
            found = text.split()  # of bytes: splits at 0x20 and 0x09-0x0D alone
            coded.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int32, len(found)))
        self.vocabulary = list(numbers)
        self.lengths = np.array([len(c) for c in coded], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
        self.known = np.array([i is not None for i in ids], bool)
        self.doc_ids = np.array([0 if i is None else i for i in ids], np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``flat``, document of each): starts of windows of documents that have an id."""
        owner = np.repeat(np.arange(len(self.ids)), self.lengths)
        left = self.starts[1:][owner] - np.arange(len(self.flat)) if len(owner) else np.zeros(0, np.int64)
        at = np.flatnonzero((left >= self.width) & self.known[owner]) if len(owner) else np.zeros(0, np.int64)
        return at, owner[at]

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the window at each position."""
        found = []
        for mix, seed in zip(_MIX, (11, 23), strict=True):
            each = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.vocabulary), np.uint64, len(self.vocabulary))
            each = each[self.flat] if len(each) else np.zeros(0, np.uint64)
            count = len(each) - self.width + 1
            total = np.zeros(max(count, 0), np.uint64)
            for k in range(self.width if count > 0 else 0):
                total = total * mix + each[k : k + count]
            found.append(_spread(total[at]))
        return found[0], found[1]


def _distinct(words: Words) -> tuple[np.ndarray, ...]:
    """Distinct windows of a block, sorted by hash: (high, low, smallest id, place of each window among them)."""
    at, doc = words.windows()
    high, low = words.hashes(at)
    low = (low >> np.uint64(64 - 8 * (DIGEST_BYTES - 8))).astype(np.uint16)
    order = np.lexsort((words.doc_ids[doc], low, high))
    h, x, d = high[order], low[order], words.doc_ids[doc][order]
    first = np.ones(len(order), bool)
    first[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    return h[first], x[first], d[first], place, at, doc


def _ranges(high: np.ndarray, ranges: int) -> np.ndarray:
    """Limits, in the sorted ``high``, of the hash ranges."""
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    return np.concatenate(([0], np.searchsorted(high, edges), [len(high)]))


_BODY = "block string, body binary"
_BODY_FIELDS = pa.schema([("block", pa.string()), ("body", pa.binary())])
_PACK = "block string, range int, entries binary"
_PACK_FIELDS = pa.schema([("block", pa.string()), ("range", pa.int32()), ("entries", pa.binary())])
#: An entry: step from the hash before it, low part of the hash, smallest id.
_ENTRY = np.dtype([("step", "<u8"), ("low", "<u2"), ("id", "<i8")])
_REPLY = "block string, range int, places binary, earlier binary"


def _pack_block(block: str, ids: list, texts: list[bytes]) -> Iterator[tuple]:
    sizes = np.array([len(t) for t in texts], np.int64)
    known = np.array([i is not None for i in ids], np.int64)
    numbers = np.array([0 if i is None else i for i in ids], np.int64)
    parts = [squeeze(np.concatenate((sizes, known, numbers))), squeeze(b"".join(texts))]
    body = len(parts[0]).to_bytes(8, "little") + b"".join(parts)
    yield f"{block}-{xxhash.xxh3_128_hexdigest(body)}", body


def _open_block(body: bytes) -> tuple[list, list[bytes]]:
    cut = 8 + int.from_bytes(body[:8], "little")
    head = unsqueeze(body[8:cut], "<i8")
    sizes, known, numbers = head.reshape(3, -1)
    text, ends = unsqueeze(body[cut:]), np.cumsum(sizes)
    ids = [n if k else None for n, k in zip(numbers.tolist(), known.tolist(), strict=True)]
    return ids, [text[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _neighbours(place: np.ndarray, chained: np.ndarray, known: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True for each window after which, wherever it occurs, the same confirmed window of the same owner comes, and before that always it.

    ``place`` is the number of each window, ``chained`` whether the next one
    begins a word later in the same document, ``known`` whether it is
    confirmed, ``owner`` by number.
    """
    count = len(owner)
    follows = chained & known & np.concatenate((known[1:], [False]))
    after = np.where(follows, np.concatenate((place[1:], [0])), -1)
    before = np.full(len(place), -1, np.int64)
    before[1:] = np.where(follows[:-1], place[:-1], -1)
    least, most = np.full((2, count), count, np.int64), np.full((2, count), -1, np.int64)
    for k, side in enumerate((after, before)):
        np.minimum.at(least[k], place, side)
        np.maximum.at(most[k], place, side)
    sole = (least == most) & (least >= 0)
    to = np.where(follows, after, 0)
    return follows & sole[0][place] & sole[1][to] & (owner[place] == owner[to])


def _passages(words: Words, place: np.ndarray, at: np.ndarray, doc: np.ndarray, confirmed: np.ndarray, owner: np.ndarray) -> dict[tuple, int]:
    """Patterns over word numbers, each with the owner of its windows.

    Every confirmed window lies whole in just one pattern, and a pattern
    occurs wherever one of its windows does.  Only the first occurrence of a
    window is looked at; long passages are cut into pieces of at most
    ``PASSAGE`` words.
    """
    patterns: dict[tuple, int] = {}
    if not len(at) or not confirmed.any():
        return patterns
    chained = np.zeros(len(at), bool)
    chained[:-1] = (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1])
    known = confirmed[place]
    joined = _neighbours(place, chained, known, owner)
    inner = np.zeros(len(owner), bool)  # windows that go on from another one
    inner[place[1:][joined[:-1]]] = True
    _, first = np.unique(place, return_index=True)
    starts = first[confirmed & ~inner]
    last = np.flatnonzero(~joined)
    ends = last[np.searchsorted(last, starts)]
    for begin, end, least in zip(at[starts].tolist(), (at[ends] + 1).tolist(), owner[place[starts]].tolist(), strict=True):
        for start in range(begin, end, PASSAGE - words.width + 1):
            stop = min(end, start + PASSAGE - words.width + 1)
            patterns[tuple(words.flat[start : stop + words.width - 1].tolist())] = least
    return patterns


def _automata(patterns: dict[tuple, int], code: np.ndarray) -> Iterator[ahocorasick.Automaton]:
    """Automata over ``code``-d words, each of at most ``SHARD_WORDS`` words of patterns."""
    shard, size = None, 0
    for key, owner in patterns.items():
        if shard is None:
            shard, size = ahocorasick.Automaton(ahocorasick.STORE_ANY), 0
        shard.add_word(code[list(key)].tobytes().decode("utf-32-le"), (len(key), owner))
        size += len(key)
        if size >= SHARD_WORDS:
            shard.make_automaton()
            yield shard
            shard = None
    if shard is not None:
        shard.make_automaton()
        yield shard


_FIRST = 0x100


def _letters(numbers: np.ndarray) -> np.ndarray:
    """Three-letter codes of word numbers, one row each; letters of different places differ, so matches start at words."""
    n = numbers.astype(np.uint32)
    a, b, c = n & 0x3F, (n >> 6) & 0x3F, n >> 12
    return np.stack((_FIRST + a, _FIRST + 0x40 + b, _FIRST + 0x80 + c), axis=1).astype("<u4")


def _confirmed(words: Words, least: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for each distinct window that a document of the block later than its owner has."""
    latest = np.full(len(least), -(1 << 63), np.int64)
    np.maximum.at(latest, place, words.doc_ids[doc])
    return latest > least


def _clean_block(words: Words, patterns: dict[tuple, int]) -> np.ndarray:
    """True for the words of ``flat`` that are removed: those under an occurrence of a pattern in a document later than its owner."""
    gone = np.zeros(len(words.flat) + 1, np.int64)
    if patterns:
        code = _letters(np.arange(len(words.vocabulary)))
        used = np.zeros(len(words.vocabulary), bool)
        for key in patterns:
            used[list(key)] = True
        shards = list(_automata(patterns, code))
        for k in range(len(words.ids)):
            if not words.known[k] or words.lengths[k] < words.width:
                continue
            begin, end = int(words.starts[k]), int(words.starts[k + 1])
            part, me = words.flat[begin:end], int(words.doc_ids[k])
            # Words of no pattern end every match: only stretches of other words are streamed.
            edge = np.flatnonzero(np.diff(np.concatenate(([0], used[part].astype(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a < words.width:
                    continue
                stretch = code[part[a:b]].tobytes().decode("utf-32-le")
                for shard in shards:
                    for last, (length, earliest) in shard.iter(stretch):
                        if earliest < me:
                            stop = begin + a + last // 3 + 1
                            gone[stop - length] += 1
                            gone[stop] -= 1
    return np.cumsum(gone)[:-1] > 0


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block_bytes: int | None = None, ranges: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_removed, kept_text, spans.

    ``kept_text`` is the kept words joined by one space; ``spans`` are the
    removed (start, stop) word ranges.  Ids are whole numbers.  Null and empty
    texts have no words.  Rows that repeat an id belong to one document as far
    as order goes: neither is earlier than the other.  A row without an id is
    earlier than none and later than none: it keeps its words.  Other columns
    of ``docs`` are not read; an empty table gives an empty result.

    ``block_bytes`` and ``ranges`` follow from the size of ``docs`` (see
    ``blocks.plan``) unless given; neither changes the result.  A task needs
    some 15 times the memory of a block.
    """
    size, wanted, tasks = plan(input_bytes(docs), BLOCK_BYTES, RATIO)
    ranges = ranges or wanted
    bodies = in_blocks(docs, id_col, text_col, _pack_block, _BODY, _BODY_FIELDS, block_bytes or size).repartition(tasks, "block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(_PACK_FIELDS)
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                high, low, ids, *_ = _distinct(Words(*_open_block(body.as_py()), width))
                cuts = _ranges(high, ranges)
                for k in range(ranges):
                    a, b = int(cuts[k]), int(cuts[k + 1])
                    if a < b:
                        entries = np.empty(b - a, _ENTRY)
                        entries["step"] = np.diff(high[a:b], prepend=np.uint64(0))
                        entries["low"], entries["id"] = low[a:b], ids[a:b]
                        packed = squeeze(entries)
                        yield from out.add((block, k, packed), len(packed))
        yield from out.flush()

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        blocks = group.column("block").to_pylist()
        packs = [unsqueeze(e, _ENTRY) for e in group.column("entries").to_pylist()]
        ids = [p["id"] for p in packs]
        highs, lows = [np.cumsum(p["step"], dtype=np.uint64) for p in packs], [p["low"] for p in packs]
        high, low, doc = np.concatenate(highs), np.concatenate(lows), np.concatenate(ids)
        order = np.lexsort((doc, low, high))
        h, x = high[order], low[order]
        first = np.ones(len(order), bool)
        first[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
        least = np.empty(len(order), np.int64)
        least[order] = doc[order][first][np.cumsum(first) - 1]
        rows, start = ([], [], [], []), 0
        for block, own in zip(blocks, ids, strict=True):
            earlier = least[start : start + len(own)]
            start += len(own)
            places = np.flatnonzero(earlier < own)
            if len(places):
                for column, value in zip(rows, (block, key[0].as_py(), squeeze(np.diff(places, prepend=0)), squeeze(earlier[places])), strict=True):
                    column.append(value)
        return pa.table({"block": pa.array(rows[0], pa.string()), "range": pa.array(rows[1], pa.int32()), "places": pa.array(rows[2], pa.binary()), "earlier": pa.array(rows[3], pa.binary())})

    replies = bodies.mapInArrow(pack, _PACK).repartition(min(ranges, MAX_TASKS), "range").groupBy("range").applyInArrow(merge, _REPLY)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = pa.schema(
        [(id_col, pa.int32() if kind == "int" else pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
         ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
    )

    def clean(key: tuple, own: pa.Table, given: pa.Table) -> pa.Table:
        if own.num_rows != 1:
            raise RuntimeError("a block was made anew with other content; write the documents to a table first")
        ids, texts = _open_block(own.column("body")[0].as_py())
        words = Words(ids, texts, width)
        high, _, least, place, at, doc = _distinct(words)
        cuts = _ranges(high, ranges)
        for r in given.to_pylist():
            least[cuts[r["range"]] + np.cumsum(unsqueeze(r["places"], "<i8"))] = unsqueeze(r["earlier"], "<i8")
        patterns = _passages(words, place, at, doc, _confirmed(words, least, place, doc), least)
        gone = _clean_block(words, patterns)
        out: tuple[list, ...] = ([], [], [], [], [])
        for k in range(len(ids)):
            begin, end = int(words.starts[k]), int(words.starts[k + 1])
            lost = gone[begin:end]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], lost.astype(np.int8), [0])))).tolist()
            kept = b" ".join(words.vocabulary[w] for w in words.flat[begin:end][~lost].tolist())
            spans = [{"start": a, "stop": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            for column, value in zip(out, (ids[k], end - begin, int(lost.sum()), kept.decode("utf-8", "replace"), spans), strict=True):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, fields, strict=True)], schema=fields)

    result = f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_text string, spans array<struct<start:int,stop:int>>"
    return bodies.groupBy("block").cogroup(replies.repartition(tasks, "block").groupBy("block")).applyInArrow(clean, result)
