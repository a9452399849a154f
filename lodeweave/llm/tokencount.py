"""Token counts of a unigram segmentation, shared between words by a trie.

1. Documents are cut into blocks.  A block numbers its distinct words; its
   body is how often each document has each of them.  Blocks are shuffled
   once, and steps 2 and 3 both read this one shuffle.
2. The distinct words of all blocks are dealt by how they begin, so words that
   share a prefix meet, and each is inserted once in a trie for the whole
   corpus.  A node holds the forward score of its prefix: the best sum of
   piece scores over all ways to cut the prefix into pieces, and the number
   of pieces of that way.  Each prefix is scored once; a word's count is that
   of the node where it ends.  A block gets the counts of its own words back.
3. Per block the counts are summed up by document.

The trie is walked in the order of its sorted words, so that only the nodes
of the open word are held and a word may be of any length.  A frequent word
is one entry per block; long words are dealt by a longer beginning, so many
words of one beginning, addresses for instance, spread over all tasks.

Pieces and their order come from a public vocabulary; a piece of rank r has
the score -log(r + ``OFFSET``) of a Zipf distribution, since tokenizers are
not trained here.  A character of no piece is spelled in byte pieces, one per
UTF-8 byte, each scored below every other piece.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lodeweave.llm.blocks import MAX_TASKS, in_blocks, input_bytes, pack_strings, plan, squeeze, unpack_strings, unsqueeze
from lodeweave.llm.common import Batcher

PIECES = "piece_bpe_32k.model"
OFFSET = 2.7
#: Marks the begin of a word.
MARK = "▁"
#: Bytes of a word by which it is dealt: short words, and those of more than ``SHORT`` bytes.
BEGIN, SHORT, LONG_BEGIN = 4, 8, 24
#: UTF-8 bytes of text per block at least, and bytes of distinct words to bytes of input, by which hash ranges are planned.
BLOCK_BYTES, RATIO = 8 << 20, 0.4
_PIECE = 1 << 20


def default_pieces() -> dict[str, float]:
    """Piece to score from the public piece vocabulary, read on the driver."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return zipf_scores([model.id_to_piece(i) for i in plain])


def zipf_scores(pieces: list[str], offset: float = OFFSET) -> dict[str, float]:
    """Score of each piece by its place in ``pieces``."""
    return {piece: -math.log(rank + offset) for rank, piece in enumerate(pieces)}


class Forward:
    """Forward scores over one word's prefixes: lists of best score and its number of pieces."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 1.0
        #: Ends of pieces that are no piece themselves count as null: what is not here ends no piece.
        self.ends = dict.fromkeys((piece[i:] for piece in scores for i in range(len(piece))), None) | scores

    def next(self, text: str, at: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Best score and count of ``text[:at]``; ``best`` and ``count`` end with those of the prefixes before.

        Of equal scores the one with fewer pieces counts.  A character that is
        no piece by itself is spelled in bytes.
        """
        ends = self.ends
        own = ends.get(text[at - 1])
        if own is None:
            size = len(text[at - 1].encode("utf-8", "replace"))
            top, pieces = best[-1] + size * self.byte, count[-1] + size
        else:
            top, pieces = best[-1] + own, count[-1] + 1
        for length in range(2, at + 1):
            own = ends.get(text[at - length : at], 0)
            if own == 0:
                break
            if own is not None:
                value = best[-length] + own
                if value > top or (value == top and count[-length] + 1 < pieces):
                    top, pieces = value, count[-length] + 1
        return top, pieces


class Trie:
    """The trie of words given in sorted order; of its nodes only those of the open word are held."""

    def __init__(self, forward: Forward):
        self.forward, self.text, self.scored = forward, "", 0
        self.best, self.pieces = [0.0], [0]  # of each prefix of the open word, the empty one included

    def count(self, word: str) -> int:
        """The count stored at the end of ``word``; prefixes it shares with the word before are not scored again."""
        text, shared = MARK + word, 0
        most = min(len(text), len(self.text))
        if text[:most] == self.text[:most]:
            shared = most
        else:
            low, high = 0, most
            while high - low > 1:  # the longest equal beginning, by halving
                middle = (low + high) // 2
                low, high = (middle, high) if text[low:middle] == self.text[low:middle] else (low, middle)
            shared = low
        del self.best[shared + 1 :], self.pieces[shared + 1 :]
        for at in range(shared + 1, len(text) + 1):
            top, pieces = self.forward.next(text, at, self.best, self.pieces)
            self.best.append(top)
            self.pieces.append(pieces)
            self.scored += 1
        self.text = text
        return self.pieces[-1]


def counts_of(words: list[bytes], forward: Forward) -> dict[bytes, int]:
    """The count of each distinct word in UTF-8."""
    trie = Trie(forward)
    return {word: trie.count(word.decode()) for word in sorted(set(words))}


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Words of the whole text, piece by piece for long texts."""
    at, space = 0, b" \t\n\x0b\x0c\r"
    while at < len(data):
        end = at + _PIECE
        while end < len(data) and data[end] not in space:
            end += 1
        yield data[at:end].split()
        at = end


def _number_block(block: str, ids: list, texts: list[bytes]) -> Iterator[tuple]:
    numbers: dict[bytes, int] = {}
    sizes, words, counts = [], [], []
    for text in texts:
        here: Counter = Counter()
        for piece in _words(text):
            here.update(piece)
        sizes.append(len(here))
        words += [numbers.setdefault(w, len(numbers)) for w in here]
        counts += here.values()
    head = np.array([sizes, [i is not None for i in ids], [0 if i is None else i for i in ids]], np.int64).reshape(-1)
    parts = [squeeze(head), squeeze(np.array(words, np.uint32)), squeeze(np.array(counts, np.uint32)), pack_strings(list(numbers))]
    data = b"".join(len(p).to_bytes(8, "little") + p for p in parts)
    yield f"{block}-{xxhash.xxh3_128_hexdigest(data)}", data


def _parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


_BLOCK = "block string, data binary"
_BLOCK_FIELDS = pa.schema([("block", pa.string()), ("data", pa.binary())])
_PACK = "block string, range int, numbers binary, words binary"
_PACK_FIELDS = pa.schema([("block", pa.string()), ("range", pa.int32()), ("numbers", pa.binary()), ("words", pa.binary())])
_REPLY = "block string, numbers binary, counts binary"
_REPLY_FIELDS = pa.schema([("block", pa.string()), ("numbers", pa.binary()), ("counts", pa.binary())])


def token_counts(
    docs: DataFrame, scores: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, ranges: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_tokens.

    Words are runs other than 0x20 and 0x09-0x0D; each is segmented by itself
    with the mark of a word's begin before it.  Ids are whole numbers or null.
    Null and empty texts count zero.  Repeated rows and ids each get their
    row.  Other columns of ``docs`` are not read; an empty table gives an
    empty result.

    ``block_bytes`` and ``ranges`` follow from the size of ``docs`` (see
    ``blocks.plan``) unless given; neither changes the result.
    """
    scores = default_pieces() if scores is None else scores
    sent = docs.sparkSession.sparkContext.broadcast(scores)  # one entry per piece of the vocabulary
    size, wanted, tasks = plan(input_bytes(docs), BLOCK_BYTES, RATIO)
    ranges = ranges or wanted
    blocks = in_blocks(docs, id_col, text_col, _number_block, _BLOCK, _BLOCK_FIELDS, block_bytes or size).repartition(tasks, "block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(_PACK_FIELDS)
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = unpack_strings(_parts(data)[3])
                begins = (w[:BEGIN] if len(w) <= SHORT else w[:LONG_BEGIN] for w in words)
                to = np.fromiter((xxhash.xxh3_64_intdigest(b) % ranges for b in begins), np.int64, len(words))
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(ranges + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = order[cuts[k] : cuts[k + 1]]
                    row = (block, k, squeeze(np.diff(mine, prepend=0).astype(np.uint32)), pack_strings([words[i] for i in mine.tolist()]))
                    yield from out.add(row, len(row[2]) + len(row[3]))
        yield from out.flush()

    made: dict[str, Forward] = {}

    def count_range(key: tuple, group: pa.Table) -> pa.Table:
        if not made:
            made["it"] = Forward(sent.value)
        blocks, numbers = group.column("block").to_pylist(), group.column("numbers").to_pylist()
        words = [unpack_strings(w) for w in group.column("words").to_pylist()]
        once = counts_of([w for part in words for w in part], made["it"])
        counts = [squeeze(np.fromiter(map(once.__getitem__, part), np.uint32, len(part))) for part in words]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((blocks, numbers, counts), _REPLY_FIELDS, strict=True)], schema=_REPLY_FIELDS)

    replies = blocks.mapInArrow(pack, _PACK).repartition(min(ranges, MAX_TASKS), "range").groupBy("range").applyInArrow(count_range, _REPLY)
    kind = docs.schema[id_col].dataType.simpleString()
    key_type = pa.int32() if kind == "int" else pa.int64()

    def total(key: tuple, own: pa.Table, given: pa.Table) -> pa.Table:
        if own.num_rows != 1:
            raise RuntimeError("a block was made anew with other content; write the documents to a table first")
        head, words, counts, names = _parts(own.column("data")[0].as_py())
        sizes, known, keys = unsqueeze(head, "<i8").reshape(3, -1)
        words, counts = unsqueeze(words, "<u4").astype(np.int64), unsqueeze(counts, "<u4").astype(np.int64)
        tokens = np.zeros(len(unpack_strings(names)), np.int64)
        for numbers, found in zip(given.column("numbers").to_pylist(), given.column("counts").to_pylist(), strict=True):
            tokens[np.cumsum(unsqueeze(numbers, "<u4"), dtype=np.int64)] = unsqueeze(found, "<u4")
        edges = np.concatenate(([0], np.cumsum(sizes)))
        sums = [np.concatenate(([0], np.cumsum(c)))[edges] for c in (counts, counts * tokens[words])]
        ids = [k if n else None for k, n in zip(keys.tolist(), known.tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(ids, key_type), *(pa.array(np.diff(s), pa.int64()) for s in sums)], names=[id_col, "n_words", "n_tokens"])

    both = blocks.groupBy("block").cogroup(replies.repartition(tasks, "block").groupBy("block"))
    return both.applyInArrow(total, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint")
