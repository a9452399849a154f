"""Byte-level BPE over distinct pre-tokens: encode each once, join back, decode by table.

1. Documents are cut into blocks.  A block numbers its distinct pre-tokens by
   frequency; its body is each document's sequence of numbers, that is its
   pre-tokens with their positions.  Blocks are shuffled once, and steps 2
   and 3 both read this one shuffle.
2. The distinct pre-tokens of all blocks are shuffled by hash, and each is
   encoded once for the whole corpus.  A block gets the ids of its own back.
3. Per block the ids take the place of the numbers, in order of position.

A frequent word is one entry per block, so no hash range is larger than the
others.  A block is named by its content, so a block that a lost executor made
anew either equals the one that asked for ids or the job fails; over a written
table it is always equal.  Decoding joins ids with the table of token bytes, which has one row
per token of the vocabulary and is broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame

from lodeweave.llm.blocks import in_blocks, input_bytes, pack_strings, plan, squeeze, unpack_strings, unsqueeze
from lodeweave.llm.common import Batcher
from lodeweave.workspace import ship

RANKS = "byte_bpe_multi_50k.tiktoken"
#: UTF-8 bytes of text per block at least, and bytes of distinct pre-tokens to bytes of input, by which hash ranges are planned.
BLOCK_BYTES, RATIO = 8 << 20, 0.4
#: What an id without a token decodes to.
REPLACEMENT = "�".encode()


def default_vocabulary() -> tuple[dict[bytes, int], str]:
    """(ranks, pattern) of the public tokenizer files, read on the driver."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _number_block(pattern: str, block: str, ids: list, texts: list[bytes]) -> Iterator[tuple]:
    match, numbers, coded = regex.compile(pattern), {}, []
    for text in texts:
        found = (m.group() for m in match.finditer(text.decode("utf-8", "replace")))
        coded.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in found), np.int64))
    flat = np.concatenate(coded) if coded else np.zeros(0, np.int64)
    order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
    rank = np.empty(len(numbers), np.int64)
    rank[order] = np.arange(len(numbers))
    tokens = list(numbers)
    head = [[len(c) for c in coded], [i is not None for i in ids], [0 if i is None else i for i in ids]]
    head = squeeze(np.array(head, np.int64).reshape(-1))
    body = len(head).to_bytes(8, "little") + head + squeeze(rank[flat].astype(np.uint32))
    vocabulary = pack_strings([tokens[i].encode("utf-8", "replace") for i in order.tolist()])
    name = f"{block}-{xxhash.xxh3_128_hexdigest(body + vocabulary)}"
    yield name, len(body).to_bytes(8, "little") + body + vocabulary


def _parts(data: bytes) -> tuple[bytes, bytes]:
    """(body, vocabulary) of a block."""
    cut = 8 + int.from_bytes(data[:8], "little")
    return data[8:cut], data[cut:]


def _open_body(body: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """(pre-tokens of each document, ids, numbers)."""
    cut = 8 + int.from_bytes(body[:8], "little")
    lengths, known, keys = unsqueeze(body[8:cut], "<i8").reshape(3, -1)
    return lengths, [k if n else None for k, n in zip(keys.tolist(), known.tolist(), strict=True)], unsqueeze(body[cut:], "<u4")


_BLOCK = "block string, data binary"
_BLOCK_FIELDS = pa.schema([("block", pa.string()), ("data", pa.binary())])
_PACK = "block string, range int, numbers binary, tokens binary"
_PACK_FIELDS = pa.schema([("block", pa.string()), ("range", pa.int32()), ("numbers", pa.binary()), ("tokens", pa.binary())])
_REPLY = "block string, numbers binary, counts binary, ids binary"
_REPLY_FIELDS = pa.schema([("block", pa.string()), ("numbers", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int] | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """(id_col, ids array<int>) per row of ``docs``, without special tokens.

    Each match of ``pattern`` is encoded by itself, however long it is.  Ids
    of rows are whole numbers or null; null text is empty and has no ids.
    Rows that repeat an id each get a row.  Other columns of ``docs`` are not
    read; an empty table gives an empty result.

    ``block_bytes`` and ``ranges`` follow from the size of ``docs`` (see
    ``blocks.plan``) unless given; neither changes the result.
    """
    if ranks is None or pattern is None:
        ranks, pattern = default_vocabulary()
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # one entry per token of the vocabulary
    number = lambda block, ids, texts: _number_block(pattern, block, ids, texts)
    size, wanted, tasks = plan(input_bytes(docs), BLOCK_BYTES, RATIO)
    ranges = ranges or wanted
    blocks = in_blocks(docs, id_col, text_col, number, _BLOCK, _BLOCK_FIELDS, block_bytes or size).repartition(tasks, "block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(_PACK_FIELDS)
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = unpack_strings(_parts(data)[1])
                to = np.fromiter((xxhash.xxh3_64_intdigest(t) % ranges for t in tokens), np.int64, len(tokens))
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(ranges + 1))
                for k in range(ranges):
                    mine = order[cuts[k] : cuts[k + 1]]
                    if len(mine):
                        row = (block, k, squeeze(np.diff(mine, prepend=0).astype(np.uint32)), pack_strings([tokens[i] for i in mine.tolist()]))
                        yield from out.add(row, len(row[2]) + len(row[3]))
        yield from out.flush()

    made: dict[str, tiktoken.Encoding] = {}

    def encode_range(key: tuple, group: pa.Table) -> pa.Table:
        if not made:
            made["it"] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        # Bytes of one match, not text: it is not matched again, which a very long run of white space would not survive.
        one, once = made["it"]._encode_single_piece, {}
        columns: tuple[list, ...] = ([], [], [], [])
        for block, numbers, data in zip(*(group.column(c).to_pylist() for c in ("block", "numbers", "tokens")), strict=True):
            mine = []
            for token in unpack_strings(data):
                found = once.get(token)
                if found is None:
                    found = once[token] = one(token)
                mine.append(found)
            counts = np.fromiter(map(len, mine), np.uint32, len(mine))
            flat = np.fromiter((i for ids in mine for i in ids), np.uint32, int(counts.sum()))
            for column, value in zip(columns, (block, numbers, squeeze(counts), squeeze(flat)), strict=True):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REPLY_FIELDS, strict=True)], schema=_REPLY_FIELDS)

    replies = blocks.mapInArrow(pack, _PACK).repartition(min(ranges, tasks), "range").groupBy("range").applyInArrow(encode_range, _REPLY)
    kind = docs.schema[id_col].dataType.simpleString()
    key_type = pa.int32() if kind == "int" else pa.int64()

    def reassemble(key: tuple, own: pa.Table, given: pa.Table) -> pa.Table:
        if own.num_rows != 1:
            raise RuntimeError("a block was made anew with other content; write the documents to a table first")
        body = _parts(own.column("data")[0].as_py())[0]
        columns = [given.column(c).to_pylist() for c in ("numbers", "counts", "ids")]
        numbers = [np.cumsum(unsqueeze(n, "<u4"), dtype=np.int64) for n in columns[0]]
        counts = [unsqueeze(n, "<u4").astype(np.int64) for n in columns[1]]
        ids = [unsqueeze(n, "<u4").astype(np.int32) for n in columns[2]]
        lengths, keys, sequence = _open_body(body)
        if len(sequence):
            number, count, flat = np.concatenate(numbers), np.concatenate(counts), np.concatenate(ids)
            begins = np.empty(len(number), np.int64)
            sizes = np.empty(len(number), np.int64)
            begins[number], sizes[number] = np.cumsum(count) - count, count
            size = sizes[sequence]
            ends = np.cumsum(size)
            within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
            tokens = flat[np.repeat(begins[sequence], size) + within]
            total = np.concatenate(([0], ends))
        else:
            tokens, total = np.zeros(0, np.int32), np.zeros(1, np.int64)
        offsets = total[np.concatenate(([0], np.cumsum(lengths)))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens, pa.int32()))
        return pa.Table.from_arrays([pa.array(keys, key_type), lists], names=[id_col, "ids"])

    return blocks.groupBy("block").cogroup(replies.repartition(tasks, "block").groupBy("block")).applyInArrow(reassemble, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int] | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with a column ``out_col``: the bytes of its ids (null for null)."""
    if ranks is None:
        ranks, _ = default_vocabulary()
    sent = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    names = encoded.columns
    at = names.index(ids_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = sent.value.get
        for batch in batches:
            found = [
                None if not ids.is_valid else b"".join([token(i, REPLACEMENT) for i in ids.values.to_numpy(zero_copy_only=False).tolist()])
                for ids in batch.column(at)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*names, out_col])

    ship(encoded.sparkSession)
    return encoded.mapInArrow(run, f"{fields}, `{out_col}` binary")
