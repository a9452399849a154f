"""Blocks: bounded groups of whole documents.

An operator that has to look at the corpus twice (first to gather, then to
apply what was learned) works on blocks.  What a block learns or asks for is
pre-aggregated over the block, so a word or passage that a third of all
documents hold appears once per block and not once per occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lodeweave.workspace import ship

#: UTF-8 bytes of text per block; a longer document is a block of its own.
BLOCK_BYTES = 3 << 20
BLOCK_ROWS = 20_000
#: Largest block that ``plan`` asks for, and bytes of what blocks send that it deals to one hash range and of bodies to one task.
MAX_BLOCK_BYTES, RANGE_BYTES, TASK_BYTES = 128 << 20, 8 << 20, 16 << 20
#: Fewest bytes that a block should send to one hash range, and most tasks of a shuffle.
_ROW_BYTES, MAX_TASKS = 512, 50_000


def input_bytes(docs: DataFrame) -> int:
    """Bytes of ``docs`` as the optimizer knows them: of files their size, so a table of compressed text counts less."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # A plan without statistics counts as a very large one; then the number of its partitions says more.
    return known if known < 1 << 56 else max(1, docs.rdd.getNumPartitions()) << 20


def plan(total: int, block_bytes: int, ratio: float) -> tuple[int, int, int]:
    """(bytes of a block, hash ranges, tasks) for ``total`` bytes of input, ``ratio`` of which blocks send to the ranges.

    Blocks times ranges is the number of rows that blocks send.  So blocks grow
    with the square root of the input, which keeps rows from growing with its
    square; ranges hold ``RANGE_BYTES`` each as long as a row still has
    ``_ROW_BYTES``.  None of the three changes a result.
    """
    size = min(max(block_bytes, math.isqrt(180 * total)), max(block_bytes, MAX_BLOCK_BYTES))
    ranges = max(4, min(math.ceil(ratio * total / RANGE_BYTES), int(ratio * size / _ROW_BYTES)))
    return size, ranges, max(4, min(math.ceil(total / TASK_BYTES), MAX_TASKS))


def squeeze(data: bytes | np.ndarray) -> bytes:
    """zstd; arrays of integers are stored byte plane by byte plane."""
    if isinstance(data, np.ndarray):
        width = data.dtype.itemsize
        data = np.ascontiguousarray(data.view(np.uint8).reshape(-1, width).T).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes, dtype: str | np.dtype | None = None) -> bytes | np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    if dtype is None:
        return raw
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def pack_strings(values: list[bytes]) -> bytes:
    lengths = squeeze(np.fromiter(map(len, values), np.uint32, len(values)))
    return len(lengths).to_bytes(8, "little") + lengths + squeeze(b"".join(values))


def unpack_strings(data: bytes) -> list[bytes]:
    cut = 8 + int.from_bytes(data[:8], "little")
    lengths, whole = unsqueeze(data[8:cut], "<u4"), unsqueeze(data[cut:])
    ends = np.cumsum(lengths, dtype=np.int64)
    return [whole[e - n : e] for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]


def in_blocks(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    emit: Callable[[str, list, list[bytes]], Iterator[tuple]],
    schema: str,
    fields: pa.Schema,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows that ``emit(block, ids, texts)`` gives for each block; texts are UTF-8, null is empty.

    Block names hold the task and a serial number.  A repeated task over rows
    in another order cuts differently, so a name alone identifies a block only
    once the result is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            for row in emit(f"{task}-{serial}", ids, texts):
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, fields, strict=True)], schema=fields)

        for batch in batches:
            keys, column = batch.column(0).to_pylist(), batch.column(1)
            for key, value in zip(keys, column, strict=True):
                text = (value.as_py() or "").encode("utf-8", "replace")
                if ids and (size + len(text) > block_bytes or len(ids) >= BLOCK_ROWS):
                    yield from close()
                    ids, texts, size, serial = [], [], 0, serial + 1
                ids.append(key)
                texts.append(text)
                size += len(text)
        if ids:
            yield from close()

    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)
