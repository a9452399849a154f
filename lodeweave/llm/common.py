"""What the operators of this package share: reading tables, normalising keys, slicing Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.workspace import ship

#: White space that separates words, as a Java and Python pattern.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold; long texts make 10,000 rows too many.  Ship the package to the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches one at a time, as tuples of Python values."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


class Batcher:
    """Collects output rows and gives an Arrow batch whenever enough bytes have gathered."""

    def __init__(self, schema: pa.Schema, max_bytes: int = 4 << 20, max_rows: int = 20_000):
        self.schema, self.max_bytes, self.max_rows = schema, max_bytes, max_rows
        self._columns: list[list] = [[] for _ in schema]
        self._bytes = 0

    def add(self, row: tuple, weight: int = 64) -> Iterator[pa.RecordBatch]:
        for column, value in zip(self._columns, row, strict=True):
            column.append(value)
        self._bytes += weight
        if self._bytes >= self.max_bytes or len(self._columns[0]) >= self.max_rows:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self._columns[0]:
            arrays = [pa.array(c, type=f.type) for c, f in zip(self._columns, self.schema, strict=True)]
            self._columns, self._bytes = [[] for _ in self.schema], 0
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
