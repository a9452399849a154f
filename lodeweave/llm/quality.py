"""Quality classifier: learned word and character n-gram vectors, averaged per document.

Each word and each character n-gram of a word is hashed to a row of a table
of vectors, and so is each pair of neighbouring words, in which a word that
repeats the one before is written as a ditto mark.  A document is the mean of
the rows of its words and n-grams plus the mean of the rows of its pairs; a
softmax over the two labels reads that sum.  Vectors and output weights are
learned by stochastic gradient descent in numpy on a bounded number of
labelled rows, whose features are counted on the executors and read by the
driver one document at a time.

Scoring uses that the model is linear in its features: the two output
weights folded into the vectors leave one number per row, so a word's share
of the margin is computed once per distinct word and kept in a bounded cache.
"""

from __future__ import annotations

import math
import tempfile
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.workspace import materialize, ship


#: A score from which a document counts as good.
THRESHOLD = 0.7
#: Labelled rows whose crc32(id as text) mod ``FOLDS`` is ``HELD_OUT`` are never learned from.
FOLDS, HELD_OUT = 4, 2
#: Bound of the training sample: labelled documents, each with its whole text; labels looked at for each of them.
SAMPLE_ROWS, AHEAD = 4000, 16

#: Rows for words and n-grams, after them rows for pairs; length of a vector; lengths of n-grams.
BUCKETS, PAIRS, WIDTH, GRAMS = 1 << 16, 1 << 15, 12, (3, 4, 5)
EPOCHS, RATE, SEED = 4, 0.5, 7
#: N-grams are taken from pieces of so many characters of words.
WORD_PIECE = 1 << 17
#: Distinct words, and their bytes, that a worker keeps at a time.
_CACHED_WORDS, _CACHED_BYTES = 300_000, 32 << 20
_PIECE = 1 << 20


def feature_rows(words: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, places in ``words``) of the features of words: each itself and all its character n-grams with end marks, a bounded number at a time.

    Case and symbols are kept: they are what tells shouting and junk from prose.
    """
    yield np.fromiter((crc32(w.encode("utf-8", "replace")) % buckets for w in words), np.int64, len(words)), np.arange(len(words))
    marked, overlap = "".join([f"<{w}>" for w in words]), max(GRAMS) - 1
    ends = np.cumsum(np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    for at in range(0, len(marked), WORD_PIECE):
        size = min(WORD_PIECE, len(marked) - at)
        part = marked[at : at + size + overlap]  # an n-gram belongs to the piece in which it begins
        codes = np.zeros(size + overlap, np.uint64)
        codes[: len(part)] = np.frombuffer(part.encode("utf-32-le", "replace"), "<u4")
        owner = np.searchsorted(ends, np.arange(at, at + size), "right")
        left = ends[owner] - np.arange(at, at + size)
        mixed = codes[:size].copy()
        for n in range(2, overlap + 2):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 : n - 1 + size]
            if n in GRAMS:
                fits = left >= n
                yield ((mixed[fits] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64) % buckets, owner[fits]


def features(word: str, buckets: int = BUCKETS) -> list[int]:
    """All rows of a word."""
    return np.concatenate([rows for rows, _ in feature_rows([word], buckets)]).tolist()


def pieces(text: str | None) -> Iterator[list[str]]:
    """The words of the whole text, of a long one piece by piece."""
    text, at = text or "", 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        words = text[at:end].split()
        if words:
            yield words
        at = end


class Numbers:
    """Numbers words as they come, and hashes pairs of numbered words.

    ``new`` is called with the words that had no number, in the order of theirs.  Beyond a bound
    on words and their bytes the numbering starts anew, between two pieces.
    """

    def __init__(self, new, forget=lambda: None):
        self.known: dict[str, int] = {}
        self.hashes, self.bytes, self.new, self.forget = np.zeros(1 << 10, np.uint64), 0, new, forget

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHED_WORDS or self.bytes > _CACHED_BYTES:
            known.clear()
            self.bytes = 0
            self.forget()
        fresh = list(set(words).difference(known))
        if fresh:
            coded = [word.encode("utf-8", "replace") for word in fresh]
            first, last = len(known), len(known) + len(fresh)
            known.update(zip(fresh, range(first, last), strict=True))
            while last > len(self.hashes):
                self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
            self.hashes[first:last] = list(map(crc32, coded))
            self.bytes += sum(map(len, coded))
            self.new(fresh)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def pairs(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the pairs of neighbours among word hashes; the ditto mark has the first row."""
        mixed = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
        return np.where(hashes[1:] == hashes[:-1], 0, 1 + mixed % np.uint64(PAIRS - 1)).astype(np.int64)


@dataclass
class Model:
    """``margin[row]``: a feature's share of the margin; ``bias``: the margin of a text without words."""

    margin: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self._margin, self._pairs = self.margin[:BUCKETS].astype(np.float64), self.margin[BUCKETS:].astype(np.float64)
        self._numbers = Numbers(self._learn, self._forget)
        self._forget()

    def _forget(self) -> None:
        self._sums, self._counts, self._size = np.zeros(1 << 10), np.zeros(1 << 10, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        while self._size + len(words) > len(self._sums):
            self._sums, self._counts = (np.concatenate((x, np.zeros_like(x))) for x in (self._sums, self._counts))
        mine = slice(self._size, self._size + len(words))
        for rows, owner in feature_rows(words):
            self._sums[mine] += np.bincount(owner, self._margin[rows], len(words))
            self._counts[mine] += np.bincount(owner, minlength=len(words))
        self._size += len(words)

    def score(self, text: str | None) -> float:
        total, count, paired, pairs, last = 0.0, 0, 0.0, 0, np.zeros(0, np.uint64)
        for words in pieces(text):
            numbers = self._numbers.of(words)
            total += float(self._sums[numbers].sum())
            count += int(self._counts[numbers].sum())
            hashes = np.concatenate((last, self._numbers.hashes[numbers]))
            rows = self._numbers.pairs(hashes)
            paired += float(self._pairs[rows].sum())
            pairs += len(rows)
            last = hashes[-1:]
        z = self.bias + (total / count if count else 0.0) + (paired / pairs if pairs else 0.0)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all features of a text and the weight of each: its share of the words and n-grams, or of the pairs."""
    total, of_pairs, last = np.zeros(BUCKETS), np.zeros(PAIRS), np.zeros(0, np.uint64)
    numbers = Numbers(lambda words: None)
    for words in pieces(text):
        counted = Counter(words)
        times = np.fromiter(counted.values(), np.float64, len(counted))
        for rows, owner in feature_rows(list(counted)):
            total += np.bincount(rows, times[owner], BUCKETS)
        found = numbers.of(words)
        hashes = np.concatenate((last, numbers.hashes[found]))
        of_pairs += np.bincount(numbers.pairs(hashes), minlength=PAIRS)
        last = hashes[-1:]
    whole = np.concatenate((total / max(1.0, total.sum()), of_pairs / max(1.0, of_pairs.sum())))
    rows = np.flatnonzero(whole).astype(np.int32)
    return rows, whole[rows].astype(np.float32)


def gradients(vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, part: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, its gradient by ``weights``, and by the document's vector) of one document: weights ``part`` of its features' ``vectors``."""
    mean = part @ vectors
    z = weights @ mean + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    loss = -math.log(max(float(p[label]), 1e-30))
    p[label] -= 1
    return loss, np.outer(p, mean), weights.T @ p


def learn(bags: Sequence[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, weights, bias) learned from bags, read one at a time; labels are 0 and 1.

    Without rows of both labels there is nothing to tell apart and every
    score is the share of label 1 (one half if there are no rows at all).
    """
    size = BUCKETS + PAIRS
    share = (sum(labels) + 1) / (len(labels) + 2) if labels else 0.5
    bias = np.array([math.log(1 - share), math.log(share)])  # what a text without words gets
    if len(set(labels)) < 2:
        return np.zeros((size, WIDTH), np.float32), np.zeros((2, WIDTH), np.float32), bias
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (size, WIDTH)).astype(np.float32)
    weights = rng.normal(0, 0.1, (2, WIDTH)).astype(np.float32)
    balance = len(labels) / (2.0 * np.bincount(labels, minlength=2))
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for k in rng.permutation(len(labels)):
            rows, part = bags[k]
            step = rate * (1 - done / steps) * math.sqrt(balance[labels[k]])
            done += 1
            if not len(rows):
                continue
            _, by_weights, by_mean = gradients(vectors[rows], weights, bias, part, labels[k])
            weights -= step * by_weights
            # A row's share of the mean is small; scaled by their number, rows move as fast as the weights do.
            vectors[rows] -= (step * math.sqrt(len(rows)) * part)[:, None] * by_mean[None, :]
    return vectors, weights, bias


def train(bags: Sequence[tuple[np.ndarray, np.ndarray]], labels: list[int], **options) -> Model:
    """The model that ``learn`` gives, folded."""
    vectors, weights, bias = learn(bags, labels, **options)
    return Model((vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0]))


class Spool(Sequence):
    """Bags in a scratch file of the driver, read one at a time."""

    def __init__(self) -> None:
        self._file, self._places = tempfile.TemporaryFile(), []

    def add(self, rows: bytes, part: bytes) -> None:
        self._places.append((self._file.tell(), len(rows)))
        self._file.write(rows)
        self._file.write(part)

    def order(self, order: list[int]) -> None:
        self._places = [self._places[k] for k in order]

    def __len__(self) -> int:
        return len(self._places)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at, size = self._places[k]
        self._file.seek(at)
        data = self._file.read(2 * size)  # rows and weights have four bytes each
        return np.frombuffer(data[:size], np.int32), np.frombuffer(data[size:], np.float32)


def held_out(id_col: str):
    """True for the rows that are never learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = SAMPLE_ROWS
) -> Model:
    """Train on at most ``max_rows`` labelled documents outside the held-out fold, those of smallest hash of their id.

    Labels without a document are passed over; ``AHEAD`` times as many labels
    as rows are looked at.
    Null labels and ids, and labels other than 0 and 1, are not used.  Of
    several labels of an id the largest counts, of several rows of ``docs``
    with one id the smallest text.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    # At most ``AHEAD * max_rows`` small rows, and then ``max_rows``, so these sides may be broadcast.
    few = materialize(usable.orderBy(F.xxhash64(id_col), id_col).limit(AHEAD * max_rows), "sample")
    present = few.join(docs.select(id_col).join(F.broadcast(few.select(id_col)), id_col, "left_semi").distinct(), id_col, "left_semi")
    picked = materialize(present.orderBy(F.xxhash64(id_col), id_col).limit(max_rows), "sample")
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(picked), id_col)
    texts = texts.groupBy(id_col).agg(F.min("t").alias("t"), F.first("y").alias("y")).select(id_col, "y", "t")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))], names=[id_col, "y", "rows", "part"]
            )

    ship(docs.sparkSession)
    bags = materialize(texts.mapInArrow(run, f"`{id_col}` {kind}, y int, rows binary, part binary"), "bags")
    spool, ids, ys = Spool(), [], []
    for row in bags.toLocalIterator():
        spool.add(row["rows"], row["part"])
        ids.append(row[id_col])
        ys.append(row["y"])
    order = sorted(range(len(ids)), key=ids.__getitem__)
    spool.order(order)
    return train(spool, [ys[k] for k in order])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", columns: bool = False) -> DataFrame:
    """(id_col, score) per row of ``docs``; with ``columns`` every column of ``docs`` and ``score``.

    Null and empty texts get the score of a text without words.  Each row is
    scored by itself, so repeated rows and ids repeat their score.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.margin, model.bias))  # BUCKETS + PAIRS floats
    source = docs if columns else docs.select(id_col, text_col)
    names = [c for c in source.columns if columns or c == id_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names)
    text_at = source.columns.index(text_col)
    kept_at = [source.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            texts = batch.column(text_at)
            scores = pa.array([own.score(texts[i].as_py()) for i in range(len(texts))], pa.float64())
            kept = [batch.column(i) for i in kept_at]
            yield pa.RecordBatch.from_arrays([*kept, scores], names=[*names, "score"])

    ship(spark)
    return source.mapInArrow(run, f"{fields}, score double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, score, predicted.  An empty table gives an empty result."""
    scored = score_documents(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``; columns unchanged."""
    scored = score_documents(docs.withColumnRenamed("score", "__score") if "score" in docs.columns else docs, fit(docs, labels, id_col, text_col), id_col, text_col, columns=True)
    kept = scored.where(F.col("score") >= threshold).drop("score")
    return kept.withColumnRenamed("__score", "score") if "score" in docs.columns else kept
