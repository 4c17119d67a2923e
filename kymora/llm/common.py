"""Helpers shared by the operators of this package: inputs, byte arrays, hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kymora.session import shared_dir

U64 = np.uint64
BATCH_ROWS = 2000
LOW = np.iinfo(np.int64).min


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator needs, so that no other column can clash; a missing one is null.

    Whole texts travel in Arrow batches.  Where the session keeps Spark's default of
    10,000 rows for these, BATCH_ROWS is set, so that a batch is some MB and not some 100.
    """
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    have = set(docs.columns)
    want = [("doc_id", "bigint"), ("text", "string"), *((m, None) for m in more)]
    cols = [(docs[f"`{c}`"].cast(t) if t else docs[f"`{c}`"]) if c in have else F.lit(None).cast(t or "string") for c, t in want]
    return docs.select(*[c.alias(n) for c, (n, _) in zip(cols, want, strict=True)])


def row_key(*cols: Column) -> Column:
    """A well mixed key of a row; equal rows have equal keys."""
    return F.xxhash64(*cols)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "llm") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage on storage that outlives an executor."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a text column holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return what a task has freed to the system: workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def splitmix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on unsigned 64-bit integers (a published mixing function)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Mixed 64-bit integers as doubles in (0, 1)."""
    return ((x >> U64(12)).astype(np.float64) + 0.5) * (1.0 / (1 << 52))


class Rolling:
    """Hashes of stretches of an integer sequence from prefix sums.

    A stretch hashes to the sum of its symbols' random values times powers of an
    odd base; dividing by the power of its start makes it independent of place.
    """

    def __init__(self, seed: int, symbols: int = 0) -> None:
        self.base = int(splitmix(np.array([seed], U64))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.values = splitmix(np.arange(symbols, dtype=U64) + U64(seed << 20)) if symbols else None
        self._powers = self._inverses = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n + 1:
            n = max(n + 1, 2 * len(self._powers))
            steps = np.full(n, self.base, U64)
            steps[0] = 1
            back = np.full(n, self.inverse, U64)
            back[0] = 1
            self._powers, self._inverses = np.multiply.accumulate(steps), np.multiply.accumulate(back)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        self._grow(n)
        values = self.values[symbols] if self.values is not None else symbols
        out = np.zeros(n + 1, U64)
        np.cumsum(values * self._powers[:n], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(prefix))
        return (prefix[end] - prefix[start]) * self._inverses[start]


class Words:
    """Words of UTF-8 texts: maximal stretches without gap bytes, by default space and U+0009 to U+000D."""

    def __init__(self, seeds: tuple[int, ...] = (11, 29), gaps: bytes = b" \t\n\v\f\r", fold: bool = False) -> None:
        self.rolls = [Rolling(s, 256) for s in seeds]
        self.gap = np.zeros(256, bool)
        self.gap[list(gaps)] = True
        self.fold = np.arange(256, dtype=np.uint8)
        if fold:  # A-Z count as a-z
            self.fold[65:91] += 32

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(bytes, document of each word, start, end, hashes); start and end are byte places."""
        data, cuts = utf8(column)
        word = ~self.gap[data]
        inner = word.copy()
        inner[1:] &= word[:-1]
        first = cuts[:-1][cuts[:-1] < cuts[1:]]
        inner[first] = False  # a document never continues the one before it
        starts = np.flatnonzero(word & ~inner)
        closed = np.empty(len(word), bool)
        if len(word):
            closed[:-1] = ~word[1:] | ~inner[1:]
            closed[-1] = True
        ends = np.flatnonzero(word & closed) + 1
        doc = np.searchsorted(cuts, starts, side="right") - 1
        hashes = []
        for r in self.rolls:
            hashes.append(splitmix(r.of(r.prefix(self.fold[data]), starts, ends) ^ (ends - starts).astype(U64)))
        return data, doc, starts, ends, hashes


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the places where each row begins; null rows are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]], cuts - cuts[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
