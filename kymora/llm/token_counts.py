"""Token counts of whole texts, with huge documents encoded in overlapping chunks.

A byte-level tokenizer cuts a text into pieces by a pattern that only looks ahead,
and merges never cross a piece.  So two encodings that both start a piece at the
same place agree from there on: such a place is a proven common boundary.  A long
document is cut into chunks that overlap to the right; each chunk reports the piece
starts inside its overlaps with the ids before them; neighbouring chunks are spliced
at their first common boundary.  Where none is found, the overlap is widened (and the
chunk with it) and only those documents are encoded again.

A boundary counts as proven in the left chunk only if it lies ``margin`` characters
before its end, so that look-ahead and added tokens cut off there cannot matter; where
the chunk ends with the text nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kymora.llm.byte_pieces import encoder
from kymora.llm.common import documents, row_key, slices, stored, tasks

CHUNK, OVERLAP = 1 << 15, 512


def whole_counts(path: str):
    """Arrow map: ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)

            def count(texts):
                return [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            enc = encoder(path)

            def count(texts):
                return enc.encode(texts, ids=False).totals

        for b in slices(batches, "text", 1 << 22):
            n = np.asarray(count([t or "" for t in b.column("text").to_pylist()]), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def cut(chunk: int, overlap: int):
    """Arrow map: a long text as chunks with an overlap to the right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b.column("text")[i].as_py()
                starts = range(0, len(text), chunk)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column(c)[i].as_py()] * n, pa.int64()) for c in ("doc_id", "n_bytes", "row")
                    ]
                    + [
                        pa.array(range(n), pa.int32()),
                        pa.array([k == n - 1 for k in range(n)]),
                        pa.array([s + chunk + overlap >= len(text) for s in starts]),
                        pa.array([text[s : s + chunk + overlap] for s in starts], pa.string()),
                    ],
                    ["doc_id", "n_bytes", "row", "chunk", "last", "ends", "part"],
                )

    return run


def edges(path: str, chunk: int, overlap: int):
    """Arrow map: ids of each chunk, and piece starts in its two overlaps with the ids before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, "part", 1 << 21):
            parts = b.column("part").to_pylist()
            got = enc.encode(parts, ids=False)
            first = np.searchsorted(got.text, np.arange(len(parts) + 1))
            out: list[list] = [[], [], [], []]
            ends = b.column("ends").to_pylist()
            for i, part in enumerate(parts):
                sure = len(part) - (0 if ends[i] else enc.margin)  # nothing is cut off at the end of the text
                start, count = got.start[first[i] : first[i + 1]], got.count[first[i] : first[i + 1]]
                before = np.cumsum(count) - count
                head = start < overlap
                tail = (start >= chunk) & (start <= sure)
                for o, x in zip(out, (start[head], before[head], start[tail] - chunk, before[tail]), strict=True):
                    o.append(x)
            lists = [pa.array(o, pa.list_(pa.int64())) for o in out]
            kept = [b.column(c) for c in ("doc_id", "n_bytes", "row", "chunk", "last")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(got.totals), *lists], ["doc_id", "n_bytes", "row", "chunk", "last", "total", "head", "head_n", "tail", "tail_n"])

    return run


def spliced(chunks: DataFrame) -> DataFrame:
    """One row per document: its ids and whether every pair of neighbours has a common boundary."""
    key = ["doc_id", "n_bytes", "row"]
    once = chunks.groupBy(*key, "chunk").agg(F.count("*").alias("copies"), F.first(F.struct("last", "total", "head", "head_n", "tail", "tail_n")).alias("c"))
    once = once.select(*key, "chunk", "copies", "c.*")
    w = W.partitionBy(*key).orderBy("chunk")
    seams = once.select("*", F.lead("head").over(w).alias("next"), F.lead("head_n").over(w).alias("next_n"))
    at = F.array_min(F.array_intersect("tail", "next"))
    seams = seams.withColumn("at", at)

    def ids_before(places: str, counts: str):
        return F.element_at(counts, F.array_position(places, F.col("at")).cast("int"))

    kept = F.when(F.col("last"), F.col("total")).otherwise(ids_before("tail", "tail_n") - ids_before("next", "next_n"))
    return seams.groupBy(*key).agg(
        F.max("copies").alias("copies"), F.sum(kept).alias("n_tokens"), F.bool_or(~F.col("last") & F.col("at").isNull()).alias("failed")
    )


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs`` (doc_id, text).

    Texts of at most ``chunk`` characters are encoded whole, longer ones in chunks.
    Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows and null doc_ids
    keep a row each.  Other columns are ignored.  An empty table gives no rows.
    Strings of added tokens inside a text are those tokens, as the library does by
    default.  A tokenizer whose pieces are not those of the byte-level pattern, or a
    sentencepiece model, gives no provable boundary: its texts are encoded whole.
    """
    docs = documents(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint"
    if path.endswith(".model") or not encoder(path).known:
        return docs.mapInArrow(whole_counts(path), schema)
    size = F.coalesce(F.char_length("text"), F.lit(0))
    result = docs.filter(size <= chunk).mapInArrow(whole_counts(path), schema)
    long = docs.filter(size > chunk).withColumn("row", row_key("doc_id", "text"))
    n = tasks(docs.sparkSession)
    base = "doc_id bigint, n_bytes bigint, row bigint, chunk int, last boolean"
    lists = "total bigint, head array<bigint>, head_n array<bigint>, tail array<bigint>, tail_n array<bigint>"
    while True:
        chunks = long.mapInArrow(cut(chunk, overlap), f"{base}, ends boolean, part string").repartition(n, "row", "chunk")
        seams = stored(spliced(chunks.mapInArrow(edges(path, chunk, overlap), f"{base}, {lists}")), "seams")
        good = seams.filter(~F.col("failed")).select("doc_id", "n_bytes", "n_tokens", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
        result = result.unionByName(good.select("doc_id", "n_bytes", "n_tokens"))
        bad = seams.filter("failed").select("row")
        if bad.isEmpty():
            return result
        long = stored(long.join(bad, "row", "left_semi").select(*long.columns), "widened")
        overlap *= 4
        chunk = max(chunk, overlap)
