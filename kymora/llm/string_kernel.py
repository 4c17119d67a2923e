"""Language of a text by string kernels.

The kernel of two texts is the number of character n-grams (all lengths up to
``order``, each present or absent) that both have, divided by the geometric mean of
their numbers of n-grams.  A Nyström approximation spans it by ``landmarks`` labelled
texts, and kernel ridge regression, one language against the rest, is solved in that
space.  Texts are scored in batches: presence matrix times landmark matrix gives the
kernel values, and these times the coefficients give the scores.

N-grams are presence bits in 2**15 hash cells, so the landmark matrix has a fixed
size.  Fitting uses a bounded sample: at most about ``per_language`` texts of each
language (chosen by hash) and ``landmarks`` of them; only kernel values of the sample
and landmark bits reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.llm.common import documents, slices

ORDER, CELLS = 4, 1 << 15
PER_LANGUAGE, LANDMARKS, RIDGE = 1000, 128, 1e-3
ROWS = 64


def presence(texts: list[str], out: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Fill ``out`` (texts x cells) with the presence bits of each text; returns their numbers."""
    out.fill(0)
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low)), [len(t) for t in low])
    flat = out.reshape(-1)
    cells = out.shape[1]
    shift = np.uint32(32 - (cells.bit_length() - 1))
    h = np.zeros(len(points), np.uint32)
    for n in range(1, order + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] * np.uint32(0x01000193)) ^ (points[n - 1 :] + np.uint32(n))
        whole = row[: len(h)] == row[n - 1 :]
        cell = ((h * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> shift
        flat[row[: len(h)][whole] * cells + cell[whole]] = 1
    return out.sum(axis=1)


@dataclass
class Model:
    languages: list[str]
    bits: np.ndarray  # landmarks, packed presence bits
    coefficients: np.ndarray  # landmarks x languages

    def matrix(self) -> np.ndarray:
        full = np.unpackbits(self.bits, axis=1).astype(np.float32)
        return (full / np.sqrt(np.maximum(full.sum(axis=1, keepdims=True), 1))).T.copy()


def kernel_rows(texts: list[str], landmark: np.ndarray, room: np.ndarray) -> np.ndarray:
    x = room[: len(texts)]
    size = presence(texts, x)
    return (x @ landmark) / np.sqrt(np.maximum(size, 1))[:, None]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 19):
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def sample_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map: packed presence bits of each text."""
    room = np.zeros((ROWS, CELLS), np.float32)
    for b in blocks(batches):
        texts = b.column("text").to_pylist()
        x = room[: len(texts)]
        presence(texts, x)
        packed = np.packbits(x.astype(np.uint8), axis=1)
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("order"), pa.array([p.tobytes() for p in packed], pa.binary())], ["lang", "order", "bits"])


def sample_kernels(landmark: np.ndarray):
    """Arrow map: kernel values of each text with the landmarks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.zeros((ROWS, CELLS), np.float32)
        for b in blocks(batches):
            k = kernel_rows(b.column("text").to_pylist(), landmark, room)
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([r.tobytes() for r in k.astype("<f4")], pa.binary())], ["lang", "kernel"])

    return run


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Model from labelled texts (doc_id, text, lang); rows without language or letters are left out."""
    docs = documents(docs, "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, CELLS // 8), np.uint8), np.zeros((0, 0), np.float32))
    order = F.xxhash64("doc_id", "text", F.lit(8))
    share = F.create_map(*[F.lit(x) for c in languages for x in (c, min(1.0, per_language / counts[c]))])
    drawn = docs.withColumn("order", order).filter((F.shiftrightunsigned("order", 11) / float(1 << 53)) < share[F.col("lang")])
    few = max(1, landmarks // len(languages))
    near = F.create_map(*[F.lit(x) for c in languages for x in (c, min(1.0, 4 * few / counts[c]))])
    pool = drawn.filter((F.shiftrightunsigned("order", 11) / float(1 << 53)) < near[F.col("lang")])
    bits = pool.select("lang", "order", "text").mapInArrow(sample_bits, "lang string, order bigint, bits binary").toPandas()
    bits = bits.sort_values(["lang", "order"]).groupby("lang").head(few)
    model = Model(languages, np.stack([np.frombuffer(x, np.uint8) for x in bits["bits"]]), np.zeros((len(bits), len(languages)), np.float32))
    landmark = model.matrix()
    got = drawn.select("lang", "text").mapInArrow(sample_kernels(landmark), "lang string, kernel binary").toPandas()
    got = got.sort_values(["lang", "kernel"])
    k = np.stack([np.frombuffer(x, "<f4") for x in got["kernel"]]).astype(np.float64)
    inner = (landmark.T @ landmark).astype(np.float64)
    value, vector = np.linalg.eigh(inner)
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])  # maps kernel values to Nyström features
    phi = k @ root
    target = (got["lang"].to_numpy()[:, None] == np.array(languages, object)[None, :]).astype(np.float64)
    each = target.sum(axis=0)
    weight = (target / np.maximum(each, 1)).sum(axis=1) * len(target) / len(languages)  # every language counts the same
    gram = phi.T @ (phi * weight[:, None])
    solved = np.linalg.solve(gram + ridge * len(target) * np.eye(len(gram)), phi.T @ (target * weight[:, None]))
    model.coefficients = (root @ solved).astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep``, lang_pred, score) for every row of ``docs`` (doc_id, text).

    The score is that of the best language, cut to 0..1; equal scores go to the
    language first in alphabetical order.  Null texts, texts without a letter, and all
    texts of a model without languages are ``und`` with score 0.  Repeated rows and null
    doc_ids keep a row each; whole texts are read; columns beyond ``keep`` are ignored.
    """
    more = tuple(c for c in keep if c not in ("doc_id", "text"))
    docs = documents(docs, *more)
    names = ["doc_id", *keep]
    languages, coefficients = model.languages, model.coefficients
    bits = model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.zeros((ROWS, CELLS), np.float32)
        landmark = Model(languages, bits, coefficients).matrix() if languages else None
        for b in blocks(batches):
            n = b.num_rows
            letters = np.array(b.column("letters").to_numpy(zero_copy_only=False), bool)
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if languages:
                s = kernel_rows([t or "" for t in b.column("text").to_pylist()], landmark, room) @ coefficients
                best = s.argmax(axis=1)
                score = np.clip(s[np.arange(n), best].astype(np.float64), 0, 1)
            known = letters & bool(languages)
            named = [languages[i] if k else "und" for i, k in zip(best, known, strict=True)]
            cols = [*(b.column(c) for c in names), pa.array(named, pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score"])

    docs = docs.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = T.StructType([docs.schema[c] for c in names]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, out)


def held_out(doc_id: Column | str) -> Column:
    """Whether a document belongs to the fold that is never learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))
