"""Largest inner products by a forest of random-projection trees.

Vectors get one more component that makes all norms equal, so that directions decide.
Each tree splits by random directions at the median of a bounded sample; every vector
is put into one leaf of each tree.  A query walks all trees through one shared queue,
best margin first, until the leaves taken hold enough vectors; in each leaf it takes
all vectors are ranked by exact inner products, and the leaves' best are merged.

Equal vectors are one entry with the smallest ids it stands for, so a vector that
fills a third of the table costs one entry.  Leaves and their queries meet in blocks
of bounded size on both sides.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kymora.llm.common import stored

#: The forest is fitted on about SAMPLE distinct vectors; every vector is indexed.
SAMPLE, TREES, LEAVES, SHARE, LEAST, SEED = 1 << 15, 8, 64, 0.8, 4096, 7
BLOCK, QUERIES = 8192, 4096


@dataclass
class Forest:
    """Trees in heap order: node i has the children 2i+1 and 2i+2; all leaves have one depth."""

    planes: np.ndarray  # trees x inner nodes x (dimension + 1)
    cuts: np.ndarray  # trees x inner nodes
    norm: float

    @property
    def depth(self) -> int:
        return (self.planes.shape[1] + 1).bit_length() - 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        x = self.lifted(x)
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.planes[t, node]) >= self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - self.planes.shape[1]
        return out

    def walk(self, q: np.ndarray, counts: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """Leaves of all trees in the order of a shared queue, until they hold ``wanted`` vectors."""
        inner = self.planes.shape[1]
        margin = self.planes[:, :, : len(q)] @ q - self.cuts
        queue = [(-np.inf, t, 0) for t in range(len(self.planes))]
        taken, have = [], 0
        while queue and have < wanted:
            far, t, node = heapq.heappop(queue)
            if node >= inner:
                n = counts[t, node - inner]
                if n:
                    taken.append((t, node - inner))
                    have += n
                continue
            m = margin[t, node]
            heapq.heappush(queue, (max(far, m), t, 2 * node + 1))
            heapq.heappush(queue, (max(far, -m), t, 2 * node + 2))
        return taken


def fit(sample: np.ndarray, norm: float, trees: int, leaves: int, seed: int) -> Forest:
    depth = max(0, (leaves - 1).bit_length())
    rng = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    dimension = sample.shape[1]
    forest = Forest(np.zeros((trees, inner, dimension + 1)), np.zeros((trees, inner)), norm)
    x = forest.lifted(sample)
    for t in range(trees):
        node = np.zeros(len(x), np.int64)
        for i in range(inner):
            w = rng.normal(size=dimension + 1)
            forest.planes[t, i] = w / np.linalg.norm(w)
            mine = np.flatnonzero(node == i)
            p = x[mine] @ forest.planes[t, i]
            forest.cuts[t, i] = np.median(p) if len(mine) else 0.0
            node[mine] = 2 * i + 1 + (p >= forest.cuts[t, i])
    return forest


def valid(kind: str):
    """Arrow map: vectors that take part, as bytes, with a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, data = [], [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("vector").to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.asarray(v, kind)
                if not np.isfinite(x).all() or not x.any():
                    continue
                x = x + 0.0  # one zero
                ids.append(i)
                data.append(x.tobytes())
                keys.append(hashlib.blake2b(data[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "key", "vec"])

    return run


def matrix(column: pa.Array | pd.Series, kind: str) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, pa.Array | pa.ChunkedArray) else list(column)
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def best(k: int, kind: str):
    """For one block of a leaf and the queries there: each query's ``k`` nearest, exactly."""

    def run(_, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"q": [], "key": [], "lo": [], "score": []})
        rows = rows.sort_values(["lo", "key"], kind="stable")
        x, lo = matrix(rows["vec"], kind), rows["lo"].to_numpy()
        keys = rows["key"].to_numpy()
        out = []
        for i in range(0, len(asked), 256):
            part = asked.iloc[i : i + 256]
            q = matrix(part["vec"], kind)
            s = q @ x.T
            n = min(k, len(x))
            floor = np.partition(s, len(x) - n, axis=1)[:, len(x) - n]
            a, b = np.nonzero(s >= (floor - 1e-9 * (1 + np.abs(floor)))[:, None])
            score = exact(q[a], x[b])
            order = np.lexsort((b, -score, a))  # rows stand in the order of their smallest id
            a, b, score = a[order], b[order], score[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            keep = place < n
            out.append(pd.DataFrame({"q": part["key"].to_numpy()[a[keep]], "key": keys[b[keep]], "lo": lo[b[keep]], "score": score[keep]}))
        return pd.concat(out)

    return run


def search(
    vectors: DataFrame, asked: Column, k: int = 20, trees: int = TREES, leaves: int = LEAVES, share: float = SHARE, least: int = LEAST, sample: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows of ``vectors`` (vec_id, embedding) where ``asked`` holds.

    The score is the inner product in double precision; nearest first, ties to the
    smaller vec_id; a query never finds itself.  A query takes leaves until they hold
    ``share`` of the distinct vectors and ``least`` vectors, counting a vector once per
    tree; so small tables are searched whole.  Vectors that are
    null, empty, zero, or hold null or non-finite components take no part, nor do rows
    without vec_id or with another length than most.  Repeated rows are one; of several
    vectors under one vec_id that with the smallest digest counts.  Other columns are
    ignored; an empty table gives no rows, fewer than ``k`` candidates give fewer.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").alias("vector"))
    rows = rows.mapInArrow(valid(kind), "vec_id bigint, key binary, vec binary")
    rows = stored(rows.groupBy("vec_id").agg(F.min(F.struct("key", "vec")).alias("x")).select("vec_id", "x.*"), "vectors")
    empty = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    usual = rows.groupBy(F.octet_length("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return empty
    rows = rows.filter(F.octet_length("vec") == usual["size"])
    entries = stored(rows.groupBy("key").agg(F.min("vec_id").alias("lo"), F.first("vec").alias("vec")), "entries")
    total = entries.count()
    drawn = entries.filter((F.shiftrightunsigned(F.xxhash64("key"), 11) / float(1 << 53)) < min(1.0, sample / total))
    seen = matrix(pd.Series([r["vec"] for r in drawn.select("vec").orderBy("vec").collect()] or [entries.first()["vec"]]), kind)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vec"), kind)
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(axis=1).max()))])], ["norm"])

    norm = entries.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    forest = fit(seen, norm, trees, leaves, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = forest.leaves(matrix(b.column("vec"), kind)) if b.num_rows else np.zeros((0, trees), np.int64)
            code = (leaf + np.arange(trees) * (1 << forest.depth)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(code), pa.list_(pa.int32()))], [*b.schema.names, "codes"])

    placed = stored(entries.mapInArrow(place, "key binary, lo bigint, vec binary, codes array<int>"), "placed")
    size = np.zeros(trees << forest.depth, np.int64)
    for r in placed.select(F.explode("codes").alias("code")).groupBy("code").count().collect():
        size[r["code"]] = r["count"]
    counts = size.reshape(trees, -1)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column("vec"), kind) if b.num_rows else np.zeros((0, 1))
            codes = [[(t << forest.depth) + n for t, n in forest.walk(x, counts, max(share * total, least))] for x in q]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("vec"), pa.array(codes, pa.list_(pa.int32()))], ["key", "vec", "codes"])

    queries = rows.filter(asked).select("vec_id", "key")
    entry = entries.join(queries.select("key").distinct(), "key", "left_semi")
    visits = stored(entry.select("key", "vec").mapInArrow(visit, "key binary, vec binary, codes array<int>"), "visits")
    load = np.zeros(trees << forest.depth, np.int64)
    for r in visits.select(F.explode("codes").alias("code")).groupBy("code").count().collect():
        load[r["code"]] = r["count"]

    def block(n: np.ndarray, limit: int) -> Column:
        """Number of blocks of each leaf."""
        return F.element_at(F.array(*[F.lit(int(max(1, -(-int(x) // limit)))) for x in n]), F.col("code") + 1)

    def dealt(df: DataFrame, own: np.ndarray, own_limit: int, other: np.ndarray, other_limit: int, mine: str, theirs: str) -> DataFrame:
        one = df.withColumn("code", F.explode("codes")).drop("codes")
        one = one.withColumn(mine, F.pmod(F.xxhash64("key"), block(own, own_limit)).cast("int"))
        return one.withColumn(theirs, F.explode(F.sequence(F.lit(0), block(other, other_limit) - 1)))

    left = dealt(placed, size, BLOCK, load, QUERIES, "b", "p").groupBy("code", "b", "p")
    right = dealt(visits, load, QUERIES, size, BLOCK, "p", "b").groupBy("code", "b", "p")
    found = left.cogroup(right).applyInPandas(best(k + 1, kind), "q binary, key binary, lo bigint, score double").dropDuplicates(["q", "key"])
    top = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "lo"))).filter(F.col("n") <= k + 1)
    ids = rows.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("vec_id"))).filter(F.col("n") <= k + 1).select("key", "vec_id")
    pairs = top.join(ids, "key").select("q", "vec_id", "score")
    pairs = pairs.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    full = queries.select(F.col("vec_id").alias("query_id"), F.col("key").alias("q")).join(pairs, "q").filter("query_id != vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return full.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
