"""Exact lexical top-k: sums of short lists first, then documents in order over the long ones.

Index: documents are taken in shards as they stand; a shard is one row with its postings
by term.  A list of more than BLOCK postings is kept with the largest count and the
shortest document of each block of BLOCK postings, which bound what the block can add.
Statistics of all documents (their number and words, and for each term asked for the
documents that hold it) come from all shards.

Search: items go out in blocks of bounded size, each against all shards.  For an item
the lists of a shard are taken from the shortest on.  As long as they hold no more
postings than the shard has documents, they are summed term by term into accumulators.
The accumulators, sorted by document and bounded by their largest sum, then are one list
among the remaining long ones, and all are read document by document: the pivot is the
first document that the bounds of the lists before it allow among the best, block bounds
are tried there, and lists skip to it by binary search.  A task keeps the best of an
item through all its shards, so later shards are pruned by what earlier ones held.
"""

from __future__ import annotations

import functools
import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kymora.llm.common import LOW, Words, documents, ragged, slices, splitmix, stored

SHARD_BYTES, BLOCK = 1 << 24, 64
ITEM_TERMS = 1 << 20  # distinct (item, term) rows in a block of items
#: Bytes that separate terms (all ASCII but letters and digits).
GAPS = bytes(b for b in range(128) if not chr(b).isalnum())
SHARD = "docs bigint, words bigint, ids binary, lengths binary, terms binary, offsets binary, doc binary, count binary, block_at binary, block_count binary, block_length binary"


@functools.lru_cache(1)
def words() -> Words:
    return Words((53,), GAPS, fold=True)


def postings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each distinct term of each row."""
    _, doc, _, _, (h,) = words()(column)
    mixed = splitmix(h ^ splitmix(doc.astype(np.uint64)))
    _, at, count = np.unique(mixed, return_index=True, return_counts=True)
    return doc[at], h[at], count


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map: rows as shards; a shard under construction holds postings, never texts."""
    ids: list[np.ndarray] = []
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = size = 0

    def shard() -> pa.RecordBatch:
        doc, term, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, term))
        doc, term, count = doc[order], term[order], count[order]
        length = np.bincount(doc, weights=count, minlength=rows).astype(np.int64)
        first = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1]) if len(term) else []), len(term)).astype(np.int64)
        n = np.diff(first)
        blocks = np.where(n > BLOCK, -(-n // BLOCK), 0)
        starts = np.repeat(first[:-1], blocks) + BLOCK * ragged(np.zeros(len(n), np.int64), blocks)
        most = np.zeros(0, np.int64)
        least = np.zeros(0, np.int64)
        if len(starts):  # ends of long lists close the last block of each
            edges = np.unique(np.concatenate([starts, first[:-1][n > BLOCK] + n[n > BLOCK]]))
            edges = edges[edges < len(doc)]
            most = np.maximum.reduceat(count, edges)[np.searchsorted(edges, starts)]
            least = np.minimum.reduceat(length[doc], edges)[np.searchsorted(edges, starts)]
        cols = [
            np.concatenate(ids).astype("<i8"), length.astype("<i8"), term[first[:-1]].astype("<u8"), first.astype("<i8"), doc.astype("<i4"), count.astype("<i4"),
            np.append(0, np.cumsum(blocks)).astype("<i8"), most.astype("<i4"), least.astype("<i8"),
        ]
        row = [pa.array([int((length > 0).sum())], pa.int64()), pa.array([int(length.sum())], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)]
        return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in SHARD.split(", ")])

    for b in slices(batches, "text", min(SHARD_BYTES, 1 << 20)):
        doc, term, count = postings(b.column("text"))
        ids.append(b.column("doc_id").fill_null(LOW).to_numpy(zero_copy_only=False))
        parts.append((doc.astype(np.int64) + rows, term, count))
        rows += b.num_rows
        size += b.nbytes
        if size >= SHARD_BYTES:
            yield shard()
            ids, parts, rows, size = [], [], 0, 0
    if rows:
        yield shard()


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map: the distinct terms of each item, one a row."""
    for b in slices(batches, "text", 1 << 20):
        doc, term, _ = postings(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(doc)), pa.array(term.view(np.int64))], ["item_id", "term"])


def frequencies(wanted: np.ndarray):
    """Arrow map: documents of each wanted term in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, o in zip(b.column("terms"), b.column("offsets"), strict=True):
                term, offset = np.frombuffer(t.as_py(), "<u8"), np.frombuffer(o.as_py(), "<i8")
                _, here, there = np.intersect1d(wanted, term, assume_unique=True, return_indices=True)
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(np.diff(offset)[there], pa.int64())], ["term", "n"])

    return run


def lengths_in_tens(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 90 + (90 * n * docs) div total for each length n, exact where the product leaves 64 bits too."""
    if len(n) and int(n.max()) * 90 * docs >= 1 << 62:
        return np.array([10 + 90 * int(x) * docs // total for x in n], np.int64)
    return 10 + (90 * n.astype(np.int64) * docs) // max(total, 1)


def share(tf, m):
    """What an occurrence count adds for a unit of weight; grows with tf, falls with m."""
    return (1000000000 * tf) // (1000 * tf + 8 * m)


class Sorted:
    """A list of (document, value) with one bound for all and one for each block; read forwards."""

    __slots__ = ("at", "block", "bound", "counted", "docs", "now", "values")

    def __init__(self, docs: array, values, bound: int, block: list[int]) -> None:
        self.docs, self.values, self.bound, self.block = docs, values, bound, block
        self.at, self.now = 0, docs[0]

    def seek(self, doc: int, end: int) -> None:
        """To the first place at or after ``doc``; documents from ``end`` on mean the list is done."""
        docs = self.docs
        at = self.at + 1
        if at < len(docs) and docs[at] < doc:
            at = bisect_left(docs, doc, at)
        self.at, self.now = at, docs[at] if at < len(docs) else end


class Shard:
    """Postings of one shard; impacts and lists are made for the wanted terms when an item asks for them."""

    def __init__(self, row: dict, wanted: np.ndarray, weight: np.ndarray, docs: int, total: int) -> None:
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.length = np.frombuffer(row["lengths"], "<i8")
        self.m = lengths_in_tens(self.length, docs, total)
        term = np.frombuffer(row["terms"], "<u8")
        offset, blocks = np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["block_at"], "<i8")
        _, here, there = np.intersect1d(wanted, term, assume_unique=True, return_indices=True)
        self.place = dict(zip(here.tolist(), zip(offset[there].tolist(), offset[there + 1].tolist(), blocks[there].tolist(), blocks[there + 1].tolist(), strict=True), strict=True))
        self.weight = weight
        self.doc, self.count = np.frombuffer(row["doc"], "<i4"), np.frombuffer(row["count"], "<i4")
        self.block_count = np.frombuffer(row["block_count"], "<i4").astype(np.int64)
        self.block_length = np.frombuffer(row["block_length"], "<i8")
        self.of = docs, total
        self.long: dict[int, tuple[array, array, int, list[int]]] = {}
        self.evaluated = 0

    def impacts(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        start, end, _, _ = self.place[t]
        doc = self.doc[start:end]
        return doc, self.weight[t] * share(self.count[start:end].astype(np.int64), self.m[doc])

    def sorted_list(self, t: int) -> Sorted:
        if t not in self.long:
            start, end, low, high = self.place[t]
            doc = array("i", self.doc[start:end].tobytes())
            count = array("i", self.count[start:end].tobytes())
            if high > low:
                bounds = self.weight[t] * share(self.block_count[low:high], lengths_in_tens(self.block_length[low:high], *self.of))
            else:
                bounds = self.impacts(t)[1].max(keepdims=True)
            self.long[t] = doc, count, int(bounds.max()), bounds.tolist()
        return Sorted(*self.long[t])

    def accumulated(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: (documents in order, sums) of the lists of ``terms``."""
        total = np.zeros(len(self.ids), np.int64)
        for t in terms:
            doc, impact = self.impacts(t)
            total[doc] += impact
        total[self.ids == LOW] = 0
        docs = np.flatnonzero(total)
        return docs, total[docs]

    def search(self, terms: np.ndarray, k: int, best: list[tuple[int, int]]) -> None:
        """Put documents into ``best``, a heap of the ``k`` best (score, -doc_id) so far."""
        here = sorted((t for t in terms.tolist() if t in self.place and self.weight[t] > 0), key=lambda t: (self.place[t][1] - self.place[t][0], t))
        used = short = 0
        while short < len(here) and used + (n := self.place[here[short]][1] - self.place[here[short]][0]) <= len(self.ids):
            used += n
            short += 1
        if not here:
            return
        lists = [self.sorted_list(t) for t in here[short:]]
        docs, sums = self.accumulated(here[:short])
        floor = best[0][0] if len(best) == k else 1
        if len(sums) >= k:  # a sum alone is a score that a document reaches
            floor = max(floor, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
        if not lists:  # the sums are the scores
            for d in np.flatnonzero(sums >= floor).tolist():
                self.offer(int(sums[d]), int(docs[d]), k, best)
            return
        rest = sum(x.bound for x in lists)
        able = sums + rest >= floor  # no other accumulator can reach the best, whatever the long lists add
        docs, sums = docs[able], sums[able]
        if len(docs):
            edges = np.arange(0, len(docs), BLOCK)
            lists.append(Sorted(array("i", docs.astype("<i4").tobytes()), array("q", sums.tobytes()), int(sums.max()), np.maximum.reduceat(sums, edges).tolist()))
        self.documents(lists, here[short:], floor, k, best)

    def documents(self, lists: list[Sorted], terms: list[int], floor: int, k: int, best: list[tuple[int, int]]) -> None:
        """Document at a time over the long lists and the accumulators, which stand behind them."""
        end, m, ids = len(self.ids), self.m, self.ids
        weights = [int(self.weight[t]) for t in terms]
        for i, x in enumerate(lists):
            x.counted = weights[i] if i < len(weights) else 0
        while True:
            lists.sort(key=lambda x: x.now)
            bound, pivot = 0, -1
            for i, x in enumerate(lists):
                if x.now >= end:
                    break
                bound += x.bound
                if bound >= floor:
                    pivot = i
                    break
            if pivot < 0:
                return
            doc = lists[pivot].now
            while pivot + 1 < len(lists) and lists[pivot + 1].now == doc:
                pivot += 1
            head = lists[: pivot + 1]
            bound = 0
            until = lists[pivot + 1].now if pivot + 1 < len(lists) else end
            for x in head:  # block bounds at the pivot; nothing before the first end of a block can do better
                at = x.at if x.now == doc else bisect_left(x.docs, doc, x.at)
                if at < len(x.docs):
                    bound += x.block[at // BLOCK]
                    close = min((at // BLOCK + 1) * BLOCK, len(x.docs)) - 1
                    until = min(until, x.docs[close] + 1)
            if bound < floor:
                for x in head:
                    if x.now < until:
                        x.seek(until, end)
                continue
            if head[0].now < doc:
                for x in head:
                    if x.now < doc:
                        x.seek(doc, end)
                continue
            score = 0
            length = int(m[doc])
            for x in head:
                value = x.values[x.at]
                score += x.counted * ((1000000000 * value) // (1000 * value + 8 * length)) if x.counted else value
                x.seek(doc + 1, end)
            self.evaluated += 1
            if score >= floor and ids[doc] != LOW:
                self.offer(score, doc, k, best)
                if len(best) == k:
                    floor = max(floor, best[0][0])

    def offer(self, score: int, doc: int, k: int, best: list[tuple[int, int]]) -> None:
        entry = score, -int(self.ids[doc])
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)


def searcher(items: list[tuple[int, np.ndarray]], wanted: np.ndarray, weight: np.ndarray, docs: int, total: int, k: int):
    """Arrow map: the best of all shards of a task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.slice(i, 1).to_pylist()[0], wanted, weight, docs, total)
                for (_, terms), heap in zip(items, best, strict=True):
                    shard.search(terms, k, heap)
        rows = [(item, -d, s) for (item, _), heap in zip(items, best, strict=True) for s, d in heap]
        cols = [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)]
        yield pa.RecordBatch.from_arrays(cols, ["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of each item (item_id, text).

    Terms are stretches of ASCII letters and digits and of any characters beyond ASCII,
    A-Z folded.  With N documents that hold a term, L terms in them, n of one document,
    df documents and tf occurrences of a term, a term of the item, once each, adds
    w * ((10**9 * tf) div (1000 * tf + 8 * m)), where w is floor(1000 * ln((2N+2)/(2df+1)))
    and m is 10 + (90 * n * N) div L.  Scores above 0 are results, equal ones in order
    of doc_id.

    Null and empty texts hold no term: such documents are no results, such items find
    nothing.  Rows that repeat a doc_id are documents of their own; rows without a
    doc_id count in the statistics and are no results.  An item
    is an item_id: rows that repeat it add their terms, rows without one take no part.
    Other columns are ignored; an empty table of either kind gives no rows.
    """
    spark = docs.sparkSession
    index = stored(documents(docs).mapInArrow(build, SHARD), "lists")
    asked = items.select(*[(items[f"`{c}`"] if c in items.columns else F.lit(None)).cast(t).alias(c) for c, t in (("item_id", "bigint"), ("text", "string"))])
    asked = asked.filter(F.col("item_id").isNotNull()).mapInArrow(item_terms, "item_id bigint, term bigint").distinct()
    asked = stored(asked, "items")
    stats = index.agg(F.sum("docs"), F.sum("words")).first()
    parts = -(-asked.count() // ITEM_TERMS)
    found = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for part in range(parts if stats[1] else 0):
        block = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toArrow()
        item = block.column("item_id").to_numpy()
        wanted, place = np.unique(block.column("term").to_numpy().view(np.uint64), return_inverse=True)
        n = np.zeros(len(wanted))
        counts = index.select("terms", "offsets").mapInArrow(frequencies(wanted), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        n[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
        weight = np.floor(1000 * np.log((2.0 * stats[0] + 2) / (2 * n + 1))).astype(np.int64)
        order = np.argsort(item, kind="stable")
        names, starts = np.unique(item[order], return_index=True)
        each = list(zip(names.tolist(), np.split(place[order], starts[1:]), strict=True))
        tops = index.mapInArrow(searcher(each, wanted, weight, stats[0], stats[1], k), "item_id bigint, doc_id bigint, score bigint")
        found = found.union(tops if parts == 1 else stored(ranked(tops, k).drop("rank"), "tops"))
    return ranked(found, k).select("item_id", "rank", "doc_id", "score")


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "doc_id", "score", "rank")
