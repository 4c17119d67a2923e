"""Exact BM25 top-k with an inverted index and block-max pruning.

Index: documents are taken in shards as they stand; a shard is one row that holds its
postings sorted by term and document.  Global statistics (number and mean length of
documents, and the document frequencies of the terms asked for) come from all shards.

Search: queries go out in blocks of bounded size.  Where a block has few queries, the
documents of a shard stand in blocks; for each term the largest impact in each block
bounds what the term can add there.  A query first scores the blocks with the largest
bounds, which gives a threshold, then only the blocks whose bound reaches it.  Skipped
blocks cannot hold a result, so the merged lists are exact.

Where a block has many queries, a shard sums them together in single precision: the
impacts of its frequent terms are a matrix, which meets a matrix of queries in one
product, and the lists of its other terms are added to that.  Every document whose sum,
with the most that rounding can take off, reaches the threshold is scored again in
double precision.  So all documents are looked at, and the results are the same.

Thresholds are shared between shards.  A hash of its content gives each shard a level;
three quarters of all shards have level 0, a quarter of the rest has each next one.
The highest level is searched first and each further one starts from the k-th best
result of those before, below which nothing is scored or returned.  So a query gets
about 3 k rows from a level, and levels grow with the logarithm of the shards.  A task
also carries the best of a query from shard to shard.
"""

from __future__ import annotations

import contextlib
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kymora.llm.common import U64, Words, documents, give_back, ragged, row_key, shared_path, slices, splitmix, stored

K1, B = 1.2, 0.75
SHARD_BYTES, BLOCK = 1 << 24, 32
QUERY_BYTES = 1 << 24  # of term hashes in a block of queries
DIGITS = 6
SLACK = 2 * 10.0**-DIGITS  # rounding moves a score by less
MANY = 64  # queries that a shard sums together, not one by one
STRIPE, SUMS = 1 << 13, 1 << 20  # documents summed at once; sums held at once
SHARE, MATRIX_BYTES, KINDS = 0.03, 1 << 25, 64
PRODUCT = 0.004  # time of an element of a product, with the addition of a posting as one
#: Lengths up to which lists share a table: 0, then 1, 2, 3, 4, 6, 8, 12 and so on.
WIDTHS = np.array([0, 1, 2, *(x << i for i in range(30) for x in (3, 4))], np.int64)
PIECE = 1 << 18  # postings added at once
#: Bytes that separate terms (all ASCII but letters and digits).
GAPS = bytes(b for b in range(128) if not chr(b).isalnum())


@functools.lru_cache(1)
def words() -> Words:
    return Words((41,), GAPS, fold=True)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count), sorted by term, then document."""
    _, doc, _, _, (h,) = words()(column)
    order = np.argsort(h, kind="stable")  # words come by document
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def level(data: list[bytes]) -> int:
    """Pairs of binary zeros at the end of a hash: 0 for three shards in four, 1 for three in sixteen, and so on."""
    h = functools.reduce(lambda h, d: zlib.crc32(d, h), data, 0)
    h = int(splitmix(np.array([h], U64))[0]) | 1 << 60
    return ((h & -h).bit_length() - 1) // 2


def build(shard_bytes: int):
    """Arrow map: rows as shards; only the postings of a shard are held, never its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = size = 0

        def shard() -> pa.RecordBatch:
            doc, term, count = (np.concatenate(x) for x in zip(*postings, strict=True))
            order = np.argsort(term, kind="stable")  # each slice is sorted, and later slices have later documents
            doc, term, count = doc[order], term[order], count[order]
            length = np.bincount(doc, weights=count, minlength=rows).astype(np.int64)
            first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            cols = [np.concatenate(ids).astype("<i8"), length.astype("<i4"), term[first].astype("<u8"), np.append(first, len(term)).astype("<i8"), doc.astype("<i4"), count.astype("<i4")]
            data = [c.tobytes() for c in cols]
            row = [pa.array([level(data)], pa.int32()), pa.array([rows], pa.int64()), pa.array([int(length.sum())], pa.int64()), *(pa.array([d], pa.binary()) for d in data)]
            return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in SHARD.split(", ")])

        for b in slices(batches, "text", min(shard_bytes, 1 << 20)):
            doc, term, count = terms(b.column("text"))
            ids.append(b.column("doc_id").to_numpy(zero_copy_only=False))
            postings.append((doc.astype(np.int64) + rows, term, count))
            rows += b.num_rows
            size += b.nbytes
            if size >= shard_bytes:
                yield shard()
                ids, postings, rows, size = [], [], 0, 0
        if rows:
            yield shard()

    return run


SHARD = "level int, docs bigint, words bigint, ids binary, lengths binary, terms binary, offsets binary, doc binary, count binary"


def query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map: distinct terms of each query."""
    for b in slices(batches, "text", 1 << 20):
        doc, term, _ = terms(b.column("text"))
        order = np.lexsort((term, doc))
        cuts = np.searchsorted(doc[order], np.arange(b.num_rows + 1))
        data = [term[order][s:e].astype("<u8").tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary()), b.column("key")], ["query_id", "terms", "key"])


def known(wanted: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common terms in both; each is sorted and has a term once."""
    if not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(wanted, term)
    there = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == term)
    return at[there], there


def frequencies(wanted: np.ndarray):
    """Arrow map: documents of each wanted term in the shards of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted), np.int64)
        for b in batches:
            for t, o in zip(b.column("terms"), b.column("offsets"), strict=True):
                term, offset = np.frombuffer(t.as_py(), "<u8"), np.frombuffer(o.as_py(), "<i8")
                here, there = known(wanted, term)
                n[here] += np.diff(offset)[there]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    return run


class Postings:
    """Postings of the wanted terms of one shard, sorted by term, then document."""

    def __init__(self, row: dict, wanted: np.ndarray, idf: np.ndarray, mean: float) -> None:
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.wanted = len(wanted)
        length = np.frombuffer(row["lengths"], "<i4")
        term, offset = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["offsets"], "<i8")
        here, there = known(wanted, term)
        n = np.diff(offset)[there]
        take = ragged(offset[there], n)
        self.doc = np.frombuffer(row["doc"], "<i4")[take].astype(np.int64)
        tf = np.frombuffer(row["count"], "<i4")[take].astype(np.float64)
        norm = K1 * (1 - B + B * length / mean)
        self.impact = np.repeat(idf[here], n) * (tf * (K1 + 1) / (tf + norm[self.doc]))
        self.slot = np.repeat(here, n)


class Shard(Postings):
    """For one query at a time: the largest impact of each term in each block."""

    def __init__(self, row: dict, wanted: np.ndarray, idf: np.ndarray, mean: float) -> None:
        super().__init__(row, wanted, idf, mean)
        slot, block = self.slot, self.doc // BLOCK
        new = np.append(True, (slot[1:] != slot[:-1]) | (block[1:] != block[:-1])) if len(slot) else np.zeros(0, bool)
        self.entry = np.append(np.flatnonzero(new), len(slot))  # postings of one term in one block
        self.block = block[new]
        self.bound = np.maximum.reduceat(self.impact, self.entry[:-1]) if len(slot) else np.zeros(0)
        self.first = np.searchsorted(slot[new], np.arange(len(wanted) + 1))
        self.blocks = -(-len(self.ids) // BLOCK)

    def score(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.entry[entries]
        at = ragged(start, self.entry[entries + 1] - start)
        total = np.bincount(self.doc[at], weights=self.impact[at], minlength=len(self.ids))
        hit = np.flatnonzero(total)
        return hit, total[hit]

    def others(self, entries: np.ndarray, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        doc, score = self.score(entries)
        if own is None:
            return doc, score
        keep = self.ids[doc] != own
        return doc[keep], score[keep]

    def top(self, query: np.ndarray, k: int, own: int | None = None, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and rounded scores that can be among the ``k`` best here, none below ``floor``; rows with the id ``own`` take no place."""
        none = np.zeros(0, np.int64), np.zeros(0)
        entries = ragged(self.first[query], self.first[query + 1] - self.first[query])
        if not len(entries):
            return none
        block = self.block[entries]
        bound = np.bincount(block, weights=self.bound[entries], minlength=self.blocks)
        live = np.flatnonzero((bound >= floor - SLACK) & (bound > 0))
        start = min(len(live), max(4, 2 * k // BLOCK + 1))
        if not start:
            return none
        chosen = np.zeros(self.blocks, bool)
        chosen[live[np.argpartition(-bound[live], start - 1)[:start]]] = True
        doc, score = self.others(entries[chosen[block]], own)
        if len(score) >= k:
            floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
        rest = ~chosen & (bound >= floor - SLACK) & (bound > 0)
        if rest.any():
            d, s = self.others(entries[rest[block]], own)
            doc, score = np.concatenate([doc, d]), np.concatenate([score, s])
        near = score >= floor - SLACK
        return leading(self.ids[doc[near]], np.round(score[near], DIGITS), k)


class Stripe:
    """For many queries at once: sums over a stretch of the documents of a shard, in single precision.

    The lists of the terms stand in tables by length, filled up to the width of the
    table with impacts of zero.  Terms in a share of SHARE of the documents are rows of a
    matrix too, as far as it has room; of these the product takes the ones that so many
    of the queries ask for that their lists would cost more.
    """

    def __init__(self, postings: Postings, low: int, high: int) -> None:
        self.low, self.docs = low, high - low
        slot, doc, impact = postings.slot, postings.doc, postings.impact
        if self.docs < len(postings.ids):
            inside = np.flatnonzero((doc >= low) & (doc < high))
            slot, doc, impact = slot[inside], doc[inside], impact[inside]
        doc, impact = doc - low, impact.astype(np.float32)
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(slot)))
        order = np.argsort(-count, kind="stable")
        rows = order[: MATRIX_BYTES // (4 * self.docs)]
        rows = rows[count[rows] >= SHARE * self.docs]
        self.matrix = np.zeros((len(rows), self.docs), np.float32)
        at = ragged(first[rows], count[rows])
        self.matrix[np.repeat(np.arange(len(rows)), count[rows]), doc[at]] = impact[at]
        kind = np.searchsorted(WIDTHS, count).astype(np.int32)  # a list of at most WIDTHS[kind] postings
        by = np.argsort(kind, kind="stable")
        many, widths = np.bincount(kind, minlength=1).tolist(), WIDTHS.tolist()
        room = WIDTHS[kind[by]]
        to, at = ragged(np.cumsum(room) - room, count[by]), ragged(first[by], count[by])
        docs, impacts = np.zeros(room.sum(), np.int32), np.zeros(room.sum(), np.float32)
        docs[to], impacts[to] = doc[at], impact[at]
        place = np.zeros(len(first), np.int32)
        self.lists, terms, start = [], 0, 0
        for one, n in enumerate(many):
            if n:
                place[by[terms : terms + n]] = np.arange(n)
                end = start + n * widths[one]
                self.lists.append((one, docs[start:end].reshape(n, -1), impacts[start:end].reshape(n, -1)))
                terms, start = terms + n, end
        self.code, self.row = np.full((2, postings.wanted), -1, np.int32)
        self.code[slot[first]] = place * KINDS + kind
        self.row[slot[first[rows]]] = np.arange(len(rows))
        self.worth = PRODUCT / np.maximum(count[rows], 1) * self.docs  # queries in one that make a row worth its product

    def sums(self, query: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` queries (rows) and all documents (columns), from the pairs of query and term."""
        code = self.code[slot]
        here = np.flatnonzero(code >= 0)
        code, query, row = code[here], query[here], self.row[slot[here]]
        taken = np.append(np.bincount(row[row >= 0], minlength=len(self.matrix)) >= n * self.worth, False)
        column = np.append(np.cumsum(taken[:-1]) - 1, 0)
        by_product = taken[row]
        asked = np.zeros((n, np.count_nonzero(taken)), np.float32)
        asked[query[by_product], column[row[by_product]]] = 1
        out = asked @ self.matrix[taken[:-1]]
        flat = out.reshape(-1)
        code, query = code[~by_product], query[~by_product]
        place, kind = code // KINDS, code % KINDS
        for one, docs, impacts in self.lists:
            pairs = np.flatnonzero(kind == one)
            step = max(1, PIECE // docs.shape[1])
            for s in range(0, len(pairs), step):
                p = pairs[s : s + step]
                to = np.add(docs[place[p]], (query[p] * self.docs)[:, None], dtype=np.int64)
                np.add.at(flat, to.reshape(-1), impacts[place[p]].reshape(-1))
        return out


class Batch(Postings):
    """For many queries at once: the documents of a shard that can be among the best of each."""

    def __init__(self, row: dict, wanted: np.ndarray, idf: np.ndarray, mean: float) -> None:
        super().__init__(row, wanted, idf, mean)
        n = len(self.ids)
        order = np.argsort(self.doc.astype(np.uint16) if n <= 1 << 16 else self.doc, kind="stable")
        self.terms, self.parts = self.slot[order], self.impact[order]  # by document, then term
        self.size = np.bincount(self.doc, minlength=n)
        self.start = np.cumsum(self.size) - self.size
        self.by_id = np.argsort(self.ids, kind="stable")
        self.asked = np.zeros(len(wanted), bool)

    def score(self, query: np.ndarray, doc: np.ndarray) -> np.ndarray:
        n = self.size[doc]
        at = ragged(self.start[doc], n)
        self.asked[query] = True
        weights = self.parts[at] * self.asked[self.terms[at]]
        self.asked[query] = False
        return np.bincount(np.repeat(np.arange(len(doc)), n), weights=weights, minlength=len(doc))

    def near(self, asked: Asked, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, rounded scores), as ``Shard.top``; ``floors`` may rise while this runs."""
        ids = self.ids[self.by_id]
        for low in range(0, len(self.ids), STRIPE):
            stripe = Stripe(self, low, min(low + STRIPE, len(self.ids)))
            step = max(1, SUMS // stripe.docs)
            for s in range(0, len(asked), step):
                some = np.arange(s, min(s + step, len(asked)))
                n = np.diff(asked.cuts[s : s + len(some) + 1])
                sums = stripe.sums(np.repeat(np.arange(len(some)), n), asked.slots[asked.cuts[s] : asked.cuts[s + len(some)]], len(some))
                left, right = np.searchsorted(ids, asked.ids[some], "left"), np.searchsorted(ids, asked.ids[some], "right")
                own, copies = np.repeat(np.arange(len(some)), right - left), self.by_id[ragged(left, right - left)] - low
                inside = (copies >= 0) & (copies < stripe.docs)
                sums[own[inside], copies[inside]] = 0
                keep = 1 - (n + 16) * 2.0**-23  # a sum of n positive terms is less by no larger share
                query, doc = candidates(sums, floors[some], keep, k)
                cuts = np.append(np.flatnonzero(np.append(True, query[1:] != query[:-1])), len(query)) if len(query) else np.zeros(1, np.int64)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    q = s + int(query[a])
                    score = self.score(asked.slots[asked.cuts[q] : asked.cuts[q + 1]], doc[a:b] + low)
                    yield q, *leading(self.ids[doc[a:b] + low], np.round(score, DIGITS), k)


def candidates(sums: np.ndarray, floors: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) whose true sum can reach the floor of its row and the ``k`` largest of it; a sum is off by a share of 1 - ``keep`` at most."""
    least = np.maximum((floors - SLACK) * keep, np.finfo(np.float32).tiny)
    row, col = np.divmod(np.flatnonzero(sums >= np.nextafter(least.astype(np.float32), np.float32(0))[:, None]), sums.shape[1])
    many = np.flatnonzero(np.bincount(row, minlength=len(sums)) > 4 * k)
    if len(many):
        kth = np.partition(sums[many], sums.shape[1] - k, axis=1)[:, sums.shape[1] - k]
        least[many] = np.maximum(least[many], (kth * keep[many] - SLACK) * keep[many])
        may = sums[row, col] >= least[row]
        row, col = row[may], col[may]
    return row, col


def leading(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of them, highest scores first, ties to smaller ids."""
    if len(scores) > k:
        may = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[may], scores[may]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


Floors = tuple[np.ndarray, np.ndarray]


class Asked:
    """Queries of a block: ids, keys and the places of their terms among the wanted ones, one query after the other."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, terms: list[np.ndarray]) -> None:
        self.ids, self.keys = ids, keys
        self.cuts = np.append(0, np.cumsum([len(t) for t in terms]))
        self.wanted, slots = np.unique(np.concatenate(terms), return_inverse=True)
        self.slots = slots.astype(np.int32)

    def __len__(self) -> int:
        return len(self.ids)

    def groups(self, groups: int = 8, terms: int = 256) -> np.ndarray:
        """A number for each query; those with one share many of their frequent terms, as texts of a language do."""
        often = np.argsort(-np.bincount(self.slots, minlength=len(self.wanted)), kind="stable")[:terms]
        column = np.full(len(self.wanted), -1)
        column[often] = np.arange(len(often))
        at = column[self.slots]
        has = np.zeros((len(self), len(often)), np.float32)
        has[np.repeat(np.arange(len(self)), np.diff(self.cuts))[at >= 0], at[at >= 0]] = 1
        has /= np.maximum(np.sqrt(has.sum(1, keepdims=True)), 1)
        centres = has[np.linspace(0, len(self) - 1, groups).astype(int)]
        for _ in range(10):
            number = np.argmax(has @ centres.T, axis=1)
            centres = (number == np.arange(groups)[:, None]).astype(np.float32) @ has
            centres /= np.maximum(np.sqrt((centres**2).sum(1, keepdims=True)), 1e-9)
        return number


def searcher(asked: Asked, idf: np.ndarray, mean: float, k: int, floors: Floors):
    """Arrow map: the best of all shards of a task for each query, as far as they come before the query's floor (score, doc_id)."""

    def each(row: dict, at_least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if len(asked) >= MANY:
            yield from Batch(row, asked.wanted, idf, mean).near(asked, at_least, k)
            return
        shard = Shard(row, asked.wanted, idf, mean)
        for i in range(len(asked)):
            yield i, *shard.top(asked.slots[asked.cuts[i] : asked.cuts[i + 1]], k, asked.ids[i], at_least[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_least, before = floors[0].copy(), floors[1].copy()
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                for i, ids, scores in each(row, at_least):
                    better = (scores > at_least[i]) | (scores == at_least[i]) & (ids < before[i])
                    if not better.any():
                        continue
                    ids, scores = leading(np.concatenate([best[i][0], ids[better]]), np.concatenate([best[i][1], scores[better]]), k)
                    best[i] = ids, scores
                    if len(ids) == k:
                        at_least[i], before[i] = scores[-1], ids[-1]
        n = [len(ids) for ids, _ in best]
        cols = [np.repeat(asked.ids, n), np.repeat(asked.keys, n), np.concatenate([ids for ids, _ in best]), np.concatenate([scores for _, scores in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "key", "doc_id", "score"])
        give_back()

    return run


def indexed(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards in the shared folder, each in a row group of its own, so that a level is read without the others."""
    shards = docs.mapInArrow(build(shard_bytes), SHARD)
    path = shared_path(docs.sparkSession, "shards")
    each = {"parquet.block.row.count.limit": 1, "parquet.block.size": 1 << 20, "parquet.page.size.row.check.min": 1}
    shards.write.options(**each).parquet(path)
    return docs.sparkSession.read.schema(shards.schema).parquet(path)


def search(docs: DataFrame, asked: Column, k: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score): for each row of ``docs`` (doc_id, text) where ``asked`` holds, its ``k`` best other documents.

    A query is the set of terms of its whole text; terms are stretches of ASCII letters
    and digits and of any other characters beyond ASCII, A-Z folded.  BM25 with k1 1.2 and
    b 0.75, idf ln(1 + (N - n + 0.5) / (n + 0.5)); scores are rounded to six digits, ties
    go to the smaller doc_id, documents without a common term are no results.  Null
    doc_ids take no part; null and empty texts count in N with length 0, find nothing
    and are not found.  Rows that repeat a doc_id are documents of their own, and a
    query is searched once for each of its rows with a different text.  Other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = documents(docs).filter(F.col("doc_id").isNotNull())
    index = indexed(docs, shard_bytes)
    queries = docs.filter(asked).withColumn("key", row_key("doc_id", "text")).dropDuplicates(["key"])
    queries = stored(queries.mapInArrow(query_rows, "query_id bigint, terms binary, key bigint").filter(F.octet_length("terms") > 0), "queries")
    stats = index.agg(F.sum("docs"), F.sum("words")).first()
    levels = sorted((r["level"] for r in index.select("level").distinct().collect()), reverse=True)
    volume = queries.agg(F.sum(F.octet_length("terms"))).first()[0]
    out = spark.createDataFrame([], FOUND)
    parts = -(-volume // QUERY_BYTES) if volume else 0
    for part in range(parts):
        block = queries.filter(F.pmod("key", F.lit(parts)) == part).orderBy("query_id", "key").collect()
        if not block:
            continue
        asked = grouped(block)
        del block
        n = np.zeros(len(asked.wanted))
        give_back()
        shards = index.select("terms", "offsets").coalesce(2 * spark.sparkContext.defaultParallelism)
        with one_row_batches(spark):
            counted = stored(shards.mapInArrow(frequencies(asked.wanted), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")), "frequencies")
        counted = counted.toArrow()
        n[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
        idf = np.log(1 + (stats[0] - n + 0.5) / (n + 0.5))
        out = out.union(through_levels(index, levels, asked, idf, stats[1] / stats[0], k))
    return best(out, k).select("query_id", "rank", "doc_id", "score")


@contextlib.contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """A row is a whole shard: a task that reads many holds one at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def grouped(block: list[Row]) -> Asked:
    """Queries that are alike next to each other."""
    ids, keys = (np.array([r[c] for r in block], np.int64) for c in ("query_id", "key"))
    terms = [np.frombuffer(r["terms"], "<u8") for r in block]
    order = np.argsort(Asked(ids, keys, terms).groups(), kind="stable")
    return Asked(ids[order], keys[order], [terms[i] for i in order])


FOUND = "query_id bigint, key bigint, doc_id bigint, score double"


def through_levels(index: DataFrame, levels: list[int], asked: Asked, idf: np.ndarray, mean: float, k: int) -> DataFrame:
    """The best of all shards, level after level; what a level has to beat goes to it as one floor for each query."""
    place = {q: i for i, q in enumerate(zip(asked.ids.tolist(), asked.keys.tolist(), strict=True))}
    floors = np.zeros(len(asked)), np.full(len(asked), np.iinfo(np.int64).max)
    tops = index.sparkSession.createDataFrame([], FOUND)
    for one in levels:
        shards = index.filter(F.col("level") == one).coalesce(8 * index.sparkSession.sparkContext.defaultParallelism)
        found = shards.mapInArrow(searcher(asked, idf, mean, k, floors), FOUND)
        with one_row_batches(index.sparkSession):
            tops = stored(best(tops.union(found), k), "tops")
        if one != levels[-1]:
            last = tops.filter(F.col("rank") == k).toArrow()
            at = [place[q] for q in zip(last.column("query_id").to_pylist(), last.column("key").to_pylist(), strict=True)]
            floors[0][at], floors[1][at] = last.column("score").to_numpy(), last.column("doc_id").to_numpy()
        tops = tops.drop("rank")
    return tops


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "doc_id"))
    top = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.select("query_id", "key", "doc_id", "score", "rank")
