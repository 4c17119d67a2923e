"""Near duplicates from DartMinHash signatures of weighted shingle bags.

A text is the bag of its five-word shingles; the similarity of two texts is the
weighted Jaccard similarity of their bags (sum of minima over sum of maxima).

Darts: the half-plane (weight, rank) of every element carries a Poisson process of
unit rate, made by hashes of the element and of dyadic regions, so it is the same in
every task.  A dart hits a text that gives its element at least the dart's weight.
The text draws darts of growing rank until each of ``k`` coordinates, to which a hash
deals the darts, has one; the earliest dart of a coordinate is its value.  Two texts
share a value with a probability equal to their similarity, and a signature costs a
number of darts that depends on ``k`` alone (T. Christiani, 2020).

Grouping: equal texts are one node.  Nodes that share a band of values meet in a
bucket.  In each bucket every node is compared with one pivot, exactly; components of
these links are formed, and a second pass takes another pivot.  Buckets that still hold
several components are then compared in full, in blocks: the members outside the
bucket's largest component against all members, as one product of bag matrices per
pair of blocks, which returns only links that join components.  So the grouping is
complete for the candidates, and no pairs are listed.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import U64, Rolling, Words, documents, slices, splitmix, stored, tasks, unit

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
BASE = -6  # ranks below 2**BASE are one region
SEED = 0xDA27
MEMBERS = 256  # of a bucket in one block


@functools.lru_cache(1)
def words() -> Words:
    return Words((11,))


def bags(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), sorted by document; a text of fewer than ``n`` words has one shingle of all its words."""
    _, doc, _, _, (h,) = words()(column)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    roll = Rolling(17)
    prefix = roll.prefix(h)
    first = np.searchsorted(doc, np.arange(len(column)))
    size = np.searchsorted(doc, np.arange(len(column)), side="right") - first
    short = np.flatnonzero((size > 0) & (size < n))
    start = np.arange(len(doc) - n + 1) if len(doc) >= n else np.zeros(0, np.int64)
    start = start[doc[start] == doc[start + n - 1]]
    starts = np.concatenate([start, first[short]])
    ends = np.concatenate([start + n, first[short] + size[short]])
    d = doc[starts].astype(np.int64)
    s = splitmix(roll.of(prefix, starts, ends))
    mixed = s ^ splitmix(d.astype(U64))
    _, at, count = np.unique(mixed, return_index=True, return_counts=True)
    order = np.argsort(d[at], kind="stable")
    return d[at][order], s[at][order], count[order]


@functools.lru_cache(64)
def poisson(exponent: int) -> np.ndarray:
    """Cumulative probabilities of a Poisson number with mean 2**exponent."""
    mean = 2.0**exponent
    top = int(mean + 12 * math.sqrt(mean) + 20)
    k = np.arange(top)
    logs = k * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in k])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def darts(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, slab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, rank, dart) of all darts of one rank region that hit."""
    low_r, size_r = (0.0, BASE) if slab == 0 else (2.0 ** (BASE + slab - 1), BASE + slab - 1)
    out = []
    step = 0
    chosen = np.arange(len(element))
    while len(chosen):
        low_w, size_w = (0.0, 0) if step == 0 else (2.0 ** (step - 1), step - 1)
        e, w, d = element[chosen], weight[chosen], doc[chosen]
        cell = splitmix(e ^ U64((SEED << 24) + (step << 12) + slab))
        n = np.searchsorted(poisson(size_r + size_w), unit(cell), side="right")
        hit = np.flatnonzero(n)
        n = n[hit]
        turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        dart = splitmix(np.repeat(cell[hit], n) + turn.astype(U64))
        at = low_w + 2.0**size_w * unit(splitmix(dart ^ U64(1)))
        keep = at < np.repeat(w[hit], n)
        rank = low_r + 2.0**size_r * unit(splitmix(dart[keep] ^ U64(2)))
        out.append((np.repeat(d[hit], n)[keep], rank, dart[keep]))
        step += 1
        chosen = chosen[weight[chosen] > 2.0 ** (step - 1)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, U64))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """``docs`` x ``k`` dart values; rows of documents without elements are zero."""
    weight = np.asarray(weight, np.float64)
    total = np.bincount(doc, weights=weight, minlength=docs)
    value = np.zeros(docs * k, U64)
    best = np.full(docs * k, np.inf)
    open_ = total > 0
    slab = 0
    while True:
        more = open_[doc]
        if not more.any():
            return value.reshape(docs, k)
        d, rank, dart = darts(element[more], weight[more], doc[more], slab)
        place = d * k + (splitmix(dart ^ U64(3)) % U64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")  # the earliest is written last
        place, rank, dart = place[order], rank[order], dart[order]
        if len(place):
            seen = rank < best[place]
            place, rank, dart = place[seen], rank[seen], dart[seen]
            best[place] = rank
            value[place] = dart
        slab += 1
        open_ &= ~np.isfinite(best.reshape(docs, k)).all(axis=1)  # later darts have higher ranks


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(signature), bands), U64)
    for r in range(rows):
        h = splitmix(h ^ signature[:, r::rows][:, :bands])
    return splitmix(h + np.arange(bands, dtype=U64))


def sign(bands: int, rows: int, shingle: int):
    """Arrow map: size of the bag and band hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            n = b.num_rows
            doc, element, count = bags(b.column("text"), shingle)
            size = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            h = band_hashes(signatures(doc, element, count, n, bands * rows), bands, rows).view(np.int64)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(h.ravel()), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), pa.array(size), flat], ["doc_id", "node", "size", "bands"])

    return run


def compare(threshold: float, shingle: int):
    """Arrow map: pairs of texts that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, "text_a", 1 << 20), "text_b", 1 << 20):
            n = b.num_rows
            sides = [bags(b.column(c), shingle) for c in ("text_a", "text_b")]
            d, e, c = (np.concatenate(x) for x in zip(*sides, strict=True))
            key = e ^ splitmix(d.astype(U64))
            order = np.argsort(key, kind="stable")
            key, d, c = key[order], d[order], c[order]
            same = np.flatnonzero(key[1:] == key[:-1])
            shared = np.bincount(d[same], weights=np.minimum(c[same], c[same + 1]), minlength=n)
            total = np.bincount(d, weights=c, minlength=n)
            good = (shared > 0) & (shared >= threshold * (total - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(x).filter(pa.array(good)) for x in ("a", "b")], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component of links (a, b).

    Alternating large and small stars (Kiveris and others, 2014): each turn is a few
    aggregations and joins on tables, until every node hangs on one smallest node.
    """
    edges = stored(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        twice = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
        if twice.union(edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select("a")).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("a"), F.col("m").alias("b")).union(joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = stored(small.distinct(), "links")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, component) after more links (a, b), which are first lifted to components."""
    if labels is None:
        return stored(components(links), "labels")

    def lifted(df: DataFrame, c: str) -> DataFrame:
        own = labels.select(F.col("node").alias(c), F.col("component").alias("up"))
        return df.join(own, c, "left").withColumn(c, F.coalesce("up", c)).drop("up")

    above = stored(components(lifted(lifted(links.select("a", "b"), "a"), "b")), "labels")
    old = labels.join(above.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    new = above.join(labels.select("node"), "node", "left_anti")
    return stored(old.select("node", F.coalesce("top", "component").alias("component")).union(new.select("node", "component")), "labels")


def elements(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, element): a shingle that occurs n times is n elements, so set overlap is bag overlap."""
    doc, s, count = bags(column, shingle)
    turn = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(doc, count), splitmix(np.repeat(s, count) + turn.astype(U64))


def joining(threshold: float, shingle: int):
    """Arrow map over rows sorted by (band, p, q): links that join components, of each pair of blocks."""

    def links_of(rows: pa.RecordBatch, doc: np.ndarray, element: np.ndarray) -> list[tuple[bytes, bytes]]:
        left = np.array(rows.column("left").to_pylist(), bool)
        if left.all() or not left.any():
            return []
        n = rows.num_rows
        size = np.bincount(doc, minlength=n)
        _, slot, count = np.unique(element, return_inverse=True, return_counts=True)
        shared = count[slot] > 1
        _, slot = np.unique(slot[shared], return_inverse=True)
        x = np.zeros((n, int(slot.max()) + 1 if len(slot) else 1), np.float32)
        x[doc[shared], slot] = 1
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        both = np.rint(x[a] @ x[b].T).astype(np.int64)
        good = (both > 0) & (both >= threshold * (size[a][:, None] + size[b][None, :] - both) - 1e-9)
        node, component = rows.column("node").to_pylist(), rows.column("component").to_pylist()
        top: dict[bytes, bytes] = {}

        def find(c: bytes) -> bytes:
            while top.get(c, c) != c:
                c = top[c]
            return c

        out = []
        for i, j in zip(*np.nonzero(good), strict=True):
            one, two = find(component[a[i]]), find(component[b[j]])
            if one != two:
                top[max(one, two)] = min(one, two)
                out.append((node[a[i]], node[b[j]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the group that may go on

        def solved(group: pa.RecordBatch) -> list[tuple[bytes, bytes]]:
            doc, element = elements(group.column("text"), shingle)
            keys = list(zip(*(group.column(c).to_pylist() for c in ("band", "p", "q")), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            first = np.searchsorted(doc, cuts)
            out = []
            for k in range(len(cuts) - 1):
                here = slice(first[k], first[k + 1])
                out += links_of(group.slice(cuts[k], cuts[k + 1] - cuts[k]), doc[here] - cuts[k], element[here])
            return out

        def batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for b in slices(batches, "text", 1 << 21):
            if held and any(held[-1].column(c)[-1] != b.column(c)[0] for c in ("band", "p", "q")):
                yield batch(solved(joined_rows(held)))
                held = []
            last = b.num_rows - 1
            while last and all(b.column(c)[last - 1] == b.column(c)[last] for c in ("band", "p", "q")):
                last -= 1
            if last:
                yield batch(solved(joined_rows([*held, b.slice(0, last)])))
                held = []
            held.append(b.slice(last))
        if held:
            yield batch(solved(joined_rows(held)))

    return run


def joined_rows(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, class_id, first) for every row of ``docs`` (doc_id, text).

    ``node`` is a digest of the text, ``class_id`` the smallest doc_id of its class:
    the texts connected by similarities of at least ``threshold``.  ``first`` marks the
    rows of the document that names the class.  Equal texts are one node.  A text of one to four words is one shingle.  Null and blank texts have
    no shingles: each keeps its own doc_id as class (so blank texts with equal ids
    share it).  Repeated rows get a row each; a null doc_id is a member but never
    names a class, unless it has nothing else (null).  Other columns are ignored; an
    empty table gives no rows.
    """
    docs = documents(docs).select("doc_id", F.unhex(F.md5("text")).alias("node"), "text")
    signed = stored(docs.mapInArrow(sign(bands, rows, shingle), "doc_id bigint, node binary, size bigint, bands array<bigint>"), "signatures")
    nodes = signed.filter("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    met = stored(shared_buckets(nodes.select("node", "size", F.explode("bands").alias("band"))), "buckets")
    texts = docs.select("node", "text").join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(texts, "texts")
    fits = F.least("size", "o_size") >= F.lit(threshold) * F.greatest("size", "o_size") - 1e-9

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
        full = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        return full.select("a", "b", "text_a", "text_b").mapInArrow(compare(threshold, shingle), "a binary, b binary")

    def against_pivot(members: DataFrame, pivot) -> DataFrame:
        pivots = members.groupBy("band").agg(pivot(F.struct("node", "size", *(["component"] if "component" in members.columns else []))).alias("p"))
        return members.join(pivots, "band").select(members["*"], F.col("p.node").alias("other"), F.col("p.size").alias("o_size"), *([F.col("p.component").alias("o_component")] if "component" in members.columns else []))

    labels = merged(None, verified(against_pivot(met, F.min).filter(fits & (F.col("node") != F.col("other")))))

    def open_buckets() -> DataFrame:
        """Members of buckets that still hold several components."""
        labelled = met.join(labels, "node", "left").select("node", "size", "band", F.coalesce("component", "node").alias("component"))
        mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
        return stored(labelled.join(mixed.select("band"), "band", "left_semi"), "buckets")

    labels = merged(labels, verified(against_pivot(open_buckets(), F.max).filter(fits & (F.col("component") != F.col("o_component")))))
    labels = merged(labels, in_full(open_buckets(), texts, threshold, shingle))
    members = signed.select("doc_id", "node", "size").join(labels, "node", "left")
    members = members.select("doc_id", "node", F.when(F.col("size") > 0, F.coalesce("component", "node")).alias("component"))
    least = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "node")).alias("least")
    names = members.filter(F.col("component").isNotNull()).groupBy("component").agg(least)
    named = members.join(names, "component", "left")
    alone = F.col("component").isNull()
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("node") == F.col("least.node"))
    return named.select("doc_id", "node", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"), (alone | first).alias("first"))


def in_full(members: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Links (a, b) that join components of members (node, size, band, component) of one band, all pairs compared in blocks."""
    sizes = members.groupBy("band", "component").agg(F.count("*").alias("n"))
    bands = sizes.groupBy("band").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"))
    blocks = lambda n: F.ceil(n / MEMBERS).cast("int")
    bands = bands.select("band", F.col("top.component").alias("top"), blocks(F.col("all") - F.col("top.n")).alias("n_p"), blocks(F.col("all")).alias("n_q"))
    full = members.join(bands, "band").join(texts, "node")
    h = F.xxhash64("node")
    out = lambda p, q, left: [F.col("band"), p.alias("p"), q.alias("q"), F.lit(left).alias("left"), F.col("node"), F.col("component"), F.col("text")]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = full.filter("component != top").withColumn("other", every("n_q")).select(*out(F.pmod(h, F.col("n_p")).cast("int"), F.col("other"), True))
    rest = full.withColumn("other", every("n_p")).select(*out(F.col("other"), F.pmod(h, F.col("n_q")).cast("int"), False))
    dealt = few.union(rest).repartition(tasks(members.sparkSession), "band", "p", "q").sortWithinPartitions("band", "p", "q")
    return dealt.mapInArrow(joining(threshold, shingle), "a binary, b binary")


def shared_buckets(members: DataFrame) -> DataFrame:
    """Members (node, size, band) of buckets with at least two nodes."""
    many = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    return members.join(many, "band", "left_semi").select("node", "size", "band")
