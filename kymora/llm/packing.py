"""Packing of token ids into sequences: first-fit decreasing in randomised groups.

Every document is its ids and an end id.  Whole stretches of ``capacity`` ids fill
sequences of their own; what is left of each document is packed by first-fit
decreasing.  Documents are dealt to groups by a hash, a group is a bounded block of
documents, and the groups are packed independently.  Inside a group the first bin
with room is found in a tournament tree over the free capacity of all bins.

Documents may be cut: gaps of at least ``least_cut`` ids are filled with ids of the
emptiest bins, and what a group has over is cut into sequences of power-of-two
lengths, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kymora.llm.byte_pieces import encoder
from kymora.llm.common import U64, documents, slices, splitmix, tasks

CAPACITY, GROUP, LEAST_CUT = 1024, 4096, 16
MASK = (1 << 64) - 1
SPAN = 64  # full sequences moved in one row
SEEN = 1 << 20  # documents of a task that are remembered to tell copies apart


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; ties go to the earlier item, items to the first bin with room.

    ``tree`` is a tournament: each node holds the most room of any bin below it.
    """
    leaves = 1 << max(0, (max(len(sizes), 1) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins: list[list[int]] = []
    order = np.argsort(-np.asarray(sizes), kind="stable")
    for i, size in zip(order.tolist(), np.asarray(sizes)[order].tolist(), strict=True):
        node = 1
        while node < leaves:
            node *= 2
            node += tree[node] < size
        b = node - leaves
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins


def settle(bins: list[list[int]], sizes: np.ndarray, capacity: int, least_cut: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length): gaps filled from the emptiest bins, the rest in powers of two."""
    rows = [[(i, 0, int(sizes[i])) for i in b] for b in bins]
    fill = [sum(p[2] for p in r) for r in rows]
    order = sorted(range(len(rows)), key=lambda b: (-fill[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        into, donor = order[lo], order[hi]
        gap = capacity - fill[into]
        if gap < least_cut or not gap:
            lo += 1
            continue
        item, start, length = rows[donor].pop()
        take = min(gap, length)
        rows[into].append((item, start + length - take, take))
        if take < length:
            rows[donor].append((item, start, length - take))
        fill[into] += take
        fill[donor] -= take
        if not rows[donor]:
            hi -= 1
    out = [rows[b] for b in order[: hi + 1] if rows[b]]
    if out and sum(p[2] for p in out[-1]) <= capacity - max(least_cut, 1):
        out.extend(powers_of_two(out.pop()))
    return out


def powers_of_two(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A bin cut in order into sequences whose lengths are the binary digits of its fill."""
    left = sum(p[2] for p in row)
    out: list[list[tuple[int, int, int]]] = []
    todo = list(reversed(row))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            item, start, length = todo.pop()
            take = min(room, length)
            out[-1].append((item, start, take))
            if take < length:
                todo.append((item, start + take, length - take))
            room -= take
    return out


def id_rows(path: str, end_id: int, capacity: int):
    """Arrow map: documents as rows of ids: spans of full sequences and one remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        seen: dict[int, int] = {}
        for b in slices(batches, "text", 1 << 21):
            ids = enc.encode([t or "" for t in b.column("text").to_pylist()]).split()
            doc, first, total, group, data = [], [], [], [], []
            for d, x in zip(b.column("doc_id").to_pylist(), ids, strict=True):
                x = np.append(x, np.uint32(end_id)).astype("<u4")
                full = len(x) // capacity * capacity
                cuts = [*range(0, full, SPAN * capacity), *([full] if full < len(x) else [])]
                key = (zlib.crc32(x.tobytes()) << 32) ^ (d or 0)
                if len(seen) == SEEN and key not in seen:
                    seen.clear()
                copy = seen[key] = seen.get(key, -1) + 1  # equal rows spread over groups
                for c in cuts:
                    doc.append(d)
                    first.append(c)
                    total.append(len(x))
                    group.append((key + 0x9E3779B97F4A7C15 * (c + 1) + (copy << 20)) & MASK)
                    data.append(x[c : min(c + SPAN * capacity, full) if c < full else len(x)].tobytes())
            g = np.array(group, U64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(total, pa.int64()), pa.array(splitmix(g).view(np.int64)), pa.array(data, pa.binary())],
                ["doc_id", "start", "doc_tokens", "group", "ids"],
            )

    return run


def packer(capacity: int, group: int, least_cut: int):
    """Arrow map: rows of ids in random order, packed block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        rest: list[tuple[int | None, int, int, bytes]] = []
        out: list[list] = [[] for _ in range(6)]

        def emit(row, start: int, length: int, sequence: int, offset: int) -> None:
            d, first, total, data = row
            for o, v in zip(out, (d, first + start, total, sequence, offset, data[4 * start : 4 * (start + length)]), strict=True):
                o.append(v)

        def ready() -> pa.RecordBatch:
            nonlocal out
            cols = [pa.array(o, pa.binary() if k == 5 else pa.int64()) for k, o in enumerate(out)]
            out = [[] for _ in range(6)]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids"])

        def close() -> None:
            nonlocal number, rest
            sizes = np.array([len(r[3]) // 4 for r in rest], np.int64)
            for sequence in settle(first_fit_decreasing(sizes, capacity), sizes, capacity, least_cut):
                at = 0
                for item, start, length in sequence:
                    emit(rest[item], start, length, number, at)
                    at += length
                number += 1
            rest = []

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                n = len(row[3]) // 4
                if n % capacity:
                    rest.append(row)
                    if len(rest) == group:
                        close()
                else:
                    for s in range(0, n, capacity):
                        emit(row, s, capacity, number, 0)
                        number += 1
                if len(out[0]) >= 2048:
                    yield ready()
        close()
        yield ready()

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, group: int = GROUP, least_cut: int = LEAST_CUT) -> DataFrame:
    """Pieces (doc_id, start, doc_tokens, sequence_id, offset, ids) of all documents.

    ``ids`` is little-endian unsigned 32-bit; ``start`` counts the ids of the document
    before the piece, ``offset`` those of the sequence.  A null or empty text is the
    end id alone.  Repeated rows and null doc_ids are packed like any other; rows of
    equal content are dealt to different groups.  Other columns are ignored; an empty
    table gives no rows.  How documents meet in sequences depends on the number of
    shuffle partitions; the ids of each document do not.
    """
    docs = documents(docs)
    rows = docs.mapInArrow(id_rows(path, end_id, capacity), "doc_id bigint, start bigint, doc_tokens bigint, group bigint, ids binary")
    # A task that runs again must pack alike, whatever order its rows arrive in.
    dealt = rows.repartition(tasks(docs.sparkSession), "group").sortWithinPartitions("group", "doc_id", "start")
    return dealt.mapInArrow(packer(capacity, group, least_cut), "doc_id bigint, start bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
