"""Removal of passages that occur before, found level by level with doubled probe lengths.

A window of ``window`` words can only repeat if every stretch inside it repeats.  Each
level probes every window still in question by one stretch of a given length, chosen
by content (the stretch with the smallest hash), so equal windows probe equal
stretches and neighbouring windows mostly share one.  Windows whose stretch occurs
once drop out; the others are probed at twice the length, until the stretch is the
window itself or nothing survives.  At the last level the occurrences of a window
meet, sorted by document and place, and all but the first are removed.

Every task reports a stretch once, however often it has seen it, so a passage that
fills a third of all documents puts no more than one row per batch on its key.
Sorted runs are read as a stream; no group is ever held in memory.  Equal texts take
part once: all later copies of a text of at least ``window`` words are covered whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import LOW, U64, Rolling, Words, documents, ragged, slices, splitmix, tasks

WINDOW, FIRST_PROBE = 20, 10
SLICE = 1 << 20


@functools.lru_cache(1)
def words() -> Words:
    return Words((11, 29))


def window_starts(doc: np.ndarray, window: int) -> np.ndarray:
    """First words of all windows of one document each."""
    n = len(doc) - window + 1
    return np.flatnonzero(doc[:n] == doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)


def probes(h: np.ndarray, starts: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: first word of its probe, and the hashes of all stretches of that length."""
    roll = Rolling(17)
    every = np.arange(len(h) - length + 1)
    stretch = splitmix(roll.of(roll.prefix(h), every, every + length))
    if length == window:
        return starts, stretch
    view = np.lib.stride_tricks.sliding_window_view(stretch, window - length + 1)
    return starts + view[starts].argmin(axis=1), stretch


def seek(window: int, length: int, before: int | None):
    """Arrow map: stretches of one level.

    Rows (h, r, pos, sure): an occurrence seen once in this batch; or one that is surely
    repeated; or, without r, the news that this batch holds h more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            doc, h, starts = candidates(b, window, before)
            if not len(starts):
                continue
            at, stretch = probes(h[0], starts, window, length)
            at = np.unique(at)
            value = stretch[at]
            r = b.column("r").to_numpy(zero_copy_only=False)[doc[at]]
            pos = at - np.searchsorted(doc, doc[at])
            _, first, group, n = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
            again = n[group] > 1
            away = splitmix(at.astype(U64) ^ r.view(U64))
            news = first[n > 1]
            hh = np.concatenate([np.where(again, away, value), value[news]]).view(np.int64)
            none = np.zeros(len(hh), bool)
            none[len(at) :] = True
            cols = [
                pa.array(hh),
                pa.array(np.concatenate([r, r[news]]), mask=none),
                pa.array(np.concatenate([pos, pos[news]]).astype(np.int32), mask=none),
                pa.array(np.concatenate([again, np.zeros(len(news), bool)])),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["h", "r", "pos", "sure"])

    return run


def candidates(b: pa.RecordBatch, window: int, before: int | None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Words of a batch and the windows still in question: those whose last probe survived."""
    _, doc, _, _, h = words()(b.column("text"))
    starts = window_starts(doc, window)
    if before is None or not len(starts):
        return doc, h, starts
    at, _ = probes(h[0], starts, window, before)
    first = np.searchsorted(doc, np.arange(b.num_rows))
    kept = b.column("kept")
    sizes = np.diff(kept.offsets.to_numpy())
    alive = np.zeros(len(doc) + 1, bool)
    place = np.repeat(first, sizes) + kept.flatten().to_numpy()
    alive[np.minimum(place, len(doc))] = True
    return doc, h, starts[alive[at]]


def runs(keys: tuple[str, ...], only_later: bool):
    """Arrow map over sorted rows: those whose keys equal a neighbour's (the one before, or either one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, until its next one is known
        matched = False
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            n = b.num_rows
            same = np.ones(n - 1, bool)
            for c in keys:
                v = b.column(c).to_numpy(zero_copy_only=False)
                same &= v[1:] == v[:-1]
            sure = b.column("sure").to_numpy(zero_copy_only=False)
            hit = np.append(matched, same)
            if only_later:  # a repeated row is the same place
                place = [b.column(c).to_numpy(zero_copy_only=False) for c in ("r", "pos")]
                hit[1:] &= (place[0][1:] != place[0][:-1]) | (place[1][1:] != place[1][:-1])
            else:
                hit[:-1] |= same
            hit |= sure
            held, matched = b.slice(n - 1), bool(hit[-1])
            yield chosen(b.slice(0, n - 1), hit[:-1])
        if held is not None:
            yield chosen(held, np.array([matched]))

    def chosen(b: pa.RecordBatch, hit: np.ndarray) -> pa.RecordBatch:
        mask = pa.array(hit & b.column("r").is_valid().to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([b.column(c).filter(mask) for c in out], out)

    out = ["r", "d", "pos", "length"] if only_later else ["r", "pos"]
    return run


def occurrences(window: int, before: int):
    """Arrow map: windows in question. The first of each in this batch, and stretches of later ones that are sure to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            doc, h, at = candidates(b, window, before)
            if not len(at):
                continue
            roll = Rolling(23)
            one, two = (splitmix(roll.of(roll.prefix(x), at, at + window)) for x in h)
            r, d = (b.column(c).to_numpy(zero_copy_only=False)[doc[at]] for c in ("r", "d"))
            pos = at - np.searchsorted(doc, doc[at])
            order = np.lexsort((pos, r, d, two, one))
            later = np.zeros(len(at), bool)
            equal = [x[order][1:] == x[order][:-1] for x in (one, two, r, pos)]
            later[order[1:]] = equal[0] & equal[1] & ~(equal[2] & equal[3])  # a repeated row is the same place
            first = np.flatnonzero(~later)
            gone = np.flatnonzero(later)  # in text order: neighbours make one stretch
            new = np.append(True, (np.diff(at[gone]) != 1) | (np.diff(doc[at[gone]]) != 0)) if len(gone) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(gone))) + window - 1
            lead = gone[head]
            away = splitmix(at[lead].astype(U64) ^ r[lead].view(U64))
            cols = [
                pa.array(np.concatenate([one[first], away]).view(np.int64)),
                pa.array(np.concatenate([two[first], away]).view(np.int64)),
                pa.array(np.concatenate([d[first], d[lead]])),
                pa.array(np.concatenate([r[first], r[lead]])),
                pa.array(np.concatenate([pos[first], pos[lead]]).astype(np.int32)),
                pa.array(np.concatenate([np.full(len(first), window), size]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(len(first), bool), np.ones(len(lead), bool)])),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["h", "h2", "d", "r", "pos", "length", "sure"])

    return run


def finish(window: int, columns: list[str]):
    """Arrow map: words kept of each row, as one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            total, removed, kept = [], [], []
            for text, d, first, cuts in zip(*(b.column(c).to_pylist() for c in ("text", "d", "first", "cuts")), strict=True):
                w = (text or "").encode().split()
                n = len(w)
                if not first and n >= window:
                    w = []  # a later copy
                elif cuts:
                    change = np.zeros(n + 1, np.int64)
                    mine = [(c["pos"], c["length"]) for c in cuts if c["d"] == d and c["pos"] + c["length"] <= n]
                    for p, length in mine:
                        change[p] += 1
                        change[p + length] -= 1
                    w = list(compress(w, (np.cumsum(change)[:n] == 0).tolist()))
                total.append(n)
                removed.append(n - len(w))
                kept.append(b" ".join(w))
            cols = [*(b.column(c) for c in columns), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*columns, "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, first_probe: int = FIRST_PROBE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep`` columns, n_words, n_removed, kept) for every row of ``docs`` (doc_id, text).

    ``kept`` holds the words, joined by one space, that no window covers which starts
    earlier: in a smaller doc_id, or in the same document at an earlier word.  Windows
    are judged on the input.  Null text has no words.  Rows equal in doc_id and text are
    one document and each gets its result; different texts under one doc_id are
    different documents, ordered by a hash; a null doc_id counts as smallest.  Texts
    shorter than the window are kept whole.  Columns other than ``keep`` are ignored; an
    empty table gives no rows.  ``first_probe`` doubles up to ``window``.
    """
    lengths = [first_probe]
    while lengths[-1] < window:
        lengths.append(min(2 * lengths[-1], window))
    n = tasks(docs.sparkSession)
    more = [c for c in keep if c not in ("doc_id", "text")]
    base = documents(docs, *more)
    base = base.withColumn("d", F.coalesce("doc_id", F.lit(LOW))).withColumn("r", F.xxhash64("d", "text"))
    firsts = base.filter(F.col("text").isNotNull()).groupBy(F.md5("text").alias("node")).agg(F.min(F.struct("d", "r")).alias("x"))
    firsts = firsts.select(F.col("x.r").alias("r"), F.lit(True).alias("first")).distinct()
    texts = base.select("doc_id", *more, "d", "r", "text")
    kept, before = None, None
    for length in lengths[:-1]:
        source = texts if kept is None else texts.join(kept, "r")
        found = source.mapInArrow(seek(window, length, before), "h bigint, r bigint, pos int, sure boolean")
        alive = found.repartition(n, "h").sortWithinPartitions("h").mapInArrow(runs(("h",), False), "r bigint, pos int")
        kept, before = alive.groupBy("r").agg(F.collect_set("pos").alias("kept")), length
    asked = texts.join(firsts.select("r") if kept is None else kept.join(firsts, "r", "left_semi"), "r")  # all columns, so that the shuffle of the texts serves twice
    met = asked.mapInArrow(occurrences(window, before), "h bigint, h2 bigint, d bigint, r bigint, pos int, length int, sure boolean")
    met = met.repartition(n, "h").sortWithinPartitions("h", "h2", "d", "r", "pos")
    gone = met.mapInArrow(runs(("h", "h2"), True), "r bigint, d bigint, pos int, length int")
    cuts = gone.groupBy("r").agg(F.collect_list(F.struct("d", "pos", "length")).alias("cuts"))
    known = firsts.join(cuts, "r", "left")
    full = texts.join(known, "r", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    names = ["doc_id", *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*names).schema)
    return full.mapInArrow(finish(window, names), f"{schema}, n_words bigint, n_removed bigint, kept string")
