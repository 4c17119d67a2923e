"""Sampled SentencePiece segmentations, and their decoding.

A text, with its blanks as U+2581 and one more in front, is a lattice of vocabulary
pieces.  A segmentation is drawn with a probability proportional to the product of
piece weights, by filtering forward (the weight of all ways to reach a place) and
sampling backward (a last piece, then the one before it).  Where two neighbouring
characters stand together in no piece, every segmentation breaks there: the lattice
falls apart into units.  All new units of a block are filtered together, place by place;
a table keeps short ones for later blocks, and all their occurrences are sampled together.

Weights follow the order of the vocabulary, 1 / (2 + rank) ** power, as merge scores are
ranks and not probabilities.  A character that is no piece, and a mark that stands in
the text itself, are spelled in byte pieces, so decoding gives the text back exactly.
Draws are hashes of (seed, row key, unit, step): the same in every run and partition.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.llm.common import U64, Rolling, documents, ragged, row_key, slices, splitmix, unit

PIECE_BITS = 24  # of an edge's number for its piece
MARK, LITERAL = "▁", 0x110000
BLOCK, CACHE, SHORT = 1 << 18, 6_000_000, 64  # characters of a block; edges, and characters of a unit, that the table keeps
LOW, HIGH = 1e-200, 1e200
POWER, SEED = 1.0, 1


class Lattices:
    """Pieces of a model, and the filtered lattice of each distinct unit."""

    def __init__(self, path: str, power: float) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = {}
        self.spelled: list[bytes] = [b""] * n
        pieces = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.spelled[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces.append((piece, i))
                self.spelled[i] = piece.replace(MARK, " ").encode()
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces, so it cannot spell every text")
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece holds a mark after another character, so a long text cannot be cut before blanks")
        self.letters = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.width = np.array([len(s) for s in self.spelled])
        self.place = np.cumsum(self.width) - self.width
        chars = sorted({c for p, _ in pieces for c in p})
        self.code = np.zeros(LITERAL + 1, np.int32)  # 0: in no piece
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        pairs = np.array(sorted({(ord(a), ord(b)) for p, _ in pieces for a, b in zip(p, p[1:], strict=False)})).reshape(-1, 2)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.joined[self.code[pairs[:, 0]], self.code[pairs[:, 1]]] = True
        lead = min(i for _, i in pieces)
        self.pieces = ahocorasick.Automaton()
        self.numbers = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.weights = np.zeros(n + 1)
        for p, i in pieces:
            self.pieces.add_word(p, (i + 1, len(p), 10.0 ** len(p) * (2 + i - lead) ** -power))  # a factor for each character keeps products near 1
            self.numbers.add_word(p, i + 1)
            self.weights[i + 1] = self.pieces.get(p)[2]
        self.pieces.make_automaton()
        self.numbers.make_automaton()
        self.chars = np.ones(n + 1, np.int64)  # of piece i at i + 1; a byte spelling is one character
        self.chars[[i + 1 for _, i in pieces]] = [len(p) for p, _ in pieces]
        self.longest = max(len(p) for p, _ in pieces)
        self.byte_weight = (2.0 + n) ** -power
        self.table = Table()

    def spell(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]

    def lattice(self, text: str) -> tuple[int, bytes, bytes]:
        """Places, and of each edge: its end and piece in one number, and the weight of all ways through it; byte spellings have piece -1.

        An automaton tells the pieces that end at each place, the longest first, so the
        sums at all their starts are complete.
        """
        n = len(text)
        total = [1.0] + [0.0] * n
        edges, weights = [], []
        add_edge, add_weight = edges.append, weights.append

        def spelled(e: int) -> None:
            w = total[e - 1] * 10.0 * self.byte_weight ** len(text[e - 1].encode("utf-8", "surrogatepass"))
            total[e] += w
            add_edge(e << PIECE_BITS)
            add_weight(w)

        def level(e: int) -> None:
            """Bring all sums that a piece can still start from back to a middling size."""
            lift = 1.0 / total[e]
            for s in range(max(0, e - self.longest), e + 1):
                total[s] *= lift

        done, single = 0, True  # places that are complete
        for last, (piece, length, weight) in self.pieces.iter(text):
            e = last + 1
            while done < e:  # close the place before, and those where no piece ends
                if not single:
                    spelled(done)
                if not LOW < total[done] < HIGH:
                    level(done)
                done += 1
                single = False
            w = total[e - length] * weight
            total[e] += w
            add_edge((e << PIECE_BITS) + piece)
            add_weight(w)
            if length == 1:
                single = True
        while done <= n:
            if not single:
                spelled(done)
            if not LOW < total[done] < HIGH:
                level(done)
            done += 1
            single = False
        return n, array("q", edges).tobytes(), array("d", weights).tobytes()

    def together(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lattices of short units that follow each other in ``points``: place (0 on), piece and weight of each edge, and the units whose sums left the middling sizes.

        All units take the same step at once: sums at the places that are ``p`` characters in.
        """
        starts = np.cumsum(lengths) - lengths
        unit_of = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(len(points)) - starts[unit_of] + 1
        found = np.fromiter(chain.from_iterable(self.numbers.iter(text_of(points))), np.int64).reshape(-1, 2)
        end, piece = found[:, 0], found[:, 1]
        own = self.chars[piece] <= inside[end]  # else a piece that begins in the unit before
        end, piece = end[own], piece[own]
        weight = self.weights[piece]
        spelled = np.ones(len(points), bool)
        spelled[end[self.chars[piece] == 1]] = False
        if spelled.any():
            at = np.flatnonzero(spelled)
            size = 1 + (points[at] >= 0x80) + (points[at] >= 0x800) + (points[at] >= 0x10000)
            end, piece = np.append(end, at), np.append(piece, np.zeros(len(at), np.int64))
            weight = np.append(weight, 10.0 * self.byte_weight ** np.arange(5.0)[size])
            order = np.argsort(end, kind="stable")
            end, piece, weight = end[order], piece[order], weight[order]
        longest = int(lengths.max(initial=0))
        total = np.zeros((longest + 1, len(lengths)))
        total[0] = 1.0
        step = inside[end]
        order = np.argsort(step.astype(np.uint8), kind="stable")
        cuts = np.cumsum(np.bincount(step, minlength=longest + 1))
        unit, back = unit_of[end[order]], (step - self.chars[piece])[order]
        through = weight[order]
        for p in range(1, longest + 1):
            now = slice(cuts[p - 1], cuts[p])
            through[now] *= total[back[now], unit[now]]
            total[p] = np.bincount(unit[now], weights=through[now], minlength=len(lengths))
        weight[order] = through
        sums = total[inside, unit_of]
        return end, piece, weight, np.unique(unit_of[~((sums > LOW) & (sums < HIGH))])

    def edges(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units that follow each other in ``points``: the first edge of each place, and for each edge its piece and the chance that it or one before it is drawn there."""
        starts = np.cumsum(lengths) - lengths
        few = np.flatnonzero(lengths <= SHORT)
        at = ragged(starts[few], lengths[few])
        end, piece, weight, odd = self.together(points[at], lengths[few])
        parts = [(at[end], piece, weight)]
        if len(odd):
            keep = ~np.isin(np.repeat(np.arange(len(few)), lengths[few])[end], odd)
            parts = [(at[end[keep]], piece[keep], weight[keep])]
        for u in np.concatenate([few[odd], np.flatnonzero(lengths > SHORT)]).tolist():
            _, packed, weights = self.lattice(text_of(points[starts[u] : starts[u] + lengths[u]]))
            packed = np.frombuffer(packed, np.int64)
            parts.append((starts[u] + (packed >> PIECE_BITS) - 1, packed & ((1 << PIECE_BITS) - 1), np.frombuffer(weights, np.float64)))
        end, piece, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(parts) > 1:
            order = np.argsort(end, kind="stable")
            end, piece, weight = end[order], piece[order], weight[order]
        count = np.bincount(end, minlength=len(points))
        first = np.cumsum(count) - count
        chance = weight / np.bincount(end, weights=weight, minlength=len(points))[end]
        nth = np.arange(len(end)) - first[end]
        by_nth = np.argsort(nth, kind="stable")
        cuts = np.cumsum(np.bincount(nth))
        for a, b in zip(cuts, cuts[1:], strict=False):  # added up place by place, so that a unit has the same chances in every block
            e = by_nth[a:b]
            chance[e] += chance[e - 1]
        chance[first + count - 1] = 2.0
        return first, piece - 1, chance

    def filtered(self, hashes: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Where the places of distinct units begin in the table; ``hashes`` ascend.  What is not kept stays until the next call."""
        table = self.table
        table.trim()
        base = table.find(hashes, points, starts, lengths)
        new = np.flatnonzero(base < 0)
        if len(new):
            new = new[np.argsort(lengths[new] > SHORT, kind="stable")]  # what stays comes first
            own = points[ragged(starts[new], lengths[new])]
            base[new] = table.add(hashes[new], own, lengths[new], *self.edges(own, lengths[new]))
        return base

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        text = self.letters[ragged(self.place[ids], self.width[ids])].tobytes().decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


class Table:
    """Lattices of units: short ones by hash for later blocks, others until the next block.

    As the edges become too many, units stay that came in two blocks at least, or none.
    """

    def __init__(self) -> None:
        self.hashes, self.unit = np.zeros(0, U64), np.zeros(0, np.int64)  # ascending
        self.base, self.length, self.blocks = (np.zeros(0, np.int64) for _ in range(3))  # by unit
        self.places = self.edges = 0  # of the units that are kept
        self.first, self.points = np.zeros(0, np.int64), np.zeros(0, np.uint32)  # by place
        self.piece, self.chance = np.zeros(0, np.int32), np.zeros(0)  # by edge

    def find(self, hashes: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Begin of each unit, -1 if it is not here: same hash and same characters."""
        out = np.full(len(hashes), -1)
        spot = np.searchsorted(self.hashes, hashes)
        here = np.flatnonzero(spot < len(self.hashes))
        here = here[self.hashes[spot[here]] == hashes[here]]
        u = self.unit[spot[here]]
        same = self.length[u] == lengths[here]
        here, u = here[same], u[same]
        if len(here):
            equal = self.points[ragged(self.base[u], lengths[here])] == points[ragged(starts[here], lengths[here])]
            same = np.logical_and.reduceat(equal, np.cumsum(lengths[here]) - lengths[here])
            here, u = here[same], u[same]
        out[here] = self.base[u]
        self.blocks[u] += 1
        return out

    def add(self, hashes: np.ndarray, points: np.ndarray, lengths: np.ndarray, first: np.ndarray, piece: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Begin of each of the new units, short ones first."""
        base = self.places + np.cumsum(lengths) - lengths
        self.first = put(self.first, self.places, self.edges + first)
        self.points = put(self.points, self.places, points)
        self.piece = put(self.piece, self.edges, piece)
        self.chance = put(self.chance, self.edges, chance)
        spot = np.searchsorted(self.hashes, hashes)
        taken = np.append(self.hashes, U64(0))[spot] == hashes  # by a unit of other characters
        taken &= spot < len(self.hashes)
        short = np.flatnonzero(lengths <= SHORT)
        if len(short):
            n = int(lengths[short].sum())
            enter = short[~taken[short]]
            enter = enter[np.argsort(hashes[enter], kind="stable")]
            spot = spot[enter]
            self.hashes, self.unit = np.insert(self.hashes, spot, hashes[enter]), np.insert(self.unit, spot, len(self.base) + enter)
            self.base, self.length = np.append(self.base, base[short]), np.append(self.length, lengths[short])
            self.blocks = np.append(self.blocks, np.ones(len(short), np.int64))
            self.edges += int(first[n]) if n < len(first) else len(piece)
            self.places += n
        return base

    def trim(self) -> None:
        if self.edges <= CACHE and len(self.piece) <= 4 * CACHE:
            return
        keep = np.flatnonzero(self.blocks[self.unit] > 1)
        u = self.unit[keep]
        at = ragged(self.base[u], self.length[u])
        ends = np.append(self.first[1 : self.places], self.edges)
        count = ends[at] - self.first[at]
        if int(count.sum()) > CACHE // 2:
            self.__init__()
            return
        edges = ragged(self.first[at], count)
        self.first, self.points = np.cumsum(count) - count, self.points[at]
        self.piece, self.chance = self.piece[edges], self.chance[edges]
        self.hashes, self.unit, self.length = self.hashes[keep], np.arange(len(keep)), self.length[u]
        self.base, self.blocks = np.cumsum(self.length) - self.length, np.ones(len(keep), np.int64)
        self.places, self.edges = len(at), len(edges)


def put(old: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """``old`` with ``new`` from ``at`` on; grows with room to spare."""
    if len(old) < at + len(new):
        old = np.concatenate([old[:at], np.empty(max(at // 2, len(new)), old.dtype)])
    old[at : at + len(new)] = new
    return old


def text_of(points: np.ndarray) -> str:
    """Characters, with U+10FFFF for a mark that stands in the text itself."""
    return np.minimum(points, 0x10FFFF).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@functools.lru_cache(2)
def lattices(path: str, power: float) -> Lattices:
    return Lattices(path, power)


def segments(text: str) -> Iterator[str]:
    """The text with the blank in front, cut before runs of blanks into stretches of bounded length where it has blanks."""
    text = " " + text
    start = 0
    while start < len(text):
        end = start + BLOCK
        if end < len(text):
            end = text.find(" ", end)
            while end > 0 and text[end - 1] == " ":
                end = text.find(" ", end + 1)
            end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def sample_batch(texts: list[str], keys: np.ndarray, model: Lattices, seed: int) -> list[np.ndarray]:
    """Piece ids of each text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[tuple[int, int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            for (row, _, _), ids in zip(group, _sample(group, keys, model, seed), strict=True):
                out[row].append(ids)
        group, size = [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        for number, part in enumerate(segments(text)):
            group.append((i, number, part))
            size += len(part)
            if size >= BLOCK:
                flush()
    flush()
    return [np.concatenate(o) if o else np.zeros(0, np.int32) for o in out]


def _sample(group: list[tuple[int, int, str]], keys: np.ndarray, model: Lattices, seed: int) -> list[np.ndarray]:
    flat = "".join(t for _, _, t in group)
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[points == ord(MARK)] = LITERAL
    points[points == 32] = ord(MARK)
    sizes = np.array([len(t) for _, _, t in group])
    cuts = np.cumsum(sizes) - sizes
    apart = np.zeros(len(points), bool)
    code = model.code[points]
    apart[1:] = ~model.joined[code[:-1], code[1:]]
    apart[cuts] = True
    starts = np.flatnonzero(apart)
    ends = np.append(starts[1:], len(points))
    roll = Rolling(31)
    h = splitmix(roll.of(roll.prefix(splitmix(points.astype(U64))), starts, ends) ^ (ends - starts).astype(U64))
    distinct, sample, unit_of = np.unique(h, return_index=True, return_inverse=True)
    base = model.filtered(distinct, points, starts[sample], (ends - starts)[sample])[unit_of]
    first, piece, chance = model.table.first, model.table.piece, model.table.chance
    part_of = np.searchsorted(cuts, starts, side="right") - 1
    row = np.array([i for i, _, _ in group])[part_of]
    number = np.array([n for _, n, _ in group])[part_of]
    nth = np.arange(len(starts)) - np.searchsorted(part_of, part_of)
    key = splitmix(keys[row] ^ splitmix((number.astype(U64) << U64(32)) + nth.astype(U64) + U64(seed << 56)))
    active = np.arange(len(starts))
    place = ends - starts
    tokens = np.zeros(len(starts), np.int64)
    drawn: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    step = 0
    while len(active):
        e = first[base[active] + place[active] - 1]
        u = unit(splitmix(key[active] + U64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)))
        later = np.flatnonzero(u >= chance[e])
        while len(later):
            e[later] += 1
            later = later[u[later] >= chance[e[later]]]
        ids = piece[e]
        drawn.append((active, np.full(len(active), step), ids, starts[active] + place[active] - 1))
        tokens[active] += 1
        place[active] -= model.chars[ids + 1]
        active = active[place[active] > 0]
        step += 1
    occ, steps, ids, where = (np.concatenate(x) for x in zip(*drawn, strict=True))
    offset = np.cumsum(tokens) - tokens
    spot = offset[occ] + tokens[occ] - 1 - steps
    ordered, end_at = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    ordered[spot], end_at[spot] = ids, where
    spelled = np.flatnonzero(ordered < 0)
    width = np.ones(len(ordered), np.int64)
    bytes_ = [model.spell(MARK if points[w] == LITERAL else chr(points[w])) for w in end_at[spelled].tolist()]
    width[spelled] = [len(b) for b in bytes_]
    stream = np.repeat(ordered, width)
    if len(spelled):
        at = (np.cumsum(width) - width)[spelled]
        stream[ragged(at, width[spelled])] = [i for b in bytes_ for i in b]
    per_part = np.bincount(np.repeat(np.repeat(part_of, tokens), width), minlength=len(group))
    return np.split(stream.astype(np.int32), np.cumsum(per_part)[:-1])


def encode(docs: DataFrame, path: str, power: float = POWER, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep``, ids) with a sampled segmentation for every row of ``docs`` (doc_id, text).

    The row key is a hash of doc_id and text: equal rows have equal segmentations.
    Null and empty texts have no ids.  Null doc_ids keep their rows; columns beyond
    ``keep`` are ignored; an empty table gives no rows.  Long texts go through in
    stretches cut before blanks.
    """
    more = tuple(c for c in keep if c not in ("doc_id", "text"))
    docs = documents(docs, *more).withColumn("__key", row_key("doc_id", "text"))
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(path, power)
        for b in slices(batches, "text", BLOCK):
            keys = b.column("__key").to_numpy(zero_copy_only=False).view(U64)
            ids = sample_batch(b.column("text").to_pylist(), keys, model, seed)
            offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), lists], [*names, "ids"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(run, f"{schema}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``; null ids decode to null, no ids to the empty text."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(path, POWER)
        for b in batches:
            ids = b.column("ids")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.nan_to_num(pc.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64))
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            texts = [model.decode(flat[s:e]) if k else None for s, e, k in zip(np.append(0, ends[:-1]), ends, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
