"""Byte-level BPE for whole batches: pieces found with arrays, each distinct piece encoded once.

The tokenizer's own pattern cuts a text into pieces and BPE never crosses a piece,
so the ids of a text are the ids of its pieces in order.  The pieces are found on
the array of code points, every distinct piece is encoded once, and a bounded
cache remembers the answers.  Where the ids of a vocabulary are in the order of its
merges, rank merging (``tiktoken``, built from the same file) encodes a piece to the
same ids several times faster; else ``tokenizers`` does.  A text with characters
whose class may depend on the Unicode version is given to ``tokenizers`` whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from kymora.llm.common import U64, Rolling, ragged, splitmix

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
SYMBOLS = 0x20000
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
BLOCK = 1 << 20


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point, UNSURE where Unicode 3.2 and the present tables differ."""
    out = np.full(SYMBOLS + 1, UNSURE, np.uint8)
    spaces = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    for c in range(SYMBOLS):
        now, then = unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))
        if now[0] != then[0] or now in ("Cn", "Cs", "Co"):
            continue
        out[c] = SPACE if c in spaces else LETTER if now[0] == "L" else NUMBER if now[0] == "N" else OTHER
    out[0x180E] = UNSURE
    return out


def ranked(config: dict) -> tiktoken.Encoding | None:
    """Rank merging with the vocabulary of a file, if its ids stand in the order of its merges."""
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
    byte = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*letters}))}
    vocab = config["model"]["vocab"]
    added = {t["content"] for t in config.get("added_tokens", [])}
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in config["model"]["merges"]]
    if None in made or made != sorted(set(made)) or len(made) + 256 != len(vocab) - len(added & set(vocab)):
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}
    return tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})


class Encoded:
    """Pieces of a batch: text of each, code point where it starts, number of ids, and the ids."""

    def __init__(self, text: np.ndarray, start: np.ndarray, count: np.ndarray, ids: np.ndarray, texts: int) -> None:
        self.text, self.start, self.count, self.ids = text, start, count, ids
        self.totals = np.bincount(text, weights=count, minlength=texts).astype(np.int64)

    def split(self) -> list[np.ndarray]:
        return np.split(self.ids, np.cumsum(self.totals)[:-1]) if len(self.totals) else []


class PieceEncoder:
    def __init__(self, path: str, cache: int = 500_000) -> None:
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.added = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in config.get("added_tokens", []))
        pre = config.get("pre_tokenizer") or {}
        self.known = bool(
            plain
            and config.get("normalizer") is None
            and config["model"]["type"] == "BPE"
            and not config["model"].get("dropout")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
        )
        self.margin = max([4, *(len(t) for t in self.added)]) + 4
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.roll = Rolling(5, SYMBOLS + 1)
        self.limit = cache
        self.ranked = ranked(config) if self.known else None
        self.keys = np.zeros(0, U64)
        self.lengths = np.zeros(0, np.int32)
        self.places = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        if self.ranked:
            return [self.ranked.encode_ordinary(p) for p in pieces]
        return [g.ids for g in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    # -- pieces -------------------------------------------------------------
    def _starts(self, points: np.ndarray, cls: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Places where pieces start; ``cuts`` are the places where texts start."""
        n = len(points)
        fresh = np.zeros(n, bool)
        fresh[cuts] = True
        change = np.ones(n, bool)
        change[1:] = cls[1:] != cls[:-1]
        run = np.flatnonzero(change | fresh)
        end = np.append(run[1:], n)
        kind = cls[run]
        follower = np.append(~fresh[run[1:]], False)  # the next run belongs to the same text
        space = kind == SPACE
        lead = space & follower
        blank = lead & (points[end - 1] == 32)
        joined = np.zeros(len(run), bool)  # runs that take the blank before them
        joined[1:] = blank[:-1]
        mark = np.zeros(n, bool)
        body = run[~space] - joined[~space]
        mark[body] = True
        long = end - run > 1
        mark[run[space & (long | ~blank)]] = True
        mark[end[lead & long & ~blank] - 1] = True
        quote = np.flatnonzero((kind == OTHER) & ~long & ~joined & follower & (points[run] == 39))
        quote = quote[kind[quote + 1] == LETTER] if len(quote) else quote
        if len(quote):
            at = end[quote]
            size = end[quote + 1] - at
            a = points[at]
            b = np.where(size > 1, points[np.minimum(at + 1, n - 1)], 0)
            taken = np.zeros(len(quote), np.int64)
            for s in SUFFIXES:
                hit = (a == ord(s[0])) & ((len(s) == 1) | (b == ord(s[-1])))
                taken = np.where(hit & (taken == 0), len(s), taken)
            hit = taken > 0
            mark[at[hit]] = False
            rest = at[hit] + taken[hit]
            mark[rest[rest < n]] = True
        return np.flatnonzero(mark)

    def _look_up(self, h: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Index into the cache for each hash; unknown pieces are encoded by the library."""
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        found = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~found)
        if len(new):
            if len(self.keys) + len(new) > self.limit and len(self.keys):
                used = np.unique(place[found])  # keep what this batch uses
                pool = self.pool[ragged(self.places[used], self.lengths[used])]
                self.keys, self.lengths = self.keys[used], self.lengths[used]
                self.places, self.pool = np.cumsum(self.lengths) - self.lengths, pool
            ids = self._encode([make(i) for i in first[new].tolist()])
            lengths = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
            places = np.cumsum(lengths) - lengths + len(self.pool)
            at = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, at, keys[new])
            self.lengths = np.insert(self.lengths, at, lengths)
            self.places = np.insert(self.places, at, places)
            self.pool = np.concatenate([self.pool, flat])
            place = np.searchsorted(self.keys, keys)
        return place[inverse], keys

    # -- batches ------------------------------------------------------------
    def encode(self, texts: list[str], ids: bool = True) -> Encoded:
        """Whole texts; long ones go through in blocks that end where a piece surely ends."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        group: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal group, size
            if group:
                out.append(self._block(group, ids))
            group, size = [], 0

        for i, text in enumerate(texts):
            if len(text) > BLOCK and self.known and not (self.special and self.special.search(text)):
                flush()
                out.extend(self._long(i, text, ids))
                continue
            if size + len(text) > BLOCK:
                flush()
            group.append((i, text))
            size += len(text)
        flush()
        if not out:
            out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint32),)]
        return Encoded(*(np.concatenate(x) for x in zip(*out, strict=True)), texts=len(texts))

    def _long(self, i: int, text: str, ids: bool):
        start, width = 0, BLOCK
        while start < len(text):
            part = text[start : start + width]
            if start + len(part) == len(text):
                t, s, c, d = self._block([(i, part)], ids)
                yield t, s + start, c, d
                return
            t, s, c, d = self._block([(i, part)], ids)
            sure = np.flatnonzero(s <= len(part) - self.margin)
            last = sure[-1] if len(sure) else 0
            if last == 0:
                width *= 2  # one piece fills the block
                continue
            yield t[:last], s[:last] + start, c[:last], d[: int(c[:last].sum())] if ids else d
            start, width = start + int(s[last]), BLOCK

    def _block(self, group: list[tuple[int, str]], ids: bool):
        number, names = [], []
        whole: list[tuple[int, str]] = []  # for the library as it is
        fixed: dict[int, int] = {}  # parts that are added tokens
        base: list[int] = []
        for i, text in group:
            if not self.known:
                whole.append((i, text))
            elif self.special and self.special.search(text):
                at = 0
                for m in self.special.finditer(text):
                    number += [i, i]
                    base += [at, m.start()]
                    names += [text[at : m.start()], m[0]]
                    fixed[len(names) - 1] = self.added[m[0]]
                    at = m.end()
                number.append(i)
                base.append(at)
                names.append(text[at:])
            else:
                number.append(i)
                base.append(0)
                names.append(text)
        flat = "".join(names)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        table = classes()
        cls = table[np.minimum(points, SYMBOLS)]
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        cuts = np.cumsum(sizes) - sizes
        unsure = np.unique(np.searchsorted(cuts + sizes, np.flatnonzero(cls == UNSURE), side="right")) if len(points) else []
        if len(unsure):
            odd = {number[k] for k in unsure}
            rest = [(i, t) for i, t in group if i not in odd and self.known]
            whole = [(i, t) for i, t in group if i in odd or not self.known]
            parts = ([self._block(rest, ids)] if rest else []) + [self._library(i, t) for i, t in whole]
            t, s, c, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            return self._in_order(t, s, c, d, ids)
        if whole:
            return tuple(np.concatenate(x) for x in zip(*(self._library(i, t) for i, t in whole), strict=True))
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        starts = self._starts(points, cls, cuts[sizes > 0])
        ends = np.append(starts[1:], len(points))
        part = np.searchsorted(cuts + sizes, starts, side="right")
        special = np.zeros(len(starts), bool)
        if fixed:
            inside = np.isin(part, np.fromiter(fixed, np.int64))
            lead = inside & (starts == cuts[part])
            keep = ~inside | lead
            starts, ends, part, special = starts[keep], ends[keep], part[keep], lead[keep]
            ends = np.where(special, cuts[part] + sizes[part], ends)
        h = splitmix(self.roll.of(self.roll.prefix(np.minimum(points, SYMBOLS)), starts, ends) ^ (ends - starts).astype(U64))
        normal = np.flatnonzero(~special)
        a, b = starts[normal], ends[normal]
        place, _ = self._look_up(h[normal], lambda k: flat[a[k] : b[k]])
        count = np.ones(len(starts), np.int64)
        count[normal] = self.lengths[place]
        text = np.asarray(number, np.int64)[part]
        where = starts - cuts[part] + np.asarray(base, np.int64)[part]
        if not ids:
            return text, where, count, np.zeros(0, np.uint32)
        source = np.zeros(len(starts), np.int64)
        source[normal] = self.places[place]
        stream = self.pool[ragged(source, count)] if len(self.pool) else np.zeros(int(count.sum()), np.uint32)
        if fixed:
            at = (np.cumsum(count) - count)[special]
            stream[at] = [fixed[p] for p in part[special]]
        return text, where, count, stream

    def _library(self, i: int, text: str):
        """The whole text by the library; its words are the pieces."""
        got = self.tok.encode(text, add_special_tokens=False)
        ids = np.asarray(got.ids, np.uint32)
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), ids
        word = np.array([-1 if w is None else w for w in got.word_ids])
        first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (word[1:] < 0)))
        start = np.array([a for a, _ in got.offsets], np.int64)[first]
        return np.full(len(first), i), start, np.diff(np.append(first, len(ids))), ids

    @staticmethod
    def _in_order(text, start, count, stream, ids: bool):
        order = np.argsort(text, kind="stable")
        if ids:
            places = np.cumsum(count) - count
            stream = stream[ragged(places[order], count[order])]
        return text[order], start[order], count[order], stream


@functools.lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
