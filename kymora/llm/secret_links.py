"""Secrets in texts: strong patterns, and weak parts that only count together.

Strong spans (assignments, access identifiers, long hex) are reported on their own.
A bare 40-character key or an endpoint is weak: most are harmless.  Identifiers,
secrets and endpoints of one document become intervals; an interval join within
``reach`` characters reports a weak secret where an identifier or an endpoint is near,
and a weak endpoint where an identifier or a secret is near.  The join carries the
nearest end and the nearest start of each role through the parts in text order, so many
parts in one place cost no pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import documents, slices

REACH = 400
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "secret", "endpoint")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Weak parts: a bare key of 40 characters with upper case, lower case and a digit; a host of a service, bare or in a URL.
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.:-]{4,}|\b[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,4}\.amazonaws\.com\b")
SPAN = "array<struct<kind:string,start:int,end:int>>"


def strong(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def weak(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak parts in text order that touch no strong span; a weak secret and an endpoint may overlap."""
    taken = sorted(taken, key=lambda s: s[1])
    starts = [s[1] for s in taken]
    ends = list(accumulate((s[2] for s in taken), max))

    def clear(part: tuple[str, int, int]) -> bool:
        i = bisect_left(starts, part[2])  # spans that start before its end
        return not i or ends[i - 1] <= part[1]

    found = [p for m in WEAK_SECRET.finditer(text) if clear(p := ("secret", *m.span()))]
    if "://" in text or "amazonaws" in text:
        found += [p for m in ENDPOINT.finditer(text) if clear(p := ("endpoint", *m.span()))]
    return sorted(found, key=lambda s: s[1:])


def linked(strong_parts: list[tuple[str, int, int]], weak_parts: list[tuple[str, int, int]], reach: int) -> list[tuple[str, int, int]]:
    """Weak parts with a complementary part within ``reach`` characters: an interval join by running bounds."""
    if not weak_parts:
        return []
    parts = sorted(strong_parts + weak_parts, key=lambda s: s[1:])
    near = [[False, False, False] for _ in parts]  # an identifier, a secret, an endpoint

    def role(kind: str) -> int:
        return {"access": 0, "assign": 1, "hex": 1, "secret": 1, "endpoint": 2}[kind]

    for order in (range(len(parts)), range(len(parts) - 1, -1, -1)):
        bound: list[int | None] = [None, None, None]
        forward = order.step > 0
        for i in order:
            kind, start, end = parts[i]
            for k in (0, 1, 2):
                if bound[k] is not None:
                    near[i][k] |= (start - bound[k] if forward else bound[k] - end) <= reach
            k = role(kind)
            here = end if forward else start
            bound[k] = here if bound[k] is None else (max if forward else min)(bound[k], here)
    return [
        p for p, (by_id, by_secret, by_endpoint) in zip(parts, near, strict=True)
        if p[0] == "secret" and (by_id or by_endpoint) or p[0] == "endpoint" and (by_id or by_secret)
    ]


def blanked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; spans that overlap are one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(reach: int, keep: list[str], blank: bool):
    """Arrow map: spans of each row, and its text without them where that is asked for."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rank = {k: i for i, k in enumerate(KINDS)}

    def spans(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], kind)

    def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        return sorted(spans, key=lambda s: (s[1], rank[s[0]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 22):
            base, full = [], []
            texts = b.column("text").to_pylist()
            for text in texts:
                found = strong(text) if text else []
                base.append(ordered(found))
                full.append(ordered(found + linked(found, weak(text, found), reach)) if text else [])
            clean = pa.array([blanked(t, s) for t, s in zip(texts, full, strict=True)], pa.string()) if blank else None
            cols = [clean if blank and c == "text" else b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, spans(base), spans(full)], [*keep, "base", "spans"])

    return run


def find_secrets(docs: DataFrame, reach: int = REACH, keep: tuple[str, ...] = (), blank: bool = False) -> DataFrame:
    """(doc_id, ``keep``, base, spans) for every row of ``docs`` (doc_id, text).

    ``base`` are the strong spans, ``spans`` those and the linked weak ones; both are
    ordered by start, then kind; places are code points, the end is exclusive.  Null
    and empty texts have none.  Repeated rows and null doc_ids keep a row each.  Whole
    texts are scanned; ``keep`` may name any other column, and text, which with
    ``blank`` comes back with each span replaced by its kind.  Columns beyond
    these are ignored; an empty table gives no rows.  Scopes are stretches of one
    document, so no row waits for another and nothing is shuffled.
    """
    more = tuple(c for c in keep if c not in ("doc_id", "text"))
    docs = documents(docs, *more)
    names = ["doc_id", *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(scan(reach, names, blank), f"{schema}, base {SPAN}, spans {SPAN}")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
