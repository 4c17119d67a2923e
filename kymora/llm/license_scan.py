"""Licences that texts name: phrases and identifier tags, and the value of tagged expressions.

Two Aho-Corasick automata read every whole text.  One runs over its words, joined by one
space, and finds notice phrases; the other runs over the folded text and finds the tags
that announce an expression.  What follows a tag is read as a licence expression:
a shunting-yard parser puts its operators (OR, AND, WITH, in rising order of binding)
behind their operands, and the postfix form is evaluated.  OR leaves the choice, so the
freer side counts; AND binds to both, so the stricter one counts; WITH takes half of
what its licence lacks to full freedom.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import documents, slices

#: Phrases whose places count, as (words, label).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Phrases that give a label and no place.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the mit", "mit"),
    ("licensed under the apache", "apache"),
    ("apache software license", "apache"),
    ("lesser general public license", "lgpl"),
    ("library general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("gnu gpl", "gpl"),
    ("gnu lgpl", "lgpl"),
    ("gnu agpl", "agpl"),
    ("bsd license", "bsd"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("isc license", "isc"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "boost"),
    ("zlib license", "zlib"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons zero", "cc0"),
    ("cc0 1 0", "cc0"),
    ("creative commons attribution", "cc-by"),
    ("cc by", "cc-by"),
    ("cc by sa", "cc-by-sa"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution share alike", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution non commercial", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
)
#: What announces an expression; a strong tag gives a label for identifiers that are not known, too.
TAGS = (("spdx-license-identifier:", True), ("license-expression:", True), ("license:", False), ("licence:", False), ('"license":', False), ("license =", False))
#: Beginnings of identifiers, folded; the longest that fits decides.
IDENTIFIERS = {
    "mit": "mit", "x11": "mit", "apache": "apache", "asl": "apache", "gpl": "gpl", "gnu gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "0bsd": "bsd",
    "isc": "isc", "mpl": "mpl", "epl": "epl", "bsl": "boost", "zlib": "zlib", "unlicense": "unlicense", "cc0": "cc0",
    "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd",
}
#: How free a reader is to use a text under each label.
FREEDOM = {
    "unlicense": 1.0, "cc0": 1.0, "mit": 0.95, "isc": 0.95, "zlib": 0.95, "boost": 0.95, "bsd": 0.95, "apache": 0.9, "cc-by": 0.85, "mpl": 0.6, "epl": 0.6,
    "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "other": 0.05,
}
BINDING = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t]*(?:(\()|(\))|([a-z0-9][a-z0-9.+:_-]*))")
#: Not words: ASCII but digits and letters; the table folds A-Z.
SPACES = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@functools.lru_cache(1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in BASE:
        phrases.add_word(f" {phrase} ", (label, len(phrase) + 1, True))
    for phrase, label in NOTICES:
        phrases.add_word(f" {phrase} ", (label, len(phrase) + 1, False))
    for tag, strong in TAGS:
        tags.add_word(tag, strong)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def family(identifier: str) -> str:
    """Label of an identifier; the longest known beginning that ends at a version or a mark decides."""
    best = "other"
    size = 0
    for start, label in IDENTIFIERS.items():
        rest = identifier[len(start) :]
        if len(start) > size and identifier.startswith(start) and (not rest or not rest[0].isalpha()):
            best, size = label, len(start)
    return best


def postfix(text: str, at: int, strong: bool) -> tuple[list[str], int, bool]:
    """Shunting-yard: tokens of the expression at ``at`` in postfix order, where it ends, and whether it is complete.

    Reading stops at the first token that cannot stand there.  Behind a weak tag the
    first operand must be a known licence, or there is no expression.
    """
    out: list[str] = []
    stack: list[str] = []
    operand, end, whole = True, at, True
    quoted = re.match(r"[ \t]*[\"']?", text[at : at + 64])
    at += quoted.end() if quoted else 0
    while m := TOKEN.match(text, at):
        opening, closing, word = m.groups()
        if operand:
            if opening:
                stack.append("(")
            elif word and word not in BINDING:
                word = word.rstrip(".:")
                if not strong and not out and family(word) == "other":
                    return [], end, True
                out.append(word)
                operand, end = False, m.end()
            else:
                break
        elif closing:
            if "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            end = m.end()
        elif word in BINDING:
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            break
        at = m.end()
    if operand and stack and out:  # an operator without its right side
        whole = False
        while stack and stack[-1] in BINDING:
            stack.pop()
            break
    while stack:
        top = stack.pop()
        if top == "(":
            whole = False
        else:
            out.append(top)
    return out, end, whole


def evaluated(tokens: list[str]) -> tuple[float, set[str]]:
    """Freedom under a postfix expression, and the labels of its licences (an exception after WITH is none)."""
    values: list[tuple[float, set[str]]] = []
    for token in tokens:
        if token in BINDING and len(values) > 1:
            right, left = values.pop(), values.pop()
            if token == "with":
                values.append((left[0] + (1 - left[0]) / 2, left[1]))
            else:
                values.append(((max if token == "or" else min)(left[0], right[0]), left[1] | right[1]))
        else:
            label = family(token)
            values.append((FREEDOM[label], {label}))
    return min((v for v, _ in values), default=0.0), set().union(*(s for _, s in values))


def read(data: bytes) -> tuple[int, list[int], list[str], set[str], list[dict], float]:
    """(words, places, labels of the places, all labels, expressions, score) of one text."""
    phrases, tags = automata()
    words = data.translate(SPACES).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places: list[int] = []
    named: list[str] = []
    labels: set[str] = set()
    passed = word = 0
    for end, (label, size, place) in phrases.iter(joined):
        labels.add(label)
        if place:
            start = end - size
            word += joined.count(" ", passed, start)  # spaces before the phrase's own
            passed = start
            places.append(word)
            named.append(label)
    values = [FREEDOM[x] for x in labels]
    expressions = []
    folded = data.translate(FOLDED).decode("latin-1")
    done = 0
    for end, strong in tags.iter(folded):
        if end < done:
            continue  # a tag inside an expression that was read already
        tokens, stop, whole = postfix(folded, end + 1, strong)
        if tokens:
            value, found = evaluated(tokens)
            if not whole:
                value = min(FREEDOM[x] for x in found)
            done = stop
            labels |= found
            values.append(value)
            expressions.append({"tokens": " ".join(tokens), "whole": whole, "value": value})
    return len(words), places, named, labels, expressions, min(values, default=0.0)


EXPRESSION = pa.struct([("tokens", pa.string()), ("whole", pa.bool_()), ("value", pa.float64())])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 22):
        rows = [read(t.as_py() or b"") for t in b.column("text").cast(pa.binary())]
        words, places, named, labels, expressions, score = zip(*rows, strict=True) if rows else ((),) * 6
        cols = [
            b.column("doc_id"), pa.array(words, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string())),
            pa.array([sorted(x) for x in labels], pa.list_(pa.string())), pa.array(expressions, pa.list_(EXPRESSION)), pa.array(score, pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "places", "place_labels", "labels", "expressions", "score"])


ROW = "doc_id bigint, n_words bigint, places array<bigint>, place_labels array<string>, labels array<string>, expressions array<struct<tokens:string,whole:boolean,value:double>>, score double"


def find_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places, place_labels, labels, expressions, score) for every row of ``docs`` (doc_id, text).

    ``places`` are the numbers of the first words (from 0) of base phrases in the order in
    which they end, ``place_labels`` their labels; ``labels`` are the sorted labels of
    all phrases and of the licences in tagged expressions, ``other`` for an identifier
    that is not known.  ``expressions`` are in postfix form; one that lacks a bracket or
    a right side is not whole and counts with its strictest licence.  ``score`` is the
    freedom that the strictest statement of the text leaves, 0 without any.

    Null and empty texts have no words and score 0.  Repeated rows and null doc_ids keep
    a row each.  Whole texts are read, one at a time.  Other columns are ignored; an
    empty table gives no rows.  No row waits for another and nothing is shuffled.
    """
    return documents(docs).mapInArrow(scan, ROW)


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
