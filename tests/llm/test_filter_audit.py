import itertools
import random
import re

import pytest

from kymora.llm.filter_audit import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id bigint, quality int, toxic int, part string"


def failing(i, text, rows):
    words = WORD.findall(text)
    tests = {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows),
    }
    return {k for k, v in tests.items() if v}


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, text, source in rows:
        parts.setdefault(source or "", []).append((failing(i, text or "", rows), i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                lost = [d for d in docs if f in d[0] and not d[0] & before]
                late = sum(f in d[0] and bool(d[0] & before) for d in docs)
                kept = sum(not d[0] & (before | {f}) for d in docs)
                out[part, order, step] = [kept, len(lost), late, sum(d[0] == {f} for d in docs), sum(d[1] for d in lost), sum(d[2] for d in lost)]
                total[f] += len(lost)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


@pytest.fixture()
def tables(spark):
    def make(rows, labels):
        docs = spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], "doc_id bigint, text string, source string, mask string")
        return docs.repartition(3), spark.createDataFrame([(*r, "clash") for r in labels], LABELS)

    return make


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_same_as_counting_each_order(tables):
    rng = random.Random(4)

    def text():
        words = [rng.choice(["alpha", "Beta", "GAMMA", "x", "é y", "#tag", "50%", "ωμέγα"][: rng.choice([3, 4, 8])]) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([0, 3, 49, 50, 51, 90]))]
        return rng.choice([" ", "\n", "\t \x0b"]).join(words)

    texts = [text() for _ in range(40)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", "b", "b", None, ""])) for i in range(300)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 400, 3)]
    assert result(audit(*tables(rows, labels))) == brute(rows, labels)


def test_limits_are_exact(tables):
    rows = [
        (1, " ".join(f"w{i}" for i in range(50)), "a"),  # 50 words: kept by A
        (2, " ".join(f"w{i % 65}" for i in range(100)), "a"),  # 65 of 100 distinct: kept by B
        (3, "A" + "a" * 19, "a"),  # five in a hundred capitals: kept by C
        (4, "AB" + "a" * 37, "a"),  # just above
        (5, "😀" * 19 + "A", "a"),  # code points, not bytes or surrogates
    ]
    assert result(audit(*tables(rows, []))) == brute(rows, [])


def test_odd_rows(tables, spark):
    rows = [(None, "same", "a"), (None, "same", "a"), (7, "same", "a"), (7, "same", "a"), (7, "same", "b"), (8, "same", "a"), (9, None, None), (10, "", ""), (11, None, "a"), (12, " \n", "a"), (13, "w " * 100000, "a")]
    labels = [(7, 1, 0), (7, 0, 1), (None, 1, 1), (99, 1, 1), (8, None, None)]
    got = result(audit(*tables(rows, labels)))
    assert got == brute(rows, labels)
    assert len(got) == 3 * 600
    docs, labels = tables(rows, labels)
    assert audit(docs.limit(0), labels).count() == 0
    assert result(audit(docs.drop("source"), labels.limit(0)))["", "EABCD", 1][1] == 3


def test_copies_in_many_parts(tables):
    rows = [(i, "copy", f"s{i % 7}") for i in range(500)] + [(1000 + i, f"own {i}", "s0") for i in range(50)]
    assert result(audit(*tables(rows, []))) == brute(rows, [])
