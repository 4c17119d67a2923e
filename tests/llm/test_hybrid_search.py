import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kymora.llm import hybrid_search
from kymora.llm.hybrid_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in rows]
    bags = [(i, b) for i, b in bags if b]
    n = len(bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(terms(text))
    out = {}
    for item, ts in wanted.items():
        scored = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            score = sum(weight[t] * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in ts if t in b)
            if score > 0 and i is not None:
                scored.append((-score, i))
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank] = (i, -s)
    return out


def result(df):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


@pytest.fixture()
def items(spark):
    return lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], "item_id bigint, text string, rank string")


@pytest.mark.parametrize(("shard", "block"), [(1 << 24, 64), (4000, 64), (20000, 4)])
def test_same_as_brute_force_in_any_shards(documents, items, monkeypatch, shard, block):
    monkeypatch.setattr(hybrid_search, "SHARD_BYTES", shard)
    monkeypatch.setattr(hybrid_search, "BLOCK", block)
    rng = random.Random(shard + block)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "中文", "ß1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, rng.choice([", ", " ", "\n"]).join(rng.choices(vocabulary, weights, k=rng.randint(1, 80)))) for i in range(900)]
    rows += [(2000 + i, rows[7][1]) for i in range(30)]
    asked = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)) + ["W0", "w1 w2 w3"])) for i in range(40)] + [(50, rows[7][1]), (51, "w0 w1"), (52, "unknown"), (53, None)]
    want = brute(rows, asked)
    assert result(search(documents(rows).repartition(3), items(asked))) == want
    # Workers of Spark do not see the small sizes; the same steps in this process do, with all shards in one task.
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    shards = list(hybrid_search.build(iter([batch])))
    assert len(shards) > 1 or shard == 1 << 24
    each = {i: np.unique(hybrid_search.postings(pa.array([t], pa.string()))[1]) for i, t in asked}
    wanted = np.unique(np.concatenate(list(each.values())))
    held = np.zeros(len(wanted))
    for part in hybrid_search.frequencies(wanted)(iter(shards)):
        held[part.column("term").to_numpy()] += part.column("n").to_numpy()
    docs, total = (sum(s.column(c)[0].as_py() for s in shards) for c in ("docs", "words"))
    weight = np.floor(1000 * np.log((2.0 * docs + 2) / (2 * held + 1))).astype(np.int64)
    named = [(i, np.searchsorted(wanted, t)) for i, t in each.items()]
    (best,) = hybrid_search.searcher(named, wanted, weight, docs, total, 10)(iter(shards))
    got = {}
    for item, doc, score in zip(*(best.column(c).to_pylist() for c in ("item_id", "doc_id", "score")), strict=True):
        got.setdefault(item, []).append((-score, doc))
    assert {(i, r): (d, -s) for i, x in got.items() for r, (s, d) in enumerate(sorted(x), 1)} == want


def test_long_lists_are_skipped():
    """A few accumulators with high sums: most of the long lists is never evaluated."""
    rng = np.random.default_rng(5)
    n = 4000
    texts = [" ".join(f"c{j}" for j in range(12) if rng.random() < 0.6) + " pad" * int(rng.integers(1, 5)) for _ in range(n)]
    for i in range(0, n, 300):
        texts[i] += " rare0 rare1 rare2"
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    row = next(hybrid_search.build(iter([batch]))).to_pylist()[0]
    wanted = np.unique(hybrid_search.postings(pa.array([" ".join(f"c{j}" for j in range(12)) + " rare0 rare1 rare2"]))[1])
    df = Counter(t for text in texts for t in set(text.split()))
    weight = []
    for h in wanted:
        word = next(w for w in df if hybrid_search.postings(pa.array([w]))[1][0] == h)
        weight.append(math.floor(1000 * math.log((2 * n + 2) / (2 * df[word] + 1))))
    shard = hybrid_search.Shard(row, wanted, np.array(weight, np.int64), n, sum(len(t.split()) for t in texts))
    best = []
    shard.search(np.arange(len(wanted)), 10, best)
    want = brute(list(enumerate(texts)), [(0, " ".join(f"c{j}" for j in range(12)) + " rare0 rare1 rare2")])
    assert sorted((-s, -d) for s, d in best) == sorted((-s, d) for d, s in want.values())
    assert 10 <= shard.evaluated < 40


def test_blocks_of_items(documents, items, monkeypatch):
    monkeypatch.setattr(hybrid_search, "ITEM_TERMS", 16)
    rows = [(i, f"common term{i % 7} other{i % 11}") for i in range(60)]
    asked = [(i, f"common term{i} other{i}") for i in range(30)]
    assert result(search(documents(rows), items(asked), 3)) == brute(rows, asked, 3)


def test_lengths_beyond_64_bits():
    n = np.array([1, 5 * 10**6, 10**7], np.int64)
    docs, total = 10**11, 7 * 10**13
    assert hybrid_search.lengths_in_tens(n, docs, total).tolist() == [10 + 90 * int(x) * docs // total for x in n]


def test_odd_rows(odd, documents, items):
    docs, rows = odd
    asked = [(1, "alpha x one"), (1, "two"), (None, "alpha"), (2, ""), (3, "beta beta")]
    assert result(search(docs, items(asked))) == brute(rows, asked)
    assert search(docs, items([]).limit(0)).count() == 0
    assert search(documents([(1, "x")]).limit(0), items([(1, "x")])).count() == 0
    assert search(documents([(1, None), (2, "?")]), items([(1, "x")])).count() == 0


def test_ties_and_long_texts(documents, items):
    rows = [(100 - i, "same words here") for i in range(40)] + [(500, "same " * 300000 + "words"), (501, "filler")]
    asked = [(1, "same words"), (2, "here " * 200000)]
    assert result(search(documents(rows), items(asked))) == brute(rows, asked)
