import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kymora.llm import bm25_wand
from kymora.llm.bm25_wand import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, queries, k):
    bags = [(i, Counter(TERM.findall(fold(t)))) for i, t in rows]
    n = len(bags)
    mean = sum(sum(b.values()) for _, b in bags) / n
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for q, text in rows:
        if q not in queries:
            continue
        wanted = set(TERM.findall(fold(text)))
        scored = []
        for i, b in bags:
            hit = [t for t in wanted if t in b]
            if hit and i != q:
                s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in hit)
                scored.append((-round(s, 6), i))
        if scored:
            out[q] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("shard", [1 << 24, 3000])
def test_same_as_brute_force_in_any_shards(documents, shard):
    rng = random.Random(shard)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, ", ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for i in range(500)]
    rows += [(600 + i, rows[5][1]) for i in range(40)] + [(700, "É é unique W1"), (720, ""), (740, "nothing else")]
    docs = documents(rows).repartition(3)
    got = {}
    for r in search(docs, F.col("doc_id") % 20 == 0, 10, shard).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 10)
    assert {q: [got[q][r] for r in sorted(got[q])] for q in got} == want


def test_copies_of_the_query_take_no_place(documents):
    rows = [(100, "alpha beta gamma delta")] * 15 + [(i, f"alpha beta filler{i} {'pad ' * i}") for i in range(1, 31)]
    got = {}
    for r in search(documents(rows).coalesce(1), F.col("doc_id") == 100, 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    assert {q: [x[r] for r in sorted(x)] for q, x in got.items()} == brute(rows, {100}, 10)
    assert len(got[100]) == 10


def test_blocks_are_pruned_and_nothing_is_lost():
    import numpy as np

    rng = np.random.default_rng(1)
    wanted = np.arange(1, 21, dtype=np.uint64)
    doc = np.concatenate([np.append(np.arange(64), np.sort(rng.choice(np.arange(64, 3200), 236, replace=False))) for _ in wanted])
    count = np.where(doc < 64, rng.integers(20, 60, len(doc)), 1)
    row = {"ids": np.arange(3200, dtype="<i8"), "lengths": np.full(3200, 50, "<i4"), "terms": wanted.astype("<u8"), "offsets": np.arange(0, 6001, 300).astype("<i8"), "doc": doc.astype("<i4"), "count": count.astype("<i4")}
    shard = bm25_wand.Shard({k: v.tobytes() for k, v in row.items()}, wanted, np.linspace(0.1, 5, 20), 50.0)
    full = np.round(np.bincount(shard.doc, weights=shard.impact, minlength=3200), 6)
    want = np.lexsort((np.arange(3200), -full))[:10]
    scored = []
    plain = shard.score
    shard.score = lambda e: scored.append(len(e)) or plain(e)
    got, _ = shard.top(np.arange(20), 10)
    assert got.tolist() == want.tolist()
    assert sum(scored) < len(shard.bound) / 2
    scored.clear()
    got, _ = shard.top(np.arange(20), 10, floor=full[want[4]])
    assert got.tolist() == want[:5].tolist()
    assert shard.top(np.arange(20), 10, floor=2 * full[want[0]])[0].tolist() == []


def test_levels_share_floors(documents, monkeypatch):
    """Shards of few documents: several levels, one row group a shard, and far fewer rows than shards times k."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for i in range(1200)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]
    docs = documents(rows).repartition(4)
    index = bm25_wand.indexed(docs, 3000)
    levels = index.groupBy("level").count().collect()
    shards = sum(r["count"] for r in levels)
    assert len(levels) > 2 and shards > 30
    returned = []
    plain = bm25_wand.best
    monkeypatch.setattr(bm25_wand, "best", lambda found, k: returned.append(found.count()) or plain(found, k))
    got = {}
    for r in search(docs, F.col("doc_id") % 100 == 0, 10, 3000).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    asked = {i for i, _ in rows if i % 100 == 0}
    assert {q: [got[q][r] for r in sorted(got[q])] for q in got} == brute(rows, asked, 10)
    assert sum(returned) < len(asked) * 10 * shards / 2


def scores(rows, queries):
    """Rounded scores of all pairs with a common term, without the query's own id."""
    bags = [(i, Counter(TERM.findall(fold(t)))) for i, t in rows]
    n = len(bags)
    mean = sum(sum(b.values()) for _, b in bags) / n
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for q in queries:
        wanted = set(TERM.findall(fold(dict(rows)[q])))
        for i, b in bags:
            if i != q and (hit := wanted & b.keys()):
                s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in hit)
                out.setdefault(q, []).append((-round(s, 6), i))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("shard", [1 << 24, 20000, 1500])
def test_many_queries_are_summed_together(documents, shard):
    """More queries than a shard takes one by one: ties, copies, equal ids, no common term, empty and null texts, one long text."""
    rng = random.Random(shard)
    vocabulary = [f"w{i}" for i in range(2000)]
    weights = [1 / (i + 1) for i in range(2000)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for i in range(700)]
    rows += [(800 + i, rows[9][1]) for i in range(60)] + [(900, "É é alone W1"), (903, ""), (906, None), (909, "nothing else")]
    rows += [(912, " ".join(vocabulary)), (915, rows[3][1]), (918, "w1 w2 w3 " * 400)]
    docs = documents(rows).repartition(3)
    queries = [i for i, _ in rows if i % 3 == 0]
    assert len(queries) > 2 * bm25_wand.MANY
    got = {}
    for r in search(docs, F.col("doc_id") % 3 == 0, 10, shard).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    want = scores(rows, queries)
    assert {q: [(d, -s) for s, d in x[:10]] for q, x in want.items()} == {q: [(d, s) for _, d, s in sorted(x)] for q, x in got.items()}
    repeated = [(5, "alpha beta"), (5, "alpha gamma"), (6, "alpha")] + [(1000 + i, f"alpha other{i}") for i in range(80)]
    found = {}
    for r in search(documents(repeated).coalesce(1), F.lit(True), 90).collect():
        found.setdefault(r["query_id"], []).append(r["doc_id"])
    assert sorted(found[5]) == sorted(2 * [i for i, _ in repeated if i != 5])
    assert sorted(found[6]) == sorted(i for i, _ in repeated if i != 6)


def shard_and_queries(n, queries, seed=7):
    """A shard of random texts as ``build`` gives it, and some of its documents as queries."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(5, 80))) for _ in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts), pa.array(range(n), pa.int64())], ["doc_id", "text", "key"])
    row = next(bm25_wand.build(1 << 30)([batch])).to_pylist()[0]
    some = next(bm25_wand.query_rows([batch.slice(0, queries)])).to_pylist()
    asked = bm25_wand.Asked(np.arange(queries), np.arange(queries), [np.frombuffer(r["terms"], "<u8") for r in some])
    return row, asked, np.linspace(0.1, 9, len(asked.wanted))


@pytest.mark.parametrize("small", [{}, {"STRIPE": 37, "SUMS": 500}, {"MATRIX_BYTES": 0, "PIECE": 1}, {"MATRIX_BYTES": 5000, "STRIPE": 301}, {"SHARE": 0.0}])
def test_sums_and_single_queries_agree(monkeypatch, small):
    import numpy as np

    row, asked, idf = shard_and_queries(400, 120)
    plain, batch = bm25_wand.Shard(row, asked.wanted, idf, 40.0), bm25_wand.Batch(row, asked.wanted, idf, 40.0)
    for name, value in small.items():
        monkeypatch.setattr(bm25_wand, name, value)
    for share in (0.0, 0.9, 1.0, 1.1):
        want = {i: plain.top(asked.slots[asked.cuts[i] : asked.cuts[i + 1]], 10, i) for i in range(120)}
        floors = np.array([share * want[i][1][-1] for i in range(120)])
        got = {}
        for i, ids, s in batch.near(asked, floors, 10):
            got.setdefault(i, []).extend(zip(-s, ids, strict=True))
        for i in range(120):
            best = sorted(got.get(i, []))[:10]
            assert [x for x in best if -x[0] >= floors[i]] == [(-s, d) for d, s in zip(*want[i], strict=True) if s >= floors[i]]


def test_a_shard_without_results_takes_few_steps():
    """Queries whose floor nothing here reaches: no calls for each of them, or time grows as queries times shards."""
    import sys

    import numpy as np
    import pyarrow as pa

    row, asked, idf = shard_and_queries(300, 300)
    floors = np.full(len(asked), 1e6), np.zeros(len(asked), np.int64)
    batch = pa.RecordBatch.from_pylist([row])
    run = bm25_wand.searcher(asked, idf, 40.0, 10, floors)
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        found = list(run([batch]))
    finally:
        sys.setprofile(None)
    assert sum(b.num_rows for b in found) == 0
    assert len(calls) < 5 * len(asked)


def test_a_task_holds_one_shard_at_a_time(documents, monkeypatch):
    """Many shards in a task, and the session's batch size as it was afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sizes = []
    plain = bm25_wand.stored
    monkeypatch.setattr(bm25_wand, "stored", lambda df, kind: sizes.append((kind, df.sparkSession.conf.get(name))) or plain(df, kind))
    docs = documents([(i, f"common term{i % 7} other{i}") for i in range(300)]).coalesce(1)
    before = docs.sparkSession.conf.get(name)
    assert search(docs, F.col("doc_id") % 3 == 0, 10, 1000).count() == 1000
    assert {k: n for k, n in sizes if k != "queries"} == {"frequencies": "1", "tops": "1"}
    assert docs.sparkSession.conf.get(name) in (before, "2000") and dict(sizes)["queries"] != "1"


def test_many_blocks_of_queries(documents, monkeypatch):
    monkeypatch.setattr(bm25_wand, "QUERY_BYTES", 64)
    rows = [(i, f"common term{i % 7} other{i % 11}") for i in range(60)]
    got = {}
    for r in search(documents(rows), F.col("doc_id") % 10 == 0, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    assert {q: [d for _, d in sorted(x)] for q, x in got.items()} == brute(rows, set(range(0, 60, 10)), 3)


def test_odd_rows(odd, documents):
    docs, _ = odd
    got = sorted((r["query_id"], r["doc_id"], r["rank"]) for r in search(docs, F.col("doc_id") > 0).collect())
    assert got == []
    assert search(documents([(1, "x")]).limit(0), F.lit(True)).count() == 0
    assert search(documents([(None, "x"), (1, "x"), (2, "x y")]), F.lit(True)).count() == 2
