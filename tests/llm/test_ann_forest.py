import numpy as np
from pyspark.sql import functions as F

from kymora.llm.ann_forest import search

COLUMNS = "vec_id bigint, embedding array<double>"


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted(((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q))
        out[q] = [i for _, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    return out


def test_recall_scores_and_order(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    data = centres[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    data *= rng.uniform(0.2, 2, 3000)[:, None]
    vectors = {i: x.tolist() for i, x in enumerate(data)}
    df = spark.createDataFrame(list(vectors.items()), COLUMNS).repartition(4)
    got = found(search(df, F.col("vec_id") % 50 == 0))
    want = brute(vectors, range(0, 3000, 50), 20)
    hits = [len({v for v, _ in got[q].values()} & set(want[q])) for q in want]
    assert sum(hits) >= 0.9 * 20 * len(want)
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 21))
        for v, s in ranks.values():
            total = 0.0
            for a, b in zip(vectors[q], vectors[v], strict=True):
                total += a * b
            assert s == total
        order = [(-ranks[i][1], ranks[i][0]) for i in range(1, 21)]
        assert order == sorted(order)


def test_all_leaves_give_the_exact_answer_with_ties(spark):
    rng = np.random.default_rng(4)
    pool = rng.integers(-2, 3, size=(40, 5)).astype(float)
    vectors = {i: pool[i * i % 40].tolist() for i in range(400)}
    for i in range(400, 650):
        vectors[i] = pool[7].tolist()  # many equal rows
    vectors = {i: v for i, v in vectors.items() if any(v)}
    df = spark.createDataFrame(list(vectors.items()), COLUMNS)
    got = found(search(df, F.col("vec_id") % 20 == 0, share=1e9, leaves=8))
    want = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert {q: [got[q][r][0] for r in sorted(got[q])] for q in got} == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (40, [-0.0, 1.0])]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("clash") for c in ("key", "vec", "rank", "score", "lo", "codes", "code", "vector")})
    got = found(search(df, F.col("vec_id") % 20 == 0))
    assert {q: [got[q][r][0] for r in sorted(got[q])] for q in got} == {0: [8, 20, 40], 20: [0, 8, 40], 40: [0, 8, 20]}
    assert search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert search(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
