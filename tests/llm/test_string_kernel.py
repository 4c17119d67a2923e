import numpy as np
import pytest
from pyspark.sql import functions as F

from kymora.llm import string_kernel as sk


def grams(text, order=4):
    low = text.lower()
    return {low[i : i + n] for n in range(1, order + 1) for i in range(len(low) - n + 1)}


def test_kernel_is_shared_ngrams_over_geometric_mean():
    texts = ["The cat sat.", "the cats sit", "Überall größer", "", "zz"]
    room = np.zeros((len(texts), sk.CELLS), np.float32)
    sk.presence(texts, room)
    x = room.copy()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            shared = len(grams(a) & grams(b))
            assert abs((x[i] @ x[j]) - shared) <= 2  # cells may collide


LANGUAGES = {"aa": ["bala", "muru", "kalo"], "bb": ["schtz", "ungen", "keit"], "cc": ["tion", "eaux", "ère"]}


@pytest.fixture()
def labelled(documents):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = sorted(LANGUAGES)[i % 3]
        words = [rng.choice(LANGUAGES[lang]) + rng.choice(["x", "e", "n", ""]) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words), lang))
    return documents(rows)


def test_held_out_texts_are_told_apart(labelled):
    model = sk.fit(labelled.filter(~sk.held_out("doc_id")), per_language=50, landmarks=24)
    assert model.languages == ["aa", "bb", "cc"] and len(model.bits) == 24
    got = sk.predict(labelled, model, keep=("lang",)).filter(sk.held_out("doc_id")).collect()
    assert len(got) > 30 and all(r["lang_pred"] == r["lang"] and 0 < r["score"] <= 1 for r in got)


def test_labels_of_rows_to_score_do_not_matter(labelled):
    model = sk.fit(labelled, 30, 12)
    one = sk.predict(labelled, model).orderBy("doc_id").collect()
    two = sk.predict(labelled.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)).repartition(5), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in one] == [r["lang_pred"] for r in two]


def test_fold_is_that_of_the_checksum(spark):
    import zlib

    got = spark.range(200).select("id", sk.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_odd_rows(odd, documents, labelled):
    docs, rows = odd
    model = sk.fit(labelled.unionByName(documents([(9, None, "aa"), (10, "...", "bb"), (11, "abc", None)])), 30, 12)
    got = sk.predict(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4) or r["doc_id"] is None and r["score"] == 0)
    empty = sk.fit(labelled.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in sk.predict(docs, empty).collect()} == {("und", 0.0)}
    assert sk.predict(labelled.limit(0), model).count() == 0


def exact_ridge(train, labels, asked, ridge):
    """Kernel ridge regression on sets of n-grams, without hash cells and landmarks; every language weighs the same."""
    names = sorted(set(labels))
    kernel = lambda a, b: np.array([[len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1)) for y in b] for x in a])
    sets, held = [grams(t) for t in train], [grams(t) for t in asked]
    target = np.array([[float(c == n) for n in names] for c in labels])
    weight = (target / target.sum(axis=0)).sum(axis=1) * len(train) / len(names)
    gram = kernel(sets, sets)
    alpha = np.linalg.solve(gram + ridge * len(train) * np.diag(1 / weight), target)
    return names, kernel(held, sets) @ alpha


def test_scores_are_those_of_exact_kernel_ridge_regression(labelled):
    rows = labelled.select("doc_id", "text", "lang").orderBy("doc_id").collect()
    train, asked = [r for r in rows if r["doc_id"] % 4], [r for r in rows if r["doc_id"] % 4 == 0]
    model = sk.fit(labelled.filter("doc_id % 4 != 0"), per_language=1000, landmarks=3000, ridge=1e-3)  # all of them are landmarks
    assert len(model.bits) == len(train)
    got = {r["doc_id"]: r for r in sk.predict(labelled.filter("doc_id % 4 = 0"), model).collect()}
    names, scores = exact_ridge([r["text"] for r in train], [r["lang"] for r in train], [r["text"] for r in asked], 1e-3)
    for r, s in zip(asked, scores, strict=True):
        assert got[r["doc_id"]]["lang_pred"] == names[int(s.argmax())]
        assert abs(got[r["doc_id"]]["score"] - min(max(s.max(), 0), 1)) < 0.02  # cells may collide
    few = sk.predict(labelled.filter("doc_id % 4 = 0"), sk.fit(labelled.filter("doc_id % 4 != 0"), 1000, 60)).collect()
    near = [abs(r["score"] - got[r["doc_id"]]["score"]) for r in few]
    assert np.mean(near) < 0.1  # landmarks span most of the kernel
