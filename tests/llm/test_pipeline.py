import numpy as np
import pytest
import re
from pyspark.sql import functions as F

import corpus_pipeline as cp
from kymora.llm.secret_links import strong
from test_dart_minhash import classes, edited
from test_substring_dedup import brute

KEY = "token = '04dbebab91ab85687d33eeaaf9ac699e1188f962'"


@pytest.fixture()
def corpus(documents, prose):
    base = [prose(i, 90) for i in range(30)]
    passage = prose(77, 55)
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(base)]
    rows += [(100 + i, edited(base[i], 60, 1), None) for i in range(8)] + [(200, base[3], "en"), (201, base[3], "en")]
    rows += [(300 + i, f"{prose(300 + i, 40)} {passage} {prose(400 + i, 40)}", "en") for i in range(6)]
    rows += [(400, f"{prose(500, 50)} {KEY} tail", "en"), (500, "12345 !!!", "en"), (501, None, "en"), (502, "", None)]
    return rows, documents(rows)


def pairs(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_each_stage_does_its_work_on_what_came_before(spark, corpus):
    rows, docs = corpus
    columns = docs.columns
    one = cp.language_id(spark, docs, "")
    texts = {i: t for i, t, _ in rows}
    assert one.columns == columns and pairs(one) == {i: t for i, t in texts.items() if t and re.search("[a-zé]", t)}
    two = cp.near_dedup(spark, one, "")
    left = sorted(pairs(one).items())
    want = classes(left)
    assert two.columns == columns and pairs(two) == {i: t for i, t in left if want[i] == i}
    assert two.count() == len(pairs(two))
    three = cp.without_repeats(spark, two, "")
    left = sorted(pairs(two).items())
    cut = brute(left, 20)
    assert three.columns == columns and pairs(three) == {i: cut[i][2] if cut[i][1] else t for i, t in left}
    assert sum(c[1] for c in cut.values()) >= 5 * 55
    four = cp.secret_scan(spark, three, "")
    after = pairs(four)
    assert four.columns == columns and KEY in texts[400] and "[assign]" in after[400]
    assert not any(strong(t) for t in after.values())
    assert {i: t for i, t in after.items() if i != 400} == {i: t for i, t in pairs(three).items() if i != 400}
    assert all(r["n_chars"] == len(r["text"]) for r in four.collect())
    five = cp.packed(spark, four, "").collect()
    from kymora.llm.byte_pieces import PieceEncoder
    import public_tokenizers

    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in after.items():
        ids = [x for p in sorted((p for p in five if p["doc_id"] == i), key=lambda p: p["start"]) for x in np.frombuffer(p["ids"], "<u4").tolist()]
        assert ids == [*encoder.encode([t]).ids.tolist(), 0]


def test_run_is_its_stages(spark, corpus, tmp_path):
    rows, docs = corpus
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = docs
    for _, f in cp.STAGES[:-1]:
        step = f(spark, step, str(tmp_path))
    got = cp.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.filter("start = 0").collect()) == sorted(pairs(step))
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "substring_dedup", "secret_scan", "packing"]


def test_odd_rows_pass_every_stage(spark, odd, documents):
    docs, rows = odd
    for name, f in cp.STAGES:
        out = f(spark, docs, "")
        assert out.count() > 0, name
        assert f(spark, docs.limit(0), "").count() == 0, name
    kept = cp.near_dedup(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted({(str(i), str(t)) for i, t in rows})
    short = docs.select("text", F.col("doc_id").cast("int").alias("doc_id"))
    assert cp.secret_scan(spark, short, "").columns == list(cp.COLUMNS)


def test_texts_of_no_learned_language_go_and_clean_ones_stay(spark, documents):
    """Languages are learned from the documents of the smallest test tables; the texts asked for carry no language."""

    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))
    asked = {
        10**9 + 1: "qzx vjk wpq",
        10**9 + 2: "xkcd qqq zzzz wwww jjjj vvvv kkkk",
        10**9 + 3: "1234 a",
        10**9 + 4: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        10**9 + 5: "0101 x 77 %%% q",
    }
    foreign = spark.createDataFrame([(i, t, None, "x", len(t)) for i, t in asked.items()], known.schema)
    kept = cp.language_id(spark, known.unionByName(foreign), "")
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert not ids & set(asked)
    words = F.size(F.split("text", " ")) >= 3
    clean = {r[0] for r in known.where(words & F.col("lang").isNotNull()).select("doc_id").collect()}
    assert len(clean - ids) <= 0.002 * len(clean)
