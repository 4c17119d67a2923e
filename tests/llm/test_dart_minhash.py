from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kymora.llm.common import splitmix
from kymora.llm.dart_minhash import bags, components, near_duplicates, signatures


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(rows, threshold=0.8):
    """Smallest id of each connected component, by brute force."""
    bags_ = [bag(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            shared = sum((bags_[a] & bags_[b]).values())
            if shared and shared >= threshold * sum((bags_[a] | bags_[b]).values()):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, i), i)
    return {i: least[x] for (i, _), x in zip(rows, label, strict=True)}


def edited(text, every, seed):
    w = text.split()
    for k in range(seed % every, len(w), every):
        w[k] = f"edit{seed}_{k}"
    return " ".join(w)


@pytest.mark.parametrize("share", [0.3, 0.8])
def test_values_agree_as_often_as_bags_are_similar(share):
    rng = np.random.default_rng(5)
    element = splitmix(np.arange(2000, dtype=np.uint64))
    one = rng.random(2000) * 20
    two = np.where(rng.random(2000) < share, one, rng.random(2000) * 20)
    similar = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    s = signatures(np.repeat([0, 1], 2000), np.tile(element, 2), np.concatenate([one, two]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - similar) < 0.03


def test_signature_depends_on_the_bag_alone():
    element = splitmix(np.arange(300, dtype=np.uint64))
    weight = np.arange(300) % 7 + 1.0
    alone = signatures(np.zeros(300, np.int64), element, weight, 1, 64)
    order = np.random.default_rng(1).permutation(300)
    among = signatures(np.append(np.full(300, 1), [0]), np.append(element[order], np.array([9], np.uint64)), np.append(weight[order], [2.0]), 3, 64)
    assert (alone[0] == among[1]).all() and not among[2].any()


def test_bags_count_shingles(prose):
    texts = [prose(1, 30), "a b c", "", None, "x " * 12, "a b c"]
    doc, shingle, count = bags(pa.array(texts))
    for i, t in enumerate(texts):
        assert sorted(count[doc == i]) == sorted(bag(t).values())
    assert (shingle[doc == 1] == shingle[doc == 5]).all()


def test_same_classes_as_brute_force(documents, prose):
    base = [prose(i, 120) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + 10 * i + k, edited(base[i], 45 + 20 * k, k)) for i in range(8) for k in range(6)]
    rows += [(300, base[0]), (301, base[0] + "\n"), (302, "a b c"), (303, "a b c"), (304, "a  b c"), (305, "a b d")]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(rows).repartition(4)).collect()}
    assert got == classes(rows)


def test_a_large_group_is_one_class_without_all_pairs(documents, prose):
    base = prose(5, 200)
    rows = [(i, edited(base, 190, i)) for i in range(600)] + [(1000 + i, base) for i in range(300)] + [(5000 + i, prose(i + 50, 100)) for i in range(50)]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(rows).repartition(6)).collect()}
    assert {got[i] for i in got if i < 5000} == {0}
    assert all(got[i] == i for i in got if i >= 5000)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (7, 6), (6, 5), (5, 4), (4, 9), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **{i: 4 for i in (4, 5, 6, 7, 9)}, **{100 + i: 100 for i in range(41)}}


def test_odd_rows(odd, documents):
    docs, rows = odd
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_duplicates(docs).collect())
    assert got == sorted((str(i), str(i)) for i, _ in rows)
    assert near_duplicates(documents([(1, "x")]).limit(0)).count() == 0
    named = near_duplicates(documents([(None, "same words here"), (4, "same words here"), (3, "same words here")])).collect()
    assert {r["class_id"] for r in named} == {3}
