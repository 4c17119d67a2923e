from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from kymora.llm import piece_sampling
from kymora.llm.common import splitmix
from kymora.llm.piece_sampling import decode, encode, lattices, sample_batch

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello  world\n x", " a", "", "▁x", "a▁b  ", "é漢😀 x▁", "tab\tx  ", "   ", "\n\n", "a" * 700, "foo bar" * 50, "漢字" * 300 + "é" * 2000, "\x00\x01", "▁▁▁"]


@pytest.fixture(scope="module")
def model():
    return lattices(PATH, 1.0)


def test_decoding_is_lossless_also_in_small_blocks(spark, documents, model, prose, monkeypatch):
    from kymora.llm import piece_sampling

    texts = [*TEXTS, prose(1, 3000)]
    back = decode(encode(documents(enumerate(texts)), PATH), PATH)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == dict(enumerate(texts))
    monkeypatch.setattr(piece_sampling, "BLOCK", 50)
    ids = sample_batch(texts, np.arange(len(texts), dtype=np.uint64), model, 1)
    assert [model.decode(x.tolist()) for x in ids] == texts


def test_the_library_decodes_to_the_same_text(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [t for t in TEXTS if "▁" not in t]
    for ids, text in zip(sample_batch(texts, np.arange(len(texts), dtype=np.uint64), model, 3), texts, strict=True):
        assert sp.decode(ids.tolist()) == text


def ways(model, text):
    if not text:
        yield (), 1.0
    for k in range(1, len(text) + 1):
        if model.pieces.exists(text[:k]):
            piece, _, weight = model.pieces.get(text[:k])
            for rest, w in ways(model, text[k:]):
                yield (piece - 1, *rest), weight * w


@pytest.mark.parametrize("word", ["the", "hello"])
def test_draws_follow_the_weights_of_all_segmentations(model, word):
    every = dict(ways(model, "▁" + word))
    whole = sum(every.values())
    n = 30000
    drawn = Counter(tuple(x.tolist()) for x in sample_batch([word] * n, splitmix(np.arange(n, dtype=np.uint64)), model, 1))
    assert set(drawn) <= set(every)
    for k, w in every.items():
        assert abs(drawn[k] / n - w / whole) < 0.012


def test_row_key_decides_not_the_partition(documents, prose):
    rows = [(i, prose(i, 60)) for i in range(30)] + [(31, prose(1, 60)), (1, prose(1, 60))]

    def run(parts, seed=1):
        return sorted((r["doc_id"], r["ids"]) for r in encode(documents(rows).repartition(parts), PATH, seed=seed).collect())

    one = run(1)
    assert one == run(7)
    assert one != run(1, seed=2)
    by_id = [ids for i, ids in one if i == 1]
    assert by_id[0] == by_id[1] != [ids for i, ids in one if i == 31][0]


def test_odd_rows(odd, documents):
    docs, rows = odd
    got = decode(encode(docs, PATH, keep=("text", "source")), PATH).collect()
    assert len(got) == len(rows) and all(r["decoded"] == (r["text"] or "") and r["source"] == "src0" for r in got)
    assert encode(documents([(1, "x")]).limit(0), PATH).count() == 0


def odd_texts(prose):
    draw = np.random.default_rng(4)
    mixed = ["".join(draw.choice(list("abcdefgh -_.Eéñ漢\n"), 120)) for _ in range(40)]
    return [*TEXTS, *mixed, "z" * 64, "z" * 65, "=" * 400, prose(2, 400)]


def test_prose_is_filtered_without_the_loop_over_characters(model, prose, monkeypatch):
    monkeypatch.setattr(model, "table", piece_sampling.Table())
    monkeypatch.setattr(model, "lattice", None)
    texts = [prose(7, 2000), "two words"]
    assert [model.decode(x) for x in sample_batch(texts, np.arange(2, dtype=np.uint64), model, 1)] == texts


@pytest.mark.parametrize("power", [0.0, 1.0, 4.0])
def test_units_together_have_the_chances_that_the_loop_gives(prose, power, monkeypatch):
    model = piece_sampling.Lattices(PATH, power)
    units = list({w for t in odd_texts(prose) for w in t.replace("▁", "").replace(" ", " ▁").split(" ") if w})
    points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(u) for u in units])
    many = model.edges(points, lengths)
    monkeypatch.setattr(piece_sampling, "SHORT", 0)
    for a, b in zip(many, model.edges(points, lengths), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-12, atol=1e-300)


def test_ids_depend_neither_on_what_the_table_keeps_nor_on_equal_hashes(prose, monkeypatch):
    model = piece_sampling.Lattices(PATH, 1.0)
    texts = [t for k in range(3) for t in (*odd_texts(prose), prose(k, 500))]
    keys = splitmix(np.arange(len(texts), dtype=np.uint64))
    run = lambda: [x.tolist() for x in sample_batch(texts, keys, model, 1)]
    want = run()
    assert want == run()
    short = np.array([len(t) < 700 for t in texts])
    monkeypatch.setattr(piece_sampling, "BLOCK", 700)
    trims = []
    monkeypatch.setattr(piece_sampling.Table, "trim", lambda t, f=piece_sampling.Table.trim: (trims.append(t.edges), f(t), trims.append(t.edges)))
    for cache, some in ((2000, True), (60, False)):
        monkeypatch.setattr(piece_sampling, "CACHE", cache)
        trims.clear()
        kept = sample_batch([t for t, s in zip(texts, short, strict=True) if s], keys[short], piece_sampling.Lattices(PATH, 1.0), 1)
        assert [x.tolist() for x in kept] == [x for x, s in zip(want, short, strict=True) if s]
        assert any((b > 0) == some for a, b in zip(trims[::2], trims[1::2], strict=True) if b < a)
    monkeypatch.undo()
    model.table.points[:] = 1  # whatever a hash finds is now of other characters
    assert run() == want


def test_the_last_code_point_is_kept(model):
    text = f"a{chr(0x10FFFF)}▁b"
    assert [model.decode(x) for x in sample_batch([text], np.zeros(1, np.uint64), model, 1)] == [text]
