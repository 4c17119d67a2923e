import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kymora.llm.byte_pieces import PieceEncoder
from kymora.llm.token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
CHARS = ["a", "b", " ", "  ", "'s", "'", "’", "1", "\n", "\t", "é", "²", " ", "漢", "<|endoftext|>", "'ll", "'re", "　", "!", "Z", "😀", "​", "ſ", "<|endof", "́", "don't", "''", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def noise(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(CHARS) for _ in range(n))


def test_pieces_give_the_ids_of_the_library(library):
    texts = [noise(i, i % 60) for i in range(3000)]
    got = PieceEncoder(PATH).encode(texts)
    assert [x.tolist() for x in got.split()] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_full_cache_changes_nothing(library, prose):
    texts = [prose(i, 300) for i in range(30)]
    encoder = PieceEncoder(PATH, cache=50)
    for t in texts:
        assert encoder.encode([t]).ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_blocks_of_a_long_text_end_at_piece_starts(library, prose, monkeypatch):
    from kymora.llm import byte_pieces

    monkeypatch.setattr(byte_pieces, "BLOCK", 200)
    text = prose(1, 500) + "z" * 900 + noise(4, 300).replace("<|endoftext|>", "") + prose(2, 200)
    assert PieceEncoder(PATH).encode([text]).ids.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (300, 32)])
def test_spliced_chunks_count_like_whole_texts(spark, documents, library, prose, chunk, overlap):
    texts = [prose(i, 40 * i) for i in range(8)] + [noise(i, 400) for i in range(12)]
    texts += ["z" * 1000, " " * 500, "a" * 257 + " <|endoftext|>" * 40, "日本語" * 200, "", None]
    got = {r["doc_id"]: r for r in count_tokens(documents(enumerate(texts)), PATH, chunk, overlap).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids), i
        assert got[i]["n_bytes"] == len((t or "").encode())


def test_odd_rows(spark, odd, documents, library):
    docs, rows = odd
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in count_tokens(docs, PATH, 40, 8).collect())
    assert got == sorted((str(i), len((t or "").encode()), len(library.encode(t or "").ids)) for i, t in rows)
    assert count_tokens(documents([(1, "x")]).limit(0), PATH).count() == 0


def test_other_tokenizers_encode_whole_texts(documents, prose):
    import sentencepiece

    text = prose(3, 400)
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert count_tokens(documents([(1, text)]), model, 50).first()["n_tokens"] == len(sentencepiece.SentencePieceProcessor(model_file=model).encode(text))
    word = public_tokenizers.path("word_bpe_49k.json")
    assert count_tokens(documents([(1, text)]), word, 50).first()["n_tokens"] == len(Tokenizer.from_file(word).encode(text, add_special_tokens=False).ids)
