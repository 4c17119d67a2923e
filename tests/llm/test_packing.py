import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from kymora.llm.packing import first_fit_decreasing, pack, settle

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_first_fit(sizes, capacity):
    bins, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for b in range(len(bins)):
            if room[b] >= sizes[i]:
                break
        else:
            b = len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] -= sizes[i]
    return bins


def test_tournament_tree_is_first_fit_decreasing():
    for seed in range(30):
        rng = random.Random(seed)
        sizes = np.array([rng.randint(1, 100) for _ in range(rng.randint(0, 60))], np.int64)
        assert first_fit_decreasing(sizes, 100) == plain_first_fit(sizes.tolist(), 100)


def test_settled_sequences_hold_every_id_once_and_waste_little():
    for seed in range(30):
        rng = random.Random(seed)
        sizes = np.array([rng.randint(1, 63) for _ in range(rng.randint(1, 200))], np.int64)
        rows = settle(first_fit_decreasing(sizes, 64), sizes, 64, 4)
        seen = defaultdict(set)
        for row in rows:
            fill = sum(p[2] for p in row)
            assert 0 < fill <= 64
            assert fill > 60 or fill & (fill - 1) == 0
            for item, start, length in row:
                places = set(range(start, start + length))
                assert length > 0 and not places & seen[item]
                seen[item] |= places
        assert all(seen[i] == set(range(n)) for i, n in enumerate(sizes))


def check(docs, rows, **more):
    library = Tokenizer.from_file(PATH)
    want = sorted((str(i), library.encode(t or "").ids + [0]) for i, t in rows)
    pieces = pack(docs, PATH, **more).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        by_doc[str(p["doc_id"]), p["doc_tokens"]].append((p["start"], ids))
        by_sequence[p["sequence_id"]].append((p["offset"], len(ids)))
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n
            at += n
        assert at <= more.get("capacity", 1024)
    return want, by_doc


def test_every_id_lies_in_one_piece(documents, prose):
    rows = [(i, prose(i, 7 * i)) for i in range(60)] + [(100, ""), (101, None), (102, "q" * 3000)]
    want, by_doc = check(documents(rows), rows, capacity=64, group=16)
    got = sorted((d, [i for _, ids in sorted(parts) for i in ids]) for (d, _), parts in by_doc.items())
    assert got == want


def test_odd_rows(odd, documents):
    docs, rows = odd
    want, by_doc = check(docs, rows)
    assert sum(len(ids) for parts in by_doc.values() for _, ids in parts) == sum(len(ids) for _, ids in want)
    assert pack(documents([(1, "x")]).limit(0), PATH).count() == 0


def test_equal_rows_are_spread(documents, prose):
    rows = [(7, prose(1, 100))] * 400
    groups = pack(documents(rows), PATH, group=32).selectExpr("sequence_id >> 40 AS g").distinct().count()
    assert groups > 2


def test_arrival_order_does_not_matter(documents, prose):
    rows = [(i, prose(i, 5 + 11 * i % 300)) for i in range(200)] + [(500, "q w " * 5000)]
    packings = [
        sorted((r["doc_id"], r["start"], r["sequence_id"], r["offset"], bytes(r["ids"])) for r in pack(docs, PATH, capacity=128, group=16).collect())
        for docs in (documents(rows).coalesce(1), documents(rows[::-1]).repartition(7), documents(rows).repartition(3, "text"))
    ]
    assert packings[0] == packings[1] == packings[2]
