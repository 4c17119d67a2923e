import re

import pytest

from kymora.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """Kept words of (doc_id, text) rows with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def got(docs, *args):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(docs, *args).collect()}


@pytest.mark.parametrize("window,first", [(20, 10), (20, 5), (8, 8), (7, 3)])
def test_same_as_brute_force(documents, prose, window, first):
    shared = [prose(900 + i, 10 + 6 * i) for i in range(6)]
    rows = [(i, " \n".join([prose(i, 15 + i), shared[i % 6], prose(50 + i, 4), shared[(i * 5) % 6]])) for i in range(40)]
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, "a b " * 40), (53, "a b " * 13), (54, prose(1, 5)), (55, prose(1, 5)), (56, " ".join(["x"] * 50)), (57, None), (58, "")]
    docs = documents(rows).repartition(5)
    assert got(docs, window, first) == brute(rows, window)


def test_a_passage_in_very_many_documents(documents, prose):
    passage = prose(1, 60)
    rows = [(i, f"{prose(i, 12)} {passage} {prose(1000 + i, 3)}") for i in range(1500)]
    out = got(documents(rows).repartition(7))
    assert out == brute(rows, 20)
    assert out[0][1] == 0 and all(r[1] >= 60 for i, r in out.items() if i)


def test_odd_rows(odd, documents):
    docs, rows = odd
    out = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in remove_repeats(docs).collect())
    # the repeated rows are one document: "x x x ..." repeats inside itself from its second window on
    words = {i: len(WORD.findall(t or "")) for i, t in enumerate(t for _, t in rows)}
    assert [o[1] for o in out] == [n for _, n in sorted((str(r[0]), words[i]) for i, r in enumerate(rows))]
    assert [o for o in out if o[0] == "5"] == [("5", 30, 29)] * 2
    assert all(o[2] == 0 for o in out if o[0] != "5")
    assert remove_repeats(documents([(1, "x")]).limit(0)).count() == 0


def test_kept_columns_pass_through(documents):
    row = remove_repeats(documents([(1, "a  b\nc", "fr")]), keep=("lang", "n_chars")).first()
    assert (row["lang"], row["n_chars"], row["kept"]) == ("fr", 6, "a b c")
