import random
import re

import pytest

from kymora.llm.license_scan import BASE, FREEDOM, NOTICES, evaluated, family, find_licenses, postfix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = WORD.findall(fold(text))
    places, labels = [], set()
    for phrases, placed in ((BASE, True), (NOTICES, False)):
        for phrase, label in phrases:
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += [(i, label) for i in at if placed]
            labels |= {label} if at else set()
    return len(words), sorted(places), labels


def test_phrases_same_as_brute_force(documents):
    rng = random.Random(6)
    parts = ["mit", "MIT", "license", "License", "licensed", "under", "the", "apache", "general", "public", "lesser", "gnu", "gpl", "cc", "by", "nc", "sa", "é", "中", "x", "mit license", "0", "bsd"]
    gaps = [" ", " ", "\n", "-", ", ", "", "\t--", " "]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))) for i in range(600)]
    for r in find_licenses(documents(rows)).collect():
        n, places, labels = brute(rows[r["doc_id"]][1])
        assert r["n_words"] == n
        assert sorted(zip(r["places"], r["place_labels"], strict=True)) == places
        assert set(r["labels"]) == labels


def value(expression):
    """Recursive reading of a bracketed expression, another way to the same value."""
    tokens = re.findall(r"[()]|[a-z0-9.+-]+", expression)

    def atom():
        if tokens[0] == "(":
            tokens.pop(0)
            v = either()
            tokens.pop(0)
        else:
            v = FREEDOM[family(tokens.pop(0))]
        while tokens and tokens[0] == "with":
            tokens.pop(0)
            tokens.pop(0)
            v += (1 - v) / 2
        return v

    def both():
        v = atom()
        while tokens and tokens[0] == "and":
            tokens.pop(0)
            v = min(v, atom())
        return v

    def either():
        v = both()
        while tokens and tokens[0] == "or":
            tokens.pop(0)
            v = max(v, both())
        return v

    return either()


def test_expressions_same_as_recursive_reading():
    rng = random.Random(8)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(["mit", "apache-2.0", "gpl-2.0-only", "lgpl-2.1+", "mpl-2.0", "cc-by-nc-4.0", "licenseref-own"])
            return name + (" with classpath-exception-2.0" if rng.random() < 0.2 else "")
        text = f"{make(depth - 1)} {rng.choice(['and', 'or'])} {make(depth - 1)}"
        return f"({text})" if rng.random() < 0.6 else text

    for _ in range(500):
        e = make(4)
        tokens, end, whole = postfix(e, 0, True)
        assert whole and end == len(e) and "(" not in tokens
        assert evaluated(tokens)[0] == pytest.approx(value(e))


def test_precedence_and_broken_expressions():
    assert postfix(" mit or gpl-2.0 and apache-2.0\n", 0, True)[0] == ["mit", "gpl-2.0", "apache-2.0", "and", "or"]
    assert postfix("gpl-2.0 with x and mit", 0, True)[0] == ["gpl-2.0", "x", "with", "mit", "and"]
    assert postfix("(mit or gpl-2.0", 0, True)[::2] == (["mit", "gpl-2.0", "or"], False)
    assert postfix("mit or", 0, True)[::2] == (["mit"], False)
    assert postfix("mit) or x", 0, True) == (["mit"], 3, True)
    assert postfix("mit released", 0, True) == (["mit"], 3, True)
    assert postfix(" see file", 0, False)[0] == []
    assert postfix("", 0, True)[0] == []
    deep = "(" * 20000 + "mit" + ")" * 20000
    assert postfix(deep, 0, True)[0] == ["mit"]


def found(documents, text):
    r = find_licenses(documents([(1, text)])).first()
    return r["labels"], r["score"]


def test_tags_and_score(documents):
    assert found(documents, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\ncode") == (["gpl", "mit"], FREEDOM["mit"])
    assert found(documents, "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note") == (["gpl"], pytest.approx(0.65))
    assert found(documents, "SPDX-License-Identifier: LicenseRef-Own") == (["other"], FREEDOM["other"])
    assert found(documents, "license: Apache-2.0, released under the MIT License.") == (["apache", "mit"], FREEDOM["apache"])
    assert found(documents, "license: see the file") == ([], 0.0)
    assert found(documents, '"license": "BSD-3-Clause"') == (["bsd"], FREEDOM["bsd"])
    assert found(documents, "This work is licensed under the GNU Lesser General Public License") == (["gpl", "lgpl"], FREEDOM["gpl"])


def test_long_text_and_ties(documents):
    text = "mit license " * 30000 + "x " * 1000000 + "Apache\nLicense"
    r = find_licenses(documents([(1, text), (1, text)])).collect()
    assert r[0] == r[1]
    assert r[0]["n_words"] == 1060002 and len(r[0]["places"]) == 30001
    assert r[0]["places"][0] == 0 and r[0]["places"][29999] == 59998 and r[0]["places"][-1] == 1060000


def test_odd_rows(odd, documents):
    docs, rows = odd
    got = find_licenses(docs).collect()
    assert len(got) == len(rows)
    assert all(r["labels"] == [] and r["places"] == [] and r["score"] == 0 for r in got)
    assert sorted(r["n_words"] for r in got) == sorted(len(WORD.findall(fold(t))) for _, t in rows)
    assert find_licenses(documents([(1, "x")]).limit(0)).count() == 0
