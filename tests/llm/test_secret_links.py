import random
import re

from pyspark.sql import functions as F

from kymora.llm.secret_links import find_secrets, listed

BASE = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"(AKIA[A-Z0-9]+)"), 1, 18),
    "hex": (re.compile(r"([0-9a-f]+)"), 1, 16),
}
KEY40 = "aB3" + "xY7/" * 9 + "q"
ACCESS = "AKIA" + "Z9" * 8


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(BASE.values()) for m in p.finditer(text or "") if len(m[g]) >= n]
    names = list(BASE)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_base_spans_same_as_plain_patterns(documents):
    parts = ["token", "TOKEN", "secret", "passwd", "Password", "api_key", "apikey", "=", ":", " ", "\"", "'", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "x", "é", "ſecret", "toKen", "😀", "\n", "/", "short"]
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(800)]
    got = {r["doc_id"]: r["b"] for r in find_secrets(documents(rows)).select("doc_id", listed(F.col("base")).alias("b")).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert sum(map(bool, got.values())) > 300


def spans(documents, text):
    return [(s["kind"], text[s["start"] : s["end"]]) for s in find_secrets(documents([(1, text)])).first()["spans"]]


def test_weak_parts_need_a_complement(documents):
    assert spans(documents, f"key {KEY40} end") == []
    assert spans(documents, "see https://api.example.com/v1 for more") == []
    assert spans(documents, f"{ACCESS} then {KEY40}") == [("access", ACCESS), ("secret", KEY40)]
    assert spans(documents, f"{KEY40} then {ACCESS}") == [("secret", KEY40), ("access", ACCESS)]
    assert spans(documents, f"{ACCESS} {'word ' * 100}{KEY40}") == [("access", ACCESS)]
    got = spans(documents, f"{ACCESS} {KEY40} at s3.eu-west-1.amazonaws.com")
    assert got == [("access", ACCESS), ("secret", KEY40), ("endpoint", "s3.eu-west-1.amazonaws.com")]
    assert [k for k, _ in spans(documents, f"{KEY40} at https://api.example.com")] == ["secret", "endpoint"]
    assert [k for k, _ in spans(documents, f"token = {KEY40}")] == ["assign"]  # a weak part inside a strong one is not told twice


def test_weak_secret_beside_an_endpoint(documents):
    for host in ("https://api.example.com", "s3.eu-west-1.amazonaws.com"):
        assert spans(documents, f"{KEY40} at {host}") == [("secret", KEY40), ("endpoint", host)]
        assert spans(documents, f"{host} with {KEY40}") == [("endpoint", host), ("secret", KEY40)]
        assert spans(documents, f"{KEY40} {'word ' * 100}{host}") == []
    assert spans(documents, f"{KEY40} or {KEY40}") == []
    assert spans(documents, "https://a.example.com and https://b.example.com") == []
    blank = find_secrets(documents([(1, f"use {KEY40} at https://api.example.com/v1")]), keep=("text",), blank=True).first()["text"]
    assert blank == "use [secret] at [endpoint]/v1"


def test_many_parts_in_one_place(documents):
    text = " ".join([ACCESS, KEY40] * 3000)
    assert len(spans(documents, text)) == 6000


def test_blanked_texts_hold_no_secret(documents):
    rows = [(1, f"a {ACCESS} b token='abcdefghijklmnop' c"), (2, "clean"), (3, None), (4, "")]
    got = {r["doc_id"]: r["text"] for r in find_secrets(documents(rows), keep=("text",), blank=True).collect()}
    assert got == {1: "a [access] b [assign]' c", 2: "clean", 3: None, 4: ""}


def test_odd_rows(odd, documents):
    docs, rows = odd
    got = find_secrets(docs, keep=("source",)).collect()
    assert len(got) == len(rows) and all(r["base"] == [] and r["spans"] == [] and r["source"] == "src0" for r in got)
    assert find_secrets(documents([(1, "x")]).limit(0)).count() == 0
