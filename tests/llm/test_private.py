"""Personal data: plain spans against the bare patterns, disguises by planted cases."""

import hashlib
import random
import re
import time

import pytest

from noteforge.llm import private

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    total = 0
    for i, d in enumerate(int(c) for c in reversed(s)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """The contract's patterns as they stand."""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_plain_spans_are_the_patterns():
    rng = random.Random(3)
    bits = ["a", "b.c", "@", "@x.y", ".", "%q", "+", "+1", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "5", "12", "256", "1.2.3.4", "300.1.1.1", "(017) ", "é", "ж", "\n", "0.0.0.0", "00255", "🙂", "@@", "x@y"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert private.plain_spans(text) == plain(text), text


HIDDEN = [
    ("email", "write to {john (at) example (dot) com} now", "john@example.com"),
    ("email", "write to {john.doe [AT] mail.example.org}, please", "john.doe@mail.example.org"),
    ("email", "{jane dot roe at example dot co dot uk} is mine", "jane.roe@example.co.uk"),
    ("email", "escríbeme: {ana arroba correo punto es}", "ana@correo.es"),
    ("email", "{аnnа@exаmple.com} (Cyrillic a)", "anna@example.com"),
    ("email", "{ｂｏｂ＠ｍａｉｌ．ｃｏｍ} in full width", "bob@mail.com"),
    ("email", "{bo\u200bb@ma\u00adil.com} with breaks", "bob@mail.com"),
    ("ip", "host {192 dot 168 dot 1 dot 10} is down", "192.168.1.10"),
    ("ip", "host {one nine two dot one six eight dot zero dot one} is down", "192.168.0.1"),
    ("ip", "host {10[.]0[.]0[.]7} is down", "10.0.0.7"),
    ("ip", "host {１０．２０．３０．４０}", "10.20.30.40"),
    ("card", "card {four one one one one one one one one one one one one one one one}, thanks", "4111111111111111"),
    ("card", "card {4111\u00a01111\u00a01111\u00a01111} by no-break spaces", "4111 1111 1111 1111"),
    ("card", "card {٤١١١ ١١١١ ١١١١ ١١١١}", "4111 1111 1111 1111"),
    ("phone", "call {plus four four two zero seven nine four six zero nine five eight} today", "+442079460958"),
    ("phone", "call {+1 five five five, zero one two, three four five six} today", "+1 5550123456"),
    ("phone", "rufen Sie {plus vier neun drei null eins zwei drei vier fünf sechs} an", "+4930123456"),
    ("phone", "call {＋1 (555) 010‑2030}", "+1 (555) 010-2030"),
    ("phone", "call {+1 555 (five five five) 0123}", "+1 555 (555) 0123"),
]


@pytest.mark.parametrize(("kind", "marked", "value"), HIDDEN)
def test_disguises(kind, marked, value):
    for front, back in (("", ""), ("漢字 🙂 ", " one of us at noon dot 5"), ("word " * 500, " word" * 500)):
        start, end = marked.index("{") + len(front), marked.index("}") - 1 + len(front)
        text = front + marked.replace("{", "").replace("}", "") + back
        found = [(r["kind"], r["start"], r["end"], r["value"]) for r in private.private_spans(text) if not r["base"]]
        assert (kind, start, end, value) in found and len(found) == 1
        assert [(r["start"], private.KINDS.index(r["kind"]), r["end"]) for r in private.private_spans(text) if r["base"]] == plain(text)


@pytest.mark.parametrize(
    "text",
    [
        "We met at noon. The dot on the map at point zero is one of two or three.",
        "See us at example.com or at the office dot",
        "bob@mail.com point final",
        "+44 20 7946 0958 one of us, two of them",
        "one two three four five six seven eight nine ten, one two three",
        "costs 5 plus 1234567890 dollars (at least)",
        "Der Punkt ist: null eins zwei drei. Привет, мир! Καλημέρα κόσμε, 10 м² – 1990–1995",
        "version 1.2.3.4 dot 5",
        "",
    ],
)
def test_clean_texts_stay_clean(text):
    assert [r for r in private.private_spans(text) if not r["base"]] == []


def test_long_runs_take_linear_time():
    for text in ("a." * 300_000, "1" * 500_000, "1." * 300_000, "a@" * 200_000, "+1" + " " * 400_000, "one " * 100_000, "а" * 300_000, "(at) " * 60_000, " dot" * 100_000, "1 " * 200_000, "a (at) b.cc 1[.]2.3.4 5.6.7.8 " * 20_000):
        began = time.time()
        found = private.private_spans(text)
        assert time.time() - began < 20, text[:5]
        assert len(found) == {"1.1.1": 75_000, "a (at": 60_000}.get(text[:5], 0)


def test_odd_rows_and_none(spark, odd_docs, no_docs):
    out = private.find_private(odd_docs)
    assert out.count() == odd_docs.count() and private.find_private(no_docs).count() == 0
    df = spark.createDataFrame([(None, None), (1, ""), (2, "a@b.c"), (2, "a@b.c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in private.find_private(df).collect()) == [(0, 0), (1, 0), (2, 1), (2, 1)]


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = private.op13_private_spans(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = plain(docs[r["doc_id"]])
        listed = ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
        for k, kind in enumerate(private.KINDS):
            assert r[f"base_{kind}"] == sum(x[1] == k for x in spans)
            assert r[f"n_{kind}"] == sum(x.startswith(kind) for x in r["spans"].split(","))
    assert sum(r["base_email"] + r["base_card"] for r in rows) > 0
