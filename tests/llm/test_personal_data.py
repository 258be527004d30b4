"""Personal data: fixed spans against plain regular expressions, and what the trees add."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from taxaflow.llm import personal_data, queries
from taxaflow.llm.secrets import redacted

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def fixed_spans(text):
    found = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS.values()) for m in re.finditer(p, text) if holds(list(PATTERNS)[k], m[0])]
    return [(list(PATTERNS)[k], start, end) for start, k, end in sorted(found)]


def spans_by_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["found"]] for r in personal_data.find_personal_data(docs).collect()}


TRICKY = [
    "a@b.c%d@e.f and a@b@c.d, x.@y.z- é@é.de 🙂q+1@mail-7.example.com.",
    "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.001 1.2.3 256.1.1.1.1 12..1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 3782822463100059 41111111111111111111111",
    "+1 (017) 555-7713 +12345678 +123456789- +1 2 3 + 49 30 1234567 ++4930123456 +49.30.123456.",
    "0" * 40 + " " + "5-" * 50 + "1.1" * 30 + "a" * 500 + "@" * 5 + "b.c",
    "",
]


CHARACTERS = "01345678+-. ()@ab.é🙂%"


def test_fixed_spans_are_those_of_the_patterns(spark):
    draw = random.Random(4)
    texts = TRICKY + ["".join(draw.choices(CHARACTERS, weights=[9] * 8 + [2] * (len(CHARACTERS) - 8), k=300)) for _ in range(60)]
    got = spans_by_text(spark, texts)
    for i, text in enumerate(texts):
        assert [s for s in got[i] if s[0] in PATTERNS] == fixed_spans(text), text


def test_long_runs_take_no_longer_than_their_length(spark):
    texts = ["a" * 2_000_000 + "@x", "1" * 2_000_000, "1.1" * 500_000, "+1" + " (" * 500_000, "1 " * 200_000]
    got = spans_by_text(spark, texts)
    assert got[0] == got[1] == got[3] == []
    quads = [("ip", m.start(), m.end()) for m in re.finditer(PATTERNS["ip"], texts[2]) if holds("ip", m[0])]
    assert [s for s in got[2] if s[0] in PATTERNS] == quads


@pytest.fixture(scope="module")
def letters(spark):
    """Numbers in international and national forms, checked and failing cards, and numbers that are neither."""
    draw, texts = random.Random(9), []

    def card():
        body = "4" + "".join(draw.choices("0123456789", k=14))
        return next(body + d for d in "0123456789" if holds("card", body + d))

    for _ in range(1500):
        area, line, rest = draw.randrange(200, 999), draw.randrange(100, 999), draw.randrange(1000, 9999)
        texts.append(draw.choice([
            f"please call +1 ({area}) {line}-{rest} today",
            f"please call +1 ({area}) {line}-{rest} today",
            f"order 20{draw.randrange(10, 25)}-{draw.randrange(10, 13)}-{draw.randrange(10, 29)} came",
            f"paid by {card()} then",
            f"serial {draw.randrange(10**15, 10**16)}/{draw.randrange(100)} of it",
            f"host {draw.randrange(256)}.{draw.randrange(256)}.3.4 is up",
            f"release {draw.randrange(256, 999)}.{draw.randrange(400, 999)}.{area}.{rest} is out",
            f"mail jo{area}@example.com now",
            f"mail jo{area}@example.c{area} now",
        ]))
    return texts


def test_trees_add_forms_that_no_check_decides(spark, letters):
    asked = ["please call (212) 555-7713 today", "order 2024-10-11 came", "mail jo (at) example (dot) com now", "no number here"]
    got = spans_by_text(spark, letters + asked)
    national, date, spelled, plain = (got[len(letters) + i] for i in range(4))
    assert [k for k, _, _ in national] == ["phone_like"]
    assert asked[0][national[0][1] : national[0][2]] == "(212) 555-7713"
    assert date == plain == []
    assert [asked[2][s:e] for k, s, e in spelled if k == "email_like"] == ["jo (at) example (dot) com"]
    for i, text in enumerate(letters):
        assert [s for s in got[i] if s[0] in PATTERNS] == fixed_spans(text)


def test_a_selected_span_never_fails_a_check_nor_overlaps_a_fixed_one(spark, letters):
    got = spans_by_text(spark, letters + [t.replace("+1 ", "") for t in letters])
    assert any(kind == "phone_like" for spans in got.values() for kind, _, _ in spans)
    for spans in got.values():
        fixed = [(s, e) for k, s, e in spans if k in PATTERNS]
        for kind, start, end in spans:
            if kind not in PATTERNS:
                assert all(end <= s or e <= start for s, e in fixed)


def test_thresholds_hold_the_precision(spark):
    rows = [("phone", f"v{i}", "", i % 10 != 0 if i < 4000 else False, 0.9 - 0.1 * (i // 1000)) for i in range(8000)]
    frame = spark.createDataFrame(rows, "kind string, value string, before string, label boolean, score double")
    assert personal_data.thresholds(frame) == {}  # nine in ten are right at the top already
    better = frame.withColumn("label", F.col("score") > 0.55)
    assert personal_data.thresholds(better)["phone"] == pytest.approx(0.6)


def test_training_rows_are_bounded(spark, monkeypatch):
    names = ", ".join(f"{f} int" for f in personal_data.FEATURES)
    rows = [(*[i % 99 if f in ("length", "n_digits") else 0 for f in personal_data.FEATURES], "phone", i % 2 == 0, f"v{i}", "") for i in range(3000)]
    frame = spark.createDataFrame(rows, names + ", kind string, label boolean, value string, before string")
    whole = personal_data.sample(frame).count()
    monkeypatch.setattr(personal_data, "TRAIN_ROWS", 50)
    assert whole > 100 and 20 < personal_data.sample(frame).count() < 100


def test_edges(spark, edge_docs, no_docs):
    got = personal_data.find_personal_data(edge_docs)
    assert got.count() == edge_docs.count()
    assert got.where("doc_id IS NULL").count() == 1
    assert personal_data.find_personal_data(no_docs).count() == 0


def test_repeated_rows_get_equal_spans(spark):
    text = "mail a@b.de or +49 30 1234567"
    docs = spark.createDataFrame([(1, text), (1, text), (1, "other 1.2.3.4"), (None, text)], "doc_id long, text string")
    got = sorted([(s["kind"], s["start"], s["end"]) for s in r["found"]] for r in personal_data.find_personal_data(docs).collect())
    assert got == sorted([fixed_spans(text)] * 3 + [fixed_spans("other 1.2.3.4")])


def test_spans_can_be_redacted(spark):
    text = "mail a@b.de or +49 30 1234567"
    found = personal_data.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert found.select(redacted(F.lit(text), F.col("found"), "[x]")).first()[0] == "mail [x] or [x]"


def test_query_against_plain_patterns(spark):
    directory = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, directory, "documents").collect()}
    got = queries.op11_personal_data(spark, directory).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = fixed_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and "_like" not in s] == [f"{k}:{s}:{e}" for k, s, e in spans]
