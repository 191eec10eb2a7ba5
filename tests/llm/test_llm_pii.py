"""Personal data spans against plain-Python statements of the rules."""

import hashlib
import random
import re
import time

import pytest

from incidentlab.llm import pii

from llm_fixtures import awkward, awkward_rows, frame, nothing

FIXED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": True,
            "ip": kind != "ip" or all(int(p) <= 255 for p in hit.split(".")),
            "card": 14 <= len(digits) <= 19 and luhn(digits),
            "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    out = [(m.start(), no, f"{kind}:{m.start()}:{m.end()}")
           for no, (kind, rx) in enumerate(FIXED.items())
           for m in re.finditer(rx, text or "", re.A) if holds(kind, m[0])]
    return sorted(out)


def check(spark, texts):
    got = {r.doc_id: r for r in pii.scan_documents(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text)
        base = ",".join(s for _, _, s in want)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (text[:200], base, got[i].spans)
        counts = [sum(no == k for _, no, _ in want) for k in range(4)]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == counts
        assert set(base.split(",")) - {""} <= set(got[i].spans.split(","))
    return got


def test_fixed_spans_by_definition(spark):
    check(spark, [
        "", "a@b.c", "x@a.com_y@b.org z", "a@b..c a@b.c.", "a%b+c@d-e.f-g.h", "a@b@c.d", "1.2.3.4.5.6.7.8",
        "256.1.1.1 255.255.255.255", "0001.002.3.4", "1.2.3.99999999999999999999999", "1.2.3", "9.1.2.3.4",
        "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111111111111112", "5 4111111111111111",
        "41111111111111114111111111111111", "4111  111111111111 1", "4111111111111111 x 4111111111111111 1",
        "+1 (974) 555-3436", "+1 (974) 555-3436 +49 30 1234567", "+1 2", "+1234567890123456", "+1 555 1234567 ",
        "é🙂 a@b.c 中文 +49 (30) 123456-78 \n10.0.0.1\r\n", "mail: a@b.c,c@d.e", "1.2.3.4\n5.6.7.8", "+1 23-45\n6789012",
    ])


def test_fixed_spans_of_random_texts(spark):
    r = random.Random(5)
    alphabets = ["a@.-_ 1", "0123456789 -", "+1 2().-3", "1.25 a", "a1@.+ -(\n"]
    check(spark, ["".join(r.choice(r_alpha) for _ in range(r.randint(1, 120)))
                  for r_alpha in alphabets for _ in range(300)])


@pytest.mark.parametrize("unit", ["a", "1", "a.", "1.", "1 ", "+1", "a@", "a@b.", "(", "1-", "AB12", "+1 2", "é"])
def test_long_runs_take_linear_time(spark, unit):
    text = unit * (300_000 // len(unit))
    t0 = time.perf_counter()
    row = pii.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.perf_counter() - t0 < 40
    if unit in ("a", "1", "a.", "(", "1-", "é"):
        assert row.base_sha256 == hashlib.sha256(b"").hexdigest()


def added(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.find_spans(rows).where("kind > 4").collect()
    return {(r.id, pii.KINDS[r.kind - 1].name, r.start, r.end, r.hit, r.score) for r in got}


def test_added_kinds(spark):
    texts = ["IBAN GB82WEST12345698765432 ok", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433",
             "xGB82WEST12345698765432", "token GB82WEST12345698765432", "my SSN is 078-05-1120.", "part 078-05-1120",
             "ssn 000-12-3456 ssn 123-00-4567", "call (415) 555-0100 now", "415-555-0100",
             "phone +1 415-555-0100"]
    assert added(spark, texts) == {
        (0, "iban", 5, 27, "GB82WEST12345698765432", 100), (1, "iban", 0, 27, "GB82 WEST 1234 5698 7654 32", 80),
        (4, "iban", 6, 28, "GB82WEST12345698765432", 50), (5, "ssn", 10, 21, "078-05-1120", 65),
        (8, "local_phone", 5, 19, "(415) 555-0100", 65)}


def test_context_moves_the_score_of_fixed_kinds_but_not_their_stay(spark):
    rows = spark.createDataFrame([(1, "server 10.0.0.1"), (2, "version 10.0.0.1"), (3, "x 10.0.0.1")],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.scores) for r in pii.scan_documents(rows).collect()}
    assert got == {1: ("ip:7:15", "95"), 2: ("ip:8:16", "30"), 3: ("ip:2:10", "60")}


def test_awkward_rows(spark):
    rows = awkward_rows() + [(12, "a@b.c " * 3000, "en", "a", 1), (12, "a@b.c", "en", "a", 1)]
    got = pii.scan_documents(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in got) == sorted(
        (r[0] is None, r[0] or 0, hashlib.sha256(",".join(s for _, _, s in brute(r[1])).encode()).hexdigest())
        for r in rows)
    assert pii.scan_documents(nothing(spark)).count() == 0
    assert "spans" in pii.scan_documents(awkward(spark)).columns


def test_no_python_in_the_plan(spark):
    plan = pii.scan_documents(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
