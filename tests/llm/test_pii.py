import random
import re
import time

import pytest
from pyspark.sql import functions as F

from auditlake.llm import pii
from auditlake.llm.queries import QUERIES

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
CARD, IBAN = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"


def passes(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    """Base spans by the expressions as they are written down."""
    return [(kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(kind, m[0])]


def base(text):
    return [(s["kind"], s["start"], s["end"]) for s in pii.spans_of(text) if s["base"]]


def test_base_spans_equal_the_plain_expressions():
    rnd = random.Random(3)
    parts = ["a", "Z9", "@", "@", ".", ".", "-", "+", "%", "_", " ", " ", "(", ")", "0", "1", "12", "255", "256", "999", "é", "😀", "\n", "a@b.c", "1.2.3.4",
             "+1 (555) 010-9999", CARD, "4111-1111-1111-1111", "378282246310005", ",", "٣"]
    for _ in range(6000):
        text = "".join(rnd.choices(parts, k=rnd.randrange(0, 40)))
        assert base(text) == plain(text), text
    for text in ("a@b.c_d@e.f", " @b.c@d.e", "a@b@c.d", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "0001.2.3.0255", "1.2.3.2555", "+1" + " " * 30 + "23456789 "):
        assert base(text) == plain(text), text


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" * 1_000_000, "1 " * 500_000, "1." * 500_000, "@a." * 300_000, " @b.c" * 200_000, "+1" + " " * 1_000_000,
                                  "+1 " * 300_000, "AB12" * 250_000, "DE89 " * 200_000, "(030) " * 200_000])
def test_long_texts_take_time_in_proportion(text):
    started = time.process_time()
    pii.spans_of(text)
    assert time.process_time() - started < 10


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("378282246310005")
    assert pii.mod_97("DE89370400440532013000") and not pii.mod_97("DE88370400440532013000") and pii.mod_97("GB82WEST12345698765432")


def kinds(text):
    return [s["kind"] for s in pii.spans_of(text)]


def test_words_nearby_decide_added_spans():
    assert kinds(f"pay to {IBAN}, thanks") == ["iban"]
    assert kinds("pay to DE88 3704 0044 0532 0130 00") == []
    assert kinds(f"{IBAN}X") == [] and kinds(f"X{IBAN}") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("123-45-6789") == [] and kinds("ssn 666-45-6789") == []
    assert kinds("social security, order 123-45-6789") == []
    assert kinds("call (030) 1234-5678") == ["local_phone"] and kinds("see (030) 1234-5678") == []
    near, far = pii.spans_of(f"card {CARD}")[0], pii.spans_of(f"order {CARD}")[0]
    assert near["kind"] == far["kind"] == "card" and near["score"] > far["score"]


def test_places_are_code_points_and_rows_stay(spark):
    text = f"😀é {CARD} x@y.example ssn 123-45-6789"
    rows = [(1, text, "a"), (1, text, "a"), (2, None, None), (None, "", "b"), (3, "clean words", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, personal_data string")
    found = pii.find_personal_data(docs)
    assert found.columns == ["doc_id", "text", "personal_data"] and found.count() == 5
    spans = {r.doc_id: r.personal_data for r in found.collect()}
    assert [(s.kind, text[s.start:s.end]) for s in spans[1]] == [("email", "x@y.example"), ("card", CARD), ("ssn", "123-45-6789")]
    assert spans[2] == spans[None] == spans[3] == []
    masked = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert masked[1] == "😀é [card] [email] ssn [ssn]" and masked[2] is None and masked[None] == "" and masked[3] == "clean words"
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_overlapping_spans_are_redacted_once(spark):
    docs = spark.createDataFrame([("call +1 415 555 2671 now",), ("+4111111111111111",)], "text string")
    found = pii.find_personal_data(docs)
    assert [r.text for r in pii.redact(found).collect()] == ["call [phone] now", "+[card]"]


def test_query_against_the_plain_expressions(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    import hashlib
    rows = QUERIES["op12_pii"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        spans = plain(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in spans) for kind in PLAIN)
        assert r.spans.startswith(listed)
    assert sum(r.n_email + r.n_ip + r.n_phone for r in rows) > 5
    assert QUERIES["op12_pii"](spark, sf).where(F.col("spans").isNull()).count() == 0
