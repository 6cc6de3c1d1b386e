import hashlib
import random
import re

import pytest

from photolith.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(s):
    d = digits(s)[::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def brute(text):
    out = {"email": [m.span() for m in EMAIL.finditer(text)]}
    out["ip"] = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(m[0]) % 10 == 0]
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return {k: v for k, v in out.items() if v}


def base(text):
    return {k: v for k, v in pii.find_spans(text, pii.automaton()).items() if k in pii.BASE_KINDS}


@pytest.mark.parametrize("seed", range(40))
def test_base_kinds_equal_regular_expressions_on_noise(seed):
    rng = random.Random(seed)
    anchors = pii.automaton()
    for _ in range(250):
        text = "".join(rng.choice(["a", "B", "7", "1", "4", "255", ".", "@", "+", "-", " ", "(", ")", "_", "é", "4111 1111 1111 1111", "+1 (212) 555-0100", "x@y.z", "1.2.3.4", "%"]) for _ in range(rng.randrange(60)))
        assert {k: v for k, v in pii.find_spans(text, anchors).items() if k in pii.BASE_KINDS} == brute(text), text


def test_further_kinds():
    anchors = pii.automaton()
    text = 'see @some_one or ftp://bob:pw@host/x, IBAN GB82 WEST 1234 5698 7654 32, account no. 12345678, token = "f3ef4d6b2755a36d"'
    found = {k: [text[a:b] for a, b in v] for k, v in pii.find_spans(text, anchors).items()}
    assert found["handle"] == ["@some_one"]
    assert found["login"] == ["bob:pw"]
    assert found["iban"] == ["GB82 WEST 1234 5698 7654 32"]
    assert found["account"] == ["12345678"]
    assert found["secret"] == ["f3ef4d6b2755a36d"]
    assert pii.find_spans(None, anchors) == {} == pii.find_spans("", anchors)


def test_query_on_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "é a@b.co 1.2.3.4", "x"), (3, "é a@b.co 1.2.3.4", "x"), (None, "z" * 200_000 + " a@b.co", "x")], "doc_id long, text string, spans string")
    rows = sorted(pii.find(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.spans for r in rows] == ["", "", "email:2:8,ip:9:16", "email:2:8,ip:9:16", "email:200001:200007"]
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(df.limit(0)).count() == 0
    kept = pii.redact(df).orderBy("doc_id").collect()
    assert kept[-1].text == "é [EMAIL] [IP]" and kept[-1].spans == "x"


def test_whole_table_against_regular_expressions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in pii.find(docs).collect():
        want = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in brute(texts[r.doc_id]).get(k, []))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
