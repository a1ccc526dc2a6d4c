import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pvlens.llm.pii import BASE, KINDS, find_spans, redact


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def brute(text):
    """The base spans as the contract states them."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(BASE[k], a, e) for a, k, e in sorted(out)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in spans).encode()).hexdigest()


def test_query(query, texts):
    rows = query("op8_pii")
    assert set(rows) == set(texts)
    for i, r in rows.items():
        spans = brute(texts[i])
        assert r["base_sha256"] == digest(spans)
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]
        found = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert [(k, str(a), str(e)) for k, a, e in spans] == [f for f in found if f[0] in BASE]


EXAMPLES = [
    "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.2.3 001.02.3.4", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (555) 123-4567 +49", "a" * 40_000 + " b@c.de", "1 " * 9_000, "1.1.1.1" * 900, "+1" + "(" * 4_000,
    "00000000000.1.1.1 256.1.1.1 1.1.1.0255 1.1.1.1000", " x@y.zz \U0001F600 +49123456789 ",
    " ".join(f"u{i}@x.org" for i in range(1500)), "5500 0000 0000 0004-", "@a.b c@d e@f.g.h-"]


def spans_of(spark, texts):
    rows = find_spans(spark.createDataFrame(list(enumerate(texts)), "n int, text string")).orderBy("n").collect()
    return [[(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in BASE] for r in rows]


def test_examples(spark):
    assert spans_of(spark, EXAMPLES) == [brute(t) for t in EXAMPLES]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("a1.@+- (9:é0", max_size=60), min_size=40, max_size=40))
def test_random_texts(spark, texts):
    assert spans_of(spark, texts) == [brute(t) for t in texts]


def test_method_kinds(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 ok", "iban DE89 3704 0044 0532 0130 01", "ssn 123-45-6789",
             "code 123-45-6789", "ssn 666-45-6789"]
    rows = find_spans(spark.createDataFrame(list(enumerate(texts)), "n int, text string")).orderBy("n").collect()
    found = [[(s["kind"], s["score"]) for s in r["pii"] if s["kind"] not in BASE] for r in rows]
    assert found == [[("iban", 1.0)], [], [("ssn", 0.8)], [], []]
    assert [k for k in KINDS if k not in BASE] == ["iban", "ssn"]


def test_ibans_before_words_and_digits(spark):
    de, gb, mt = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    unknown = "ZZ33 1234 5678 9012 345"  # no country of the registry
    cases = [(f"IBAN {de} Bitte zahlen", [de]), ("IBAN: DE89370400440532013000 BIC COBADEFFXXX", [de.replace(" ", "")]),
             (f"bank account {gb} Please", [gb]), (f"{de} 2024 end", [de]), (f"{de} 2 {gb} X", [de, gb]),
             (f"REF AB12 3456 7890 {de} BIC", [de]), (f"\U0001F600 é {mt} OK", [mt]), (f"{mt} {de} {mt}", [mt, de, mt]),
             (f"order 7, invoice serial {de} Bitte", [de]), (f"iban {unknown} ABC", [unknown]),
             (f"serial {unknown} ABC", []), (f"{de}1", []), (f"x{de}", []), ("DE89 3704 0044 0532 0130 01 Bitte", []),
             ("AB12 " * 3000 + de, [de]), (f"{de} " * 500, [de] * 500)]
    rows = find_spans(spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "n int, text string"))
    got = [[t[s["start"]:s["end"]] for s in r["pii"] if s["kind"] == "iban"]
           for r, (t, _) in zip(rows.orderBy("n").collect(), cases)]
    assert got == [found for _, found in cases]
    one = spark.createDataFrame([(f"IBAN {de} Bitte",)], "text string")
    assert redact(one).first()["text"] == "IBAN [IBAN] Bitte"


def test_redaction(spark):
    rows = spark.createDataFrame([(1, "mail x@y.org, 10.0.0.1 end"), (2, None), (3, ""), (4, "+1.1.1.1.1.1.1.1.1 é")],
                                 "n int, text string")
    got = {r["n"]: r["text"] for r in redact(rows).collect()}
    assert got == {1: "mail [EMAIL], [IP] end", 2: None, 3: "", 4: "[PHONE] é"}


@pytest.mark.parametrize("out", ["pii", "fingerprint"])
def test_odd_rows(odd, empty, out):
    found = find_spans(odd, out=out)
    assert found.count() == odd.count() and find_spans(empty).count() == 0
    assert set(found.columns) == set(odd.columns) | {out}
    assert all(r[out] == [] for r in found.where("text is null or text = ''").collect())
    assert redact(odd).schema.names == odd.columns
