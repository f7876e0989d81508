"""Op 11 against plain regular expressions, checksums by hand and the SQL."""

import hashlib
import random
import re

import pytest
from conftest_llm import frame

from runwise.llm import pii


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in pii.PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                  "card": 13 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(spark, rows):
    got = sorted(pii.report(frame(spark, [(i, t, "en") for i, t in rows])).collect(), key=str)
    want = []
    for i, t in rows:
        base = base_spans(t)
        n = [sum(s.startswith(k + ":") for s in base) for k in pii.PLAIN]
        want.append((i, *n, hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
    for r in got:
        listed = r.spans.split(",") if r.spans else []
        assert len(listed) == sum(r[1:5]) + r.n_added
    return got


def test_base_kinds_equal_plain_regular_expressions(llm):
    rng = random.Random(5)
    pieces = ["a.b@c.d", "x%y@e.f", "@", ".", "-", " ", "+", "(", ")", "1", "22", "255", "256", "0007", "4041894974608795", "+1 (988) 555-2485",
              "é", "😀", "a", "Z_", "\n", "1.2.3.4", "4041 8949-7460 8795", "+49.30.1234567", "b@", "c-d.e"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(1, 30)))) for i in range(600)]
    check(llm, rows)


def test_odd_rows(llm, odd_rows):
    rows = [(i, t) for i, t, _ in odd_rows] + [(20, "me@mail.example.com " * 3000), (20, "me@mail.example.com " * 3000)]
    check(llm, rows)
    assert pii.report(frame(llm, [])).count() == 0


@pytest.mark.parametrize("run", ["9" * 300_000, "a" * 300_000, "1." * 200_000, "a.b" * 100_000 + "@", "+" + "1 " * 100_000, "AB12" * 80_000, "(123)" * 60_000])
def test_long_runs_are_linear(llm, run):
    got = pii.report(llm.createDataFrame([(1, run + " x@y.zz")], "doc_id long, text string")).collect()[0]
    assert f"email:{len(run) + 1}:{len(run) + 7}" in got.spans


# Text -> what is added to the base kinds.
ADDED = {
    "pay to GB82 WEST 1234 5698 7654 32 or DE89370400440532013000.": [ ("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000")],
    "BE68 5390 0754 7034 ALSO": [("iban", "BE68 5390 0754 7034")],
    "GB82 WEST 1234 5698 7654 33 DE89370400440532013001 XDE89370400440532013000": [],
    "my SSN is 123-45-6789": [("ssn", "123-45-6789")],
    "part 123-45-6789, and 9123-45-6789": [],
    "SSN 000-45-6789, SSN 666-45-6789 or 123-00-6789": [],
    "please call (555) 123-4567": [("local", "(555) 123-4567")],
    "call about order 555 123-4567": [],
    "+1 (555) 123-4567 call": [],
    "born 01.02.1980": [("birth", "01.02.1980")],
    "released 01.02.1980": [],
    "born 41.02.1980": [],
}


def test_added_kinds_need_checksum_or_context(llm):
    rows = pii.find(llm.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")).collect()
    assert {r.row.text: [(s.kind, s.text) for k in pii.ADDED for s in r[k]] for r in rows} == ADDED


def test_scores(llm):
    row = pii.find(llm.createDataFrame([(1, "contact a@b.co" + " " * 60 + "invoice c@d.co")], "doc_id long, text string")).collect()[0]
    assert [s.score for s in row.email] == [1.0, 0.6]


def test_sql_gives_the_same_rows(llm, odd_rows, tmp_path):
    import duckdb

    from runwise.llm.queries import ORACLES
    rows = [(i, t) for i, t, _ in odd_rows] + [
        (30, "SSN 123-45-6789 tel 555-123-4567 born 1980-02-01 iban DE89 3704 0044 0532 0130 00 NOW, 4041894974608795, ip 10.0.0.255")]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.sql(ORACLES["op11_pii"]).fetchall()
    assert sorted(map(tuple, pii.report(docs).collect()), key=str) == sorted(want, key=str)
