from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from reference_pii import base

from sparkloom.llm.pii import find_pii, pii_report, redact

SCHEMA = "doc_id long, text string"
TEXTS = [
    None, "", "no data here", "a@b.c_x@d.e and é𝄞 mail x.y+z@mail-1.example.co.uk.", "a@b", "@b.c", "a@@b.c", "..@-.-",
    "1.2.3.4 255.255.255.255 256.1.1.1 0001.02.3.4 1.2.3.4.5.6.7.8 1.2.3.", "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111110",
    "+1 (555) 123-4567 and +12 and +1..........2 +1234567890123456", "\x00a@b.c\x00\x01 +49 30 1234567", "9" * 5000, "1-" * 6000 + "1", "a." * 4000 + "@x.y", "+1" + "(" * 5000,
    "IBAN: DE89 3704 0044 0532 0130 00 and bank DE88370400440532013000", "ssn 123-45-6789 here", "code 123-45-6789 here", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
]


def check(spark, texts):
    rows = pii_report(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts, joined = base(texts[r["doc_id"]])
        assert tuple(r)[1:6] == counts, (texts[r["doc_id"]], tuple(r), joined)
        kept = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] not in ("iban", "ssn"))
        assert kept == joined


def test_base_spans_equal_the_plain_statement(spark):
    check(spark, TEXTS)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a.@-+ ()0123456789é𝄞\x00Z_", max_size=60), min_size=40, max_size=80))
def test_base_spans_on_random_texts(spark, texts):
    check(spark, texts)


def test_base_spans_on_the_table(spark, sf_dir):
    check(spark, [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()])


def test_added_kinds_need_checks_and_context(spark):
    found = {r["doc_id"]: r["pii"] for r in find_pii(spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)).collect()}
    assert [(s["kind"], s["start"]) for s in found[16] if s["kind"] == "iban"] == [("iban", 6)]
    assert any(s["kind"] == "ssn" for s in found[17]) and not any(s["kind"] == "ssn" for s in found[18])


def test_redaction_and_empty_table(spark):
    df = spark.createDataFrame([(1, "write to a@b.cd now"), (2, None), (3, "x 1.2.3.4")], SCHEMA)
    assert [r["redacted"] for r in redact(df).orderBy("doc_id").collect()] == ["write to [email] now", "", "x [ip]"]
    assert pii_report(df.limit(0)).count() == 0


IBANS = [
    "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "GB29 NWBK 6016 1331 9268 19",
    "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "FR14 2004 1010 0505 0001 3M02 606", "SE45 5000 0000 0583 9825 7466", "PL61 1090 1014 0000 0712 1981 2874", "CH93 0076 2011 6238 5295 7",
]


def test_ibans_are_found_whatever_follows_them(spark):
    texts, want = [], []
    for iban in [*IBANS, *(x.replace(" ", "") for x in IBANS)]:
        for before in ("", "IBAN ", "é𝄞 REF AB12 3456 7890 "):
            for after in ("", ",", " BIC", " BANK", " EUR 12", " 2024", " 1234 5678", " A", " AT61 1904 3002 3457 3202 X", "x"):
                texts.append(before + iban + after)
                want.append([] if after == "x" else [(len(before), len(before) + len(iban))])
    texts += [" ".join(IBANS), "BE68 5390 0754 7035 BIC", "AT61 1904 3002 3457 32 01", "XBE68539007547034", None]
    ends = [sum(len(x) + 1 for x in IBANS[: i + 1]) - 1 for i in range(len(IBANS))]
    want += [[(e - len(x), e) for x, e in zip(IBANS, ends)], [], [], [], []]
    found = find_pii(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert len(found) == len(texts)
    for r in found:
        assert [(s["start"], s["end"]) for s in r["pii"] if s["kind"] == "iban"] == want[r["doc_id"]], texts[r["doc_id"]]
