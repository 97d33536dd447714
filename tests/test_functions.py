import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions import values as V


def one(spark, column, **inputs):
    names = list(inputs) or ["_"]
    schema = ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in (inputs or {"_": "x"}).items())
    return spark.createDataFrame([tuple((inputs or {"_": "x"}).values())], schema).select(column.alias("v")).first().v, names


def value(spark, column, **inputs):
    return one(spark, column, **inputs)[0]


@pytest.mark.parametrize(("raw", "want"), [
    ("Quillon, Inc. First Lien Term Loan 2028 [Member]", "quillon"),
    ("Smith & Sons Holdings LLC", "smith and sons"),
    ("ACME 3rd Tranche, 12.5% Notes due 2031", "acme"),
    ("", ""),
    (None, ""),
])
def test_normalize_borrower(spark, raw, want):
    assert value(spark, X.normalize_borrower(F.col("t")), t=raw) == want


def test_clean_member(spark):
    assert value(spark, X.clean_member(F.col("t")), t="  A   B [MEMBER] ") == "A B"
    assert value(spark, X.normalize_text(F.col("t")), t="A&B  (c)") == "a and b c"


@pytest.mark.parametrize(("t", "kind", "form", "lien", "rate", "funded"), [
    ("First Lien Term Loan, SOFR + 5%", "debt", "term_loan", "first_lien", "SOFR", "funded"),
    ("Second lien delayed draw term loan", "debt", "delayed_draw", "second_lien", "UNKNOWN", "unknown"),
    ("Revolving credit, unfunded commitment", "debt", "revolver", "unknown", "UNKNOWN", "unfunded"),
    ("Common units", "equity", "common_equity", "unknown", "UNKNOWN", "funded"),
    ("Preferred equity", "equity", "preferred_equity", "unknown", "UNKNOWN", "funded"),
    ("Subordinated note fixed", "debt", "note_or_bond", "subordinated", "FIXED", "funded"),
    ("Western unsecured notes", "unknown", "unknown", "unsecured", "ESTER", "funded"),
    ("Senior secured debt", "debt", "other_debt", "secured_unspecified", "UNKNOWN", "funded"),
    ("Warrants", "unknown", "warrant", "unknown", "UNKNOWN", "funded"),
])
def test_classifiers(spark, t, kind, form, lien, rate, funded):
    c = F.col("t")
    row = spark.createDataFrame([(t,)], "t string").select(X.debt_equity(c), X.facility_type(c), X.lien_category(c), X.reference_rate(c), X.funded_status(c)).first()
    assert tuple(row) == (kind, form, lien, rate, funded)


def test_canonical_members(spark):
    assert value(spark, X.canonical_currency(F.col("t")), t="iso4217#US Dollar") == "USD"
    assert value(spark, X.canonical_currency(F.col("t")), t="nok") == "NOK"
    assert value(spark, X.canonical_currency(F.col("t")), t="") is None
    assert value(spark, X.canonical_reference_rate(F.col("t")), t="us-gaap#Secured Overnight Financing Rate (SOFR) [Member]") == "SOFR"
    assert value(spark, X.canonical_reference_rate(F.col("t")), t="Estr") == "ESTR"
    assert value(spark, X.canonical_reference_rate(F.col("t")), t="other") is None
    assert value(spark, X.normalized_date(F.col("t")), t="20280115") == "2028-01-15"
    assert value(spark, X.normalized_date(F.col("t")), t="2028-10") == "2028-10"
    assert value(spark, X.normalized_date(F.col("t")), t="soon") is None


def test_tranche_text(spark):
    c = X.canonical_tranche_text(F.col("i"), F.col("b"), F.lit("7"))
    assert value(spark, c, i="Borrower LLC Loan B", b="borrower") == "loan b"
    assert value(spark, c, i="Borrower LLC", b="borrower") == "ROW:7"


def test_html(spark):
    raw = "<p>A&amp;B</p><script>var x='</p>'</script><style>p{}</style> c&nbsp;d"
    assert value(spark, X.normalize_html(F.col("t")), t=raw) == "A&B c d"
    assert value(spark, X.compact_text(F.col("t")), t="<b>Fair</b> Value: $1,234.5") == "fair value 1 234.5"


SUBMISSION = """<DOCUMENT><TYPE>8-K
<FILENAME>a.htm
<TEXT>cover</TEXT></DOCUMENT><DOCUMENT><TYPE>EX-99.1
<FILENAME>b.htm
<TEXT><p>Fund reports third quarter 2025 financial results. Net investment income of $0.51; net asset value per share 14.2 as of September 30, 2025</p></TEXT></DOCUMENT>"""


def test_exhibits(spark):
    df = spark.createDataFrame([(SUBMISSION, dt.date(2025, 9, 30), dt.date(2025, 6, 30))], "raw string, p date, q date")
    docs = X.submission_documents(F.col("raw"))
    row = df.select(docs.alias("d"), X.classify_documents(docs, F.col("p"), F.lit(True)).alias("ok"), X.classify_documents(docs, F.col("q"), F.lit(False)).alias("no"), X.classify_documents(docs).alias("any")).first()
    assert [d.type for d in row.d] == ["8-K", "EX-99.1"] and row.ok.accepted and row.ok.event_type == "8-K_ITEM_2.02_RESULTS" and row.ok.filename == "b.htm"
    assert not row.no.accepted and "2025-06-30" in row.no.reason
    assert row["any"].event_type == "8-K_EX-99_RESULTS"


@pytest.mark.parametrize(("t", "accepted", "reason"), [
    ("Fund schedules earnings release for May 5", False, "scheduling announcement; future results date only"),
    ("Fund declares quarterly dividend of $0.40", False, "dividend/distribution announcement without results or NAV"),
    ("Net investment income 1.2, net asset value 14.1", True, None),
    ("Net investment income and net asset value", False, "Item 2.02 exhibit lacks verified quarterly results/NAV metrics"),
    (None, False, "Item 2.02 exhibit lacks verified quarterly results/NAV metrics"),
])
def test_classify_exhibit(spark, t, accepted, reason):
    got = value(spark, X.classify_exhibit(F.col("t")), t=t)
    assert (got.accepted, got.reason) == (accepted, reason)


def test_segments(spark):
    s = "InvestmentIdentifierAxis=Foo Loan [Member]();CurrencyAxis=EUR();broken"
    assert value(spark, X.investment_member(F.col("s")), s=s) == "Foo Loan"
    assert value(spark, X.currency_members(F.col("s")), s=s) == ["EUR"]
    assert value(spark, X.investment_member(F.col("s")), s="InvestmentIssuerNameAxis=Bar()") == "Bar"
    assert value(spark, X.investment_member(F.col("s")), s=None) is None
    tags = lambda t, label, d: value(spark, X.semantic_field(F.col("t"), F.col("l"), F.col("d")), t=t, l=label, d=d)
    assert tags("InvestmentMaturityDate", "", "") == "maturity"
    assert tags("AcquisitionDate", None, None) == "acquisition_date"
    assert tags("X", "Investment, reference rate", None) == "reference_rate"
    assert tags("X", "rate", None) is None


def test_marks_in_text(spark):
    text = "schedule of investments auctane holdings first lien term loan fair value 1234.5 end"
    c = X.facility_mark_in_text(F.col("t"), F.lit("auctane"), F.lit(1_234_500.0), F.lit("first_lien"), F.lit("term_loan"))
    assert value(spark, c, t=text) is True
    assert value(spark, c, t=text.replace("1234.5", "91234.5")) is False
    assert value(spark, c, t=text.replace("schedule", "list")) is False
    assert set(value(spark, X.number_tokens(F.col("v")), v=1234500.0)) >= {"1234500", "1234.5", "1.23"}


def test_sequence_ratio(spark):
    import difflib

    pairs = [("abcd", "bcde"), ("", ""), ("loom", "room"), (None, "x")]
    got = [r.v for r in spark.createDataFrame(pairs, "a string, b string").select(X.sequence_ratio("a", "b").alias("v")).collect()]
    assert got == [difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


@pytest.mark.parametrize(("t", "want"), [("1,234.5", 1234.5), ("5d", None), ("1_000", 1000.0), ("", None), (None, None), ("-2e3", -2000.0), ("nan", None)])
def test_number(spark, t, want):
    assert value(spark, V.number(F.col("t")), t=t) == want


def test_rounding_and_text(spark):
    assert value(spark, V.spread_bucket(F.col("x")), x=0.00625) == pytest.approx(0.005)  # half to even
    assert value(spark, V.fixed(F.col("x")), x=0.05) == "0.05"
    assert value(spark, V.fixed(F.col("x")), x=100.0) == "100"
    assert value(spark, V.fixed(F.lit(None).cast("double"))) is None


def test_dates(spark):
    assert value(spark, V.iso_date(F.col("t")), t="2028-10-15T00:00") == dt.date(2028, 10, 15)
    assert value(spark, V.iso_date(F.col("t")), t="20281015") == dt.date(2028, 10, 15)
    assert value(spark, V.iso_date(F.col("t")), t="2028-10") is None
    assert value(spark, V.iso_date(F.col("t")), t="2028-13-40") is None
    day = F.to_date(F.col("t"))
    assert value(spark, V.previous_quarter_end(day), t="2025-03-31") == dt.date(2024, 12, 31)
    assert value(spark, V.previous_quarter_end(day), t="2025-04-30") is None
    assert value(spark, V.completed_quarter_end(F.col("t").cast("timestamp")), t="2025-08-06T10:20:27Z") == dt.date(2025, 6, 30)
    assert value(spark, V.completed_quarter_end(F.col("t").cast("timestamp")), t="2026-02-04T21:01:08Z") == dt.date(2025, 12, 31)
    assert value(spark, V.quarter_label(day), t="2025-08-01") == "2025Q3"
    chunks = value(spark, V.month_chunks(F.to_date(F.lit("2024-09-01")), F.to_date(F.lit("2026-05-15"))))
    assert (str(chunks[0][0]), str(chunks[0][1]), str(chunks[-1][0]), str(chunks[-1][1]), len(chunks)) == ("2024-09-01", "2024-09-30", "2026-05-01", "2026-05-15", 21)


def test_clocks(spark):
    assert value(spark, V.eastern_text(F.col("t").cast("timestamp")), t="2025-08-04T20:02:24Z") == "2025-08-04T16:02:24-04:00"
    sessions = [value(spark, V.market_session(F.col("t").cast("timestamp")), t=t) for t in ("2025-08-04T13:29:00Z", "2025-08-04T13:30:00Z", "2025-08-04T20:00:00Z", None)]
    assert sessions == ["pre-market", "market-hours", "after-market", None]
    assert [value(spark, V.clock(F.col("t")), t=t) for t in ("15:00", "153045", "9", None)] == ["15:00:00", "15:30:45", "00:00:00", "00:00:00"]
    assert [value(spark, V.window_bucket(F.col("x")), x=x) for x in (24.0, 24.5, 72.0, 73.0)] == ["<=1d", "1-3d", "1-3d", ">3d"]


def test_changes(spark):
    assert value(spark, V.pct_change(F.lit(100.0), F.lit(90.0))) == pytest.approx(-0.1)
    assert value(spark, V.pct_change(F.lit(0.0), F.lit(90.0))) is None
    way = lambda *d: value(spark, V.direction(F.array(*[F.lit(x).cast("double") for x in d])))
    assert [way(-10, -15, -12, -5), way(1, 0), way(1, -1), way(0), way(None)] == ["downward", "upward", "mixed_or_unchanged", "mixed_or_unchanged", "mixed_or_unchanged"]


def test_ids(spark):
    import hashlib

    want = hashlib.sha256("\x1f".join(["a", "", "3"]).encode()).hexdigest()[:24]
    assert value(spark, V.stable_id(F.lit("a"), F.lit(None).cast("string"), F.lit(3))) == want
    assert value(spark, V.canonical_json(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == '{"a":"1","b":"2"}'
    assert [value(spark, V.present(F.col("t")), t=t) for t in ("x", " N/A ", "", None)] == [True, False, False, False]


def test_references_are_decoded_before_an_exhibit_is_judged(spark):
    raw = "<DOCUMENT><TYPE>EX-99.1\n<FILENAME>r.htm\n<TEXT><p>net&nbsp;investment&nbsp;income</p> net asset&#160;value, earnings per&nbsp;share of $1.20 &lt;unaudited&gt; R&amp;D</TEXT></DOCUMENT><DOCUMENT><TYPE>EX-10<TEXT>x &amp; y</TEXT></DOCUMENT>"
    row = spark.createDataFrame([(raw,), (None,), ("no documents",)], "raw string").select(X.submission_documents(F.col("raw")).alias("d")).withColumn("c", X.classify_documents(F.col("d"))).collect()
    assert [d.text for d in row[0].d] == ["net investment income net asset value, earnings per share of $1.20 <unaudited> R&D", "x & y"]
    assert (row[0].c.accepted, row[0].c.event_type, row[0].c.filename) == (True, "8-K_EX-99_NAV", "r.htm")
    assert row[1].d is None and row[2].d == [] and row[2].c.reason == "8-K has no EX-99 exhibit"
