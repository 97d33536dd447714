"""Text normalisation and classification as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of a Python regular expression that Java's \\s leaves out as well.
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"

# Words that describe a facility rather than its borrower, and legal forms.
FACILITY_WORDS = (
    "first|second|third|senior|junior|lien|secured|unsecured|subordinated|unitranche|term|loan|revolver|revolving|facility|delayed|draw|ddtl|"
    "notes?|bonds?|debt|preferred|common|equity|warrants?|class|series|tranche|sofr|libor|euribor|prime|pik|cash|funded|unfunded|due|maturity"
)
LEGAL_SUFFIXES = "incorporated|inc|llc|ltd|limited|lp|l p|corp|corporation|company|co|holdings?|group|plc"
#: Legal forms that a tranche text leaves out.
TRANCHE_SUFFIXES = ["llc", "inc", "corp", "corporation", "company", "co", "lp", "ltd"]
EQUITY_WORDS = r"\b(common|preferred|equity|unit|warrant|partnership interest)\b"
DEBT_WORDS = r"\b(loan|debt|note|bond|revolver|revolving|lien|secured|unitranche)\b"
#: Rates in the order in which they are looked for, as parts of the text.
RATES = ("sofr", "libor", "euribor", "prime", "sonia", "ester")
# Tokens of a name that say little about the borrower.
GENERIC_TOKENS = [
    "and", "the", "parent", "intermediate", "holdco", "topco", "bidco", "buyer", "purchaser", "borrower", "acquisition", "investment", "investors",
    "partners", "management", "services", "solutions", "company", "group", "stock", "units", "class", "series", "member", "corporation", "corp",
]


def squeeze(value: Column) -> Column:
    return F.btrim(F.regexp_replace(value, f"{SPACE}+", " "), F.lit(" "))


def clean_member(value: Column) -> Column:
    """Without a trailing [Member], and with single spaces."""
    return squeeze(F.regexp_replace(F.coalesce(value, F.lit("")), rf"(?i){SPACE}*\[Member\]{SPACE}*$", ""))


def normalize_text(value: Column) -> Column:
    text = F.replace(F.lower(clean_member(value)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def normalize_borrower(value: Column) -> Column:
    """A borrower's name without years, ordinals, facility words and legal forms."""
    text = normalize_text(value)
    for pattern in (r"\b20\d{2}\b", r"\b\d+(?:st|nd|rd|th)?\b", rf"\b({FACILITY_WORDS})\b", rf"\b({LEGAL_SUFFIXES})\b"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, " +", " "))


def joined(*values: Column) -> Column:
    """The normalised values that are there, joined by spaces."""
    return F.array_join(F.array(*[F.when(v != "", normalize_text(v)) for v in values]), " ")


def debt_equity(*values: Column) -> Column:
    text = joined(*values)
    return F.when(text.rlike(EQUITY_WORDS), "equity").when(text.rlike(DEBT_WORDS), "debt").otherwise("unknown")


# The kinds, liens and funding of a facility, and words or patterns (between slashes) that tell each, in the order of the tests.
KINDS = {
    "delayed_draw": ("delayed draw", "ddtl"),
    "revolver": ("revolver", "revolving"),
    "term_loan": ("term loan", "unitranche"),
    "note_or_bond": (r"/\b(note|bond)\b/",),
    "preferred_equity": ("preferred",),
    "common_equity": (r"/\b(common|equity|unit|partnership interest)\b/",),
    "warrant": ("warrant",),
}
LIENS = {
    "first_lien": (r"/\b(first|1st) lien\b/",),
    "second_lien": (r"/\b(second|2nd) lien\b/",),
    "subordinated": ("subordinated", "junior"),
    "unsecured": ("unsecured",),
    "secured_unspecified": ("secured",),
}
FUNDING = {"unfunded": ("unfunded", "commitment"), "unknown": ("delayed draw",)}
RESTRUCTURED = "restructur|amend|default"


def _told_by(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The first name of a table that one of its words tells; null for none."""
    out = F.when(F.lit(False), "")
    for name, words in table.items():
        test = F.lit(False)
        for w in words:
            test = test | (text.rlike(w.strip("/")) if w.startswith("/") else text.contains(w))
        out = out.when(test, name)
    return out


def facility_type(*values: Column) -> Column:
    text = joined(*values)
    return F.coalesce(_told_by(text, KINDS), F.when(~text.rlike(EQUITY_WORDS) & text.rlike(DEBT_WORDS), "other_debt"), F.lit("unknown"))


def lien_category(*values: Column) -> Column:
    return F.coalesce(_told_by(joined(*values), LIENS), F.lit("unknown"))


def reference_rate(*values: Column) -> Column:
    text = joined(*values)
    out = F.when(F.lit(False), "")
    for rate in RATES:
        out = out.when(text.contains(rate), rate.upper())
    return out.when(text.contains("fixed"), "FIXED").otherwise("UNKNOWN")


def funded_status(*values: Column) -> Column:
    return F.coalesce(_told_by(joined(*values), FUNDING), F.lit("funded"))


def non_accrual(tag: Column, text: Column) -> Column:
    return F.coalesce(F.lower(tag).isin("1", "true", "yes"), F.lit(False)) | F.coalesce(F.lower(text).contains("nonaccrual"), F.lit(False))


def restructuring(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(RESTRUCTURED), F.lit(False))


# What tells the families of an official reference-rate member, in the order of the tests.
RATE_FAMILIES = {
    "SOFR": ("secured overnight financing rate", "sofr"),
    "LIBOR": ("london interbank offered rate", "libor"),
    "EURIBOR": ("euro interbank offered rate", "euribor"),
    "SONIA": ("sterling overnight index average", "sonia"),
    "ESTR": ("euro short term rate", "ester", "estr"),
    "CORRA": ("canadian overnight repo rate average", "corra"),
    "CDOR": ("canadian dollar offered rate", "cdor"),
    "BSBY": ("bloomberg short term bank yield", "bsby"),
    "PRIME": ("prime rate", "prime"),
    "BASE_RATE": ("base rate", "alternate base rate", "abr"),
    "FIXED": ("fixed rate", "fixed"),
}
# Names of currencies and their codes.
CURRENCIES = {"US Dollar": "USD", "United States Dollar": "USD", "Euro": "EUR", "British Pound": "GBP", "Canadian Dollar": "CAD", "Australian Dollar": "AUD"}


def local_name(value: Column) -> Column:
    """A member's name behind its namespace."""
    return F.element_at(F.split(clean_member(value), "#"), -1)


def canonical_reference_rate(value: Column) -> Column:
    """The family of an official member; null for none."""
    text = F.trim(F.regexp_replace(F.lower(local_name(value)), "[^a-z0-9]+", " "))
    out = F.when(F.lit(False), "")
    for family, names in RATE_FAMILIES.items():
        out = out.when(F.exists(F.array(*map(F.lit, names)), lambda n: text.contains(n)), family)
    return out


def canonical_currency(value: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    return F.nullif(F.coalesce(F.try_element_at(table, local_name(value)), F.upper(local_name(value))), F.lit(""))


def normalized_date(value: Column) -> Column:
    """YYYY-MM-DD or YYYY-MM, from either or from eight digits, as text."""
    text = F.trim(value)
    text = F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(text)
    return F.when(text.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), text)


def normalize_field(field: str, value: Column) -> Column:
    return {"currency": canonical_currency, "reference_rate": canonical_reference_rate, "maturity": normalized_date, "acquisition_date": normalized_date}[field](value)


def canonical_tranche_text(identifier: Column, borrower: Column, row_id: Column) -> Column:
    """The identifier's words without the borrower's and legal forms; nothing left means a row of its own."""
    own = F.filter(F.split(normalize_text(identifier), " "), lambda t: (t != "") & ~F.array_contains(F.split(normalize_text(borrower), " "), t) & ~t.isin(TRANCHE_SUFFIXES))
    return F.coalesce(F.nullif(F.array_join(own, " "), F.lit("")), F.concat(F.lit("ROW:"), row_id))


def _unescape(text: str | None) -> str | None:
    return html.unescape(text) if text and "&" in text else text


@F.pandas_udf(T.StringType())
def unescape(values: pd.Series) -> pd.Series:
    """HTML character references, of which there are too many for an expression."""
    return values.map(_unescape)


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescape_each(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else [_unescape(t) for t in x])


def strip_tags(value: Column) -> Column:
    """HTML without scripts, styles and tags, its white space collapsed; references stay."""
    return squeeze(F.regexp_replace(F.regexp_replace(value, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " "))


def normalize_html(value: Column) -> Column:
    return squeeze(unescape(strip_tags(value)))


def compact_text(value: Column) -> Column:
    """Words of letters, digits and points in lower case."""
    return F.trim(F.regexp_replace(F.lower(normalize_html(value)), "[^a-z0-9.]+", " "))


def submission_documents(raw: Column) -> Column:
    """The documents of a submission file as an array of type, filename, description and text (of HTML,
    its character references decoded)."""
    blocks = F.regexp_extract_all(raw, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))

    def tag(block: Column, name: str) -> Column:
        return F.trim(F.regexp_extract(block, rf"(?i)<{name}>([^\r\n<]+)", 1))

    body = lambda b: F.when(b.rlike("(?is)<TEXT>"), F.regexp_extract(b, r"(?is)<TEXT>(.*)", 1)).otherwise(b)
    plain = unescape_each(F.transform(blocks, lambda b: strip_tags(body(b))))
    return F.zip_with(blocks, plain, lambda b, t: F.struct(tag(b, "TYPE").alias("type"), tag(b, "FILENAME").alias("filename"), tag(b, "DESCRIPTION").alias("description"), squeeze(t).alias("text")))


# Wording of announcements, payouts, figures and releases, for lower-cased text.
SCHEDULING = (r"schedules? (?:earnings )?release", r"schedules? release of .*results", r"will (?:release|report|announce) (?:its )?financial results", r"plans? to (?:release|report|announce) (?:its )?financial results")
DIVIDEND = (r"declares? (?:a )?(?:quarterly )?(?:cash )?(?:dividend|distribution)", r"dividend declaration")
# (a fifth pattern, with capitals, cannot match lower-cased text)
ACTUAL = (r"net investment income", r"net asset value(?: per share)?", r"earnings per share", r"financial highlights")
RELEASE = (r"(?:announces?|reports?|reported) .*financial results", r"financial results for the .*quarter ended", r"preliminary .*net asset value", r"estimated .*net asset value")
FIGURES = r"\$\s?\d|\b\d+\.\d+\b"
NO_RESULTS = {
    "scheduling": "scheduling announcement; future results date only",
    "dividend": "dividend/distribution announcement without results or NAV",
    "other": "Item 2.02 exhibit lacks verified quarterly results/NAV metrics",
}
RESULTS, NAV, ITEM_202 = "8-K_EX-99_RESULTS", "8-K_EX-99_NAV", "8-K_ITEM_2.02_RESULTS"


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def classify_exhibit(text: Column) -> Column:
    """accepted, event_type and reason of an exhibit's text.

    Announcements of a date and payouts are not results unless two measures are named; results need
    two measures and a figure."""
    low = F.lower(F.coalesce(text, F.lit("")))
    measures = sum(low.rlike(p).cast("int") for p in ACTUAL)
    make = lambda ok, kind, why: F.struct(F.lit(ok).alias("accepted"), kind.alias("event_type"), F.lit(why).alias("reason"))
    none = F.lit(None).cast("string")
    return (
        F.when(_any(low, SCHEDULING) & (measures < 2), make(False, none, NO_RESULTS["scheduling"]))
        .when(_any(low, DIVIDEND) & (measures < 2), make(False, none, NO_RESULTS["dividend"]))
        .when((measures >= 2) & low.rlike(FIGURES), make(True, F.when(_any(low, RELEASE), RESULTS).otherwise(NAV), None))
        .otherwise(make(False, none, NO_RESULTS["other"]))
    )


def classify_documents(documents: Column, period_end: Column | None = None, item_202: Column | None = None) -> Column:
    """filename, event_type, accepted and reason: the first accepted exhibit 99 (of the period, if one is
    given), or the distinct reasons against all of them."""
    exhibits = F.filter(documents, lambda d: F.upper(d["type"]).startswith("EX-99"))

    def judge(d: Column) -> Column:
        c = classify_exhibit(d["text"])
        fits = F.lit(True) if period_end is None else period_text_matches(d["text"], period_end)
        why = F.when(~c["accepted"], c["reason"]).when(~fits, F.concat(F.lit("no exact period evidence for "), period_end.cast("string") if period_end is not None else F.lit(""), F.lit(" in exhibit")))
        kind = c["event_type"] if item_202 is None else F.when(item_202, ITEM_202).otherwise(c["event_type"])
        return F.struct(d["filename"].alias("filename"), kind.alias("event_type"), (c["accepted"] & fits).alias("accepted"), why.alias("reason"))

    judged = F.transform(exhibits, judge)
    first = F.get(F.filter(judged, lambda e: e["accepted"]), 0)
    reasons = F.array_join(F.array_distinct(F.filter(F.transform(judged, lambda e: e["reason"]), lambda r: r.isNotNull())), "; ")
    why = F.when(F.size(exhibits) == 0, "8-K has no EX-99 exhibit").otherwise(reasons)
    return F.struct(first["filename"].alias("filename"), first["event_type"].alias("event_type"), first.isNotNull().alias("accepted"), F.when(first.isNull(), why).alias("reason"))


def period_text_matches(text: Column, period_end: Column) -> Column:
    """The text names the period: its end in one of three spellings, or its quarter and, near it, its year."""
    low, of = F.lower(text), lambda pattern: F.date_format(period_end, pattern)
    quarter, year = F.quarter(period_end), of("yyyy")
    worded = F.element_at(F.array(*map(F.lit, ("first", "second", "third", "fourth"))), quarter)
    patterns = [
        F.concat(F.lower(of("MMMM")), F.lit(r"\s+0?"), of("d"), F.lit(r",?\s+"), year),
        F.concat(of("MM"), F.lit("[/-]"), of("dd"), F.lit("[/-]"), year),
        F.concat(year, F.lit("[/-]"), of("MM"), F.lit("[/-]"), of("dd")),
        F.concat(F.lit(r"\bq"), quarter.cast("string"), F.lit(r"\b[^.]{0,60}\b"), year, F.lit(r"\b")),
        F.concat(F.lit(r"\b"), worded, F.lit(r" quarter\b[^.]{0,60}\b"), year, F.lit(r"\b")),
    ]
    out = F.lit(False)
    for p in patterns:
        out = out | F.regexp_like(low, p)
    return out


def number_tokens(value: Column) -> Column:
    """Spellings of a figure, in units, thousands and millions, with up to two decimals; two characters at least."""
    short = lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)
    parts = []
    for scale in (1, 1_000, 1_000_000):
        v = value / F.lit(float(scale))
        parts += [F.bround(v).cast("decimal(38,0)").cast("string"), short(F.format_string("%.1f", v)), short(F.format_string("%.2f", v))]
    return F.array_distinct(F.filter(F.array(*parts), lambda x: F.length(x) >= 2))


# Phrases that tell apart facilities of a borrower.
DISCRIMINATORS = {
    "first_lien": "first lien", "second_lien": "second lien", "subordinated": "subordinated", "unsecured": "unsecured",
    "revolver": "revolver", "delayed_draw": "delayed draw", "term_loan": "term loan", "note_or_bond": "note",
}


def discriminators(lien: Column, kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DISCRIMINATORS.items() for x in pair])
    return F.array_distinct(F.array_compact(F.array(F.try_element_at(table, lien), F.try_element_at(table, kind))))


#: Shortest name looked for in a text, and the characters before and behind it that a mark is looked for in.
LEAST_NAME, BEFORE, BEHIND = 5, 250, 900


def plain_name(borrower: Column) -> Column:
    """A name as a compact text writes it."""
    return F.trim(F.regexp_replace(F.lower(borrower), "[^a-z0-9]+", " "))


def mark_in_window(window: Column, fair_value: Column, lien: Column, kind: Column) -> Column:
    """A stretch of compact text has a word that tells the facility apart and its fair value as a whole number."""
    told = F.exists(discriminators(lien, kind), lambda d: window.contains(d))
    value = F.exists(number_tokens(fair_value), lambda v: F.regexp_like(window, F.concat(F.lit("(?<![0-9.])"), F.replace(v, F.lit("."), F.lit("\\.")), F.lit("(?![0-9.])"))))
    return F.coalesce(told & value, F.lit(False))


def facility_mark_in_text(plain: Column, borrower: Column, fair_value: Column, lien: Column, kind: Column) -> Column:
    """An exhibit's compact text shows the facility: a schedule, and near the borrower's name (where it comes
    first) the facility's mark."""
    name = plain_name(borrower)
    at = F.instr(plain, name)
    begin = F.greatest(F.lit(1), at - BEFORE)
    window = F.substring(plain, begin, at - begin + F.length(name) + BEHIND)
    return F.coalesce(plain.contains("schedule of investments") & (F.length(name) >= LEAST_NAME) & (at > 0) & mark_in_window(window, fair_value, lien, kind), F.lit(False))


def segment_members(segments: Column) -> Column:
    """axis=member;axis=member as an array of structs; axes in lower case."""
    own = F.transform(F.filter(F.split(segments, ";"), lambda x: x.contains("=")), lambda x: F.struct(F.lower(F.substring_index(F.substring_index(x, "=", 1), "(", 1)).alias("axis"), F.trim(F.regexp_replace(F.regexp_replace(x, "^[^=]*=", ""), r"\(\);?$", "")).alias("member")))
    return F.filter(own, lambda m: m["member"] != "")


def investment_member(segments: Column) -> Column:
    """The member of the identifier axis, or of an axis of names; never one that is only inferred."""
    members = segment_members(segments)
    has = lambda m, *axes: F.exists(F.array(*map(F.lit, axes)), lambda a: m["axis"].contains(a))
    best = F.get(F.filter(members, lambda m: has(m, "investmentidentifieraxis")), 0)["member"]
    rest = F.get(F.filter(members, lambda m: has(m, "investmentnameaxis", "investmentissuernameaxis", "portfoliocompanies")), 0)["member"]
    return F.nullif(clean_member(F.coalesce(best, rest)), F.lit(""))


def currency_members(segments: Column) -> Column:
    return F.transform(F.filter(segment_members(segments), lambda m: m["axis"].contains("currencyaxis")), lambda m: m["member"])


def semantic_field(tag: Column, label: Column, doc: Column) -> Column:
    """Which field a tag stands for, by its name, label and documentation."""
    name, title = F.lower(F.coalesce(tag, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    text = F.concat_ws(" ", title, F.lower(F.coalesce(doc, F.lit(""))))
    about = text.contains("investment")
    return (
        F.when(name.contains("investmentduedate") | name.contains("investmentmaturitydate") | (about & (text.contains("maturity date") | text.contains("due date"))), "maturity")
        .when(name.contains("initialacquisitiondate") | (name == "acquisitiondate") | (about & text.contains("acquisition date")), "acquisition_date")
        .when(name.contains("investmentreferencerate") | name.contains("referencerateandspread") | (title.contains("investment") & title.contains("reference rate")), "reference_rate")
    )


def tokens(value: Column) -> Column:
    """Distinct words of four letters or more that are not generic."""
    return F.filter(F.array_distinct(F.split(F.coalesce(value, F.lit("")), r"\s+")), lambda t: (F.length(t) >= 4) & ~t.isin(GENERIC_TOKENS))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays taken as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which no built-in function has."""
    import difflib

    return pd.Series([difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right, strict=True)])
