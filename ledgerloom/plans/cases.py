"""Queries of operators over logs, payloads, projections and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text as X
from ledgerloom.functions import values as V
from ledgerloom.operators import eligibility as E
from ledgerloom.operators import facilities as FA
from ledgerloom.operators import projections as P
from ledgerloom.operators import reporting as R
from ledgerloom.operators import revisions as RV
from ledgerloom.operators import sampling as S
from ledgerloom.plans import adapters as A
from ledgerloom.plans.registry import AGG, ELIGIBLE, LOTS, TOTALS, WITH, near, observations, query, text
from ledgerloom.shared import materialize, scratch_path
from ledgerloom.sources import readers, writers

# ---- logs and payloads

MOVES = {
    ("pending", "click"): "archived", ("pending", "error"): "archive_failed", ("archived", "error"): "archive_failed",
    ("archive_failed", "signup"): "pending", ("archived", "purchase"): "recovered", ("recovered", "error"): "archived",
}
_TO = " ".join(f"WHEN s.status = '{a}' AND l.event_type = '{o}' THEN '{to}'" for (a, o), to in MOVES.items())


@query(f"""WITH RECURSIVE l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS attempts FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'pending' AS status, CAST(0 AS BIGINT) AS changes FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT l.user_id, l.n, CASE {_TO} ELSE s.status END, s.changes + (CASE {_TO} ELSE s.status END <> s.status)::INT FROM s JOIN l ON l.user_id = s.user_id AND l.n = s.n + 1)
SELECT user_id, status, attempts, changes FROM s JOIN (SELECT DISTINCT user_id, attempts FROM l) USING (user_id) WHERE n = attempts""")
def attempt_log(spark, sf):
    """Every user's events as attempts, from pending on."""
    return RV.settle(A.table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", MOVES, "pending")


_PAYLOAD = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"FSales": ' || (user_id) || ', "FOP": "' || event_type || '", "FNP": null}' WHEN 2 THEN '{"FSales": "", "FNCSales": [1, 2], "FNCOP": ' || (event_id) || '}'
 WHEN 3 THEN 'no json' WHEN 4 THEN '{"FSales2Q": {"x": 1}, "FNCNP2Q": "' || event_type || '"}' END"""


@query(f"""WITH t AS (SELECT event_id, event_type, user_id, event_id % 6 AS k FROM events)
SELECT event_id, CASE WHEN k IN (1, 2) THEN 'FY' WHEN k = 4 THEN '2Q' END AS horizon, CASE WHEN k = 1 THEN 'consolidated' WHEN k IN (2, 4) THEN 'standalone' END AS basis, CASE WHEN k = 1 THEN CAST(user_id AS VARCHAR) END AS revenue,
 CASE k WHEN 1 THEN event_type WHEN 2 THEN CAST(event_id AS VARCHAR) END AS operating_profit, CASE WHEN k = 4 THEN event_type END AS net_income FROM t""")
def variant_payloads(spark, sf):
    """The props of all events and records of other shapes: missing and nested members, numbers, and no JSON at all."""
    rows = A.table(spark, sf, "events").select("event_id", RV.variant_payload(F.expr(_PAYLOAD)).alias("p"))
    return rows.select("event_id", "p.horizon", "p.basis", "p.revenue", "p.operating_profit", "p.net_income")


@query("""WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, list(CAST(event_id AS VARCHAR) ORDER BY event_id) AS ids, list(event_type ORDER BY event_id) AS kinds FROM events GROUP BY ALL)
SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(i - 1 AS INTEGER) AS place, ids[i] AS id, CASE WHEN user_id % 3 > 0 THEN kinds[i] END AS kind FROM (SELECT *, unnest(generate_series(1, len(ids))) AS i FROM t)""")
def columnar_json(spark, sf):
    """Events of a user and day as one JSON object of arrays, one of which every third user lacks, and back as rows."""
    rows = A.table(spark, sf, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    ids, kinds = F.col("x.event_id").cast("array<string>"), F.when(F.col("user_id") % 3 > 0, F.col("x.event_type"))
    told = rows.select("user_id", "day", F.to_json(F.struct(F.struct(ids.alias("id"), kinds.alias("kind")).alias("recent"))).alias("t"))
    return readers.variant_arrays(told, "t", "$.recent", ["id", "kind"])


# ---- titles and reports


_TITLE_SQL = "CASE event_id % 5 WHEN 0 THEN '業績予想の修正に関するお知らせ' WHEN 1 THEN '通期業績予想の修正及び配当予想' WHEN 2 THEN '業績予想の修正の撤回' WHEN 3 THEN '決算短信' ELSE '業績予想の修正' END"


@query(f"""SELECT event_id, event_id % 5 IN (0, 4) AS fit, CAST(ts AS DATE) >= DATE '2024-03-01' - 20 AS in_history FROM (SELECT *, {_TITLE_SQL} AS title FROM events)""")
def revision_titles(spark, sf):
    """Titles of revisions that are fit, and events that the free history still reaches."""
    rows = A.table(spark, sf, "events").withColumn("title", F.expr(_TITLE_SQL))
    return rows.select("event_id", RV.clean_event(F.col("title")).alias("fit"), RV.recent(F.to_date("ts"), F.lit("2024-03-01").cast("date"), 20).alias("in_history"))


_ITEMS = ("2.02,9.01", "7.01", "5.02")
_SAID = {
    0: "Company reports financial results. Period ended {}: net investment income $1.0, net asset value 14.2", 1: "Company reports financial results: net investment income $1.0, net asset value 14.2",
    2: "Company plans to report financial results soon", 3: "Company declares a quarterly dividend", 4: "An agreement",
}


@query(f"""WITH f AS (SELECT o_orderkey AS accession, o_orderkey % 5 AS k, CASE o_orderkey % 3 WHEN 0 THEN '{_ITEMS[0]}' WHEN 1 THEN '{_ITEMS[1]}' ELSE '{_ITEMS[2]}' END AS items, CAST(last_day(date_trunc('quarter', CAST(o_orderdate AS DATE)) - INTERVAL (CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 1 END) MONTH) AS DATE) AS period_end, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 2 = 1)
SELECT accession, CAST(period_end AS VARCHAR) AS period_end, CASE WHEN k = 0 THEN 'r.htm' END AS filename, CASE WHEN k = 0 THEN CASE WHEN contains(items, '2.02') THEN '{X.ITEM_202}' ELSE '{X.RESULTS}' END END AS event_type, k = 0 AS accepted_exhibit,
 CASE k WHEN 1 THEN 'no exact period evidence for ' || CAST(period_end AS VARCHAR) || ' in exhibit' WHEN 2 THEN '{X.NO_RESULTS["scheduling"]}' WHEN 3 THEN '{X.NO_RESULTS["dividend"]}' WHEN 4 THEN '8-K has no EX-99 exhibit' END AS reason
FROM f WHERE (contains(items, '2.02') OR contains(items, '7.01')) AND date_diff('day', period_end, day) BETWEEN 0 AND {R.MAX_LAG}""")
def results_filings(spark, sf):
    """Every other order as a current report, some of them too late or with other items: its exhibit is judged,
    and what was not accepted keeps its reason for the log of exclusions."""
    key = F.col("o_orderkey")
    months = F.when(key % 7 == 0, 4).otherwise(1)
    period = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), -months))
    said = F.when(F.lit(False), "")
    for k, told in _SAID.items():
        before, _, after = told.partition("{}")
        said = said.when(key % 5 == k, F.concat(F.lit(before), F.date_format(period, "MMMM d, yyyy"), F.lit(after)) if after else F.lit(before))
    raw = F.concat(F.lit("<DOCUMENT><TYPE>"), F.when(key % 5 == 4, "EX-10").otherwise("EX-99.1"), F.lit("\n<FILENAME>r.htm\n<TEXT>"), said, F.lit("</TEXT></DOCUMENT>"))
    items = F.when(key % 3 == 0, _ITEMS[0]).when(key % 3 == 1, _ITEMS[1]).otherwise(_ITEMS[2])
    filings = A.table(spark, sf, "orders").select(key.alias("accession"), F.when(key % 2 == 1, "8-K").otherwise("10-Q").alias("form"), F.to_timestamp("o_orderdate").alias("accepted"), period.alias("period_end"), items.alias("items"), raw.alias("raw"))
    return R.results_candidates(filings).select("accession", *text("period_end"), "filename", "event_type", "accepted_exhibit", "reason")


@query(ELIGIBLE + "SELECT CAST(year(period_end) AS VARCHAR) || 'Q' || CAST(quarter(period_end) AS VARCHAR) AS quarter, source_ticker, count(DISTINCT source_facility_id) AS moved_facilities FROM elig WHERE movement_eligible GROUP BY ALL")
def movement_tickers(spark, sf):
    return E.moved_by_ticker(observations(spark, sf))


@query(WITH + "SELECT CAST(year(accepted) AS VARCHAR) || 'Q' || CAST(quarter(accepted) AS VARCHAR) AS quarter, ticker, count(*) AS n_rows FROM fac GROUP BY ALL")
def acceptance_quarters(spark, sf):
    """Rows by the quarter in which their filing was accepted."""
    return A.facilities(spark, sf).groupBy(V.quarter_label(F.to_date("accepted")).alias("quarter"), "ticker").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- projections and samples

_TEMPLATE = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("status", T.StringType()), T.StructField("s_name", T.StringType()), T.StructField("rating", T.IntegerType())])


@query("SELECT s_suppkey, 'pending' AS status, s_name, s_nationkey % 3 AS nation_group FROM supplier")
def defaulted_rows(spark, sf):
    rows = A.table(spark, sf, "supplier").select("s_name", "s_suppkey", "s_nationkey")
    made = P.with_defaults(rows, _TEMPLATE, {"status": "pending"})
    return made.filter("rating is null").join(rows.select("s_suppkey", (F.col("s_nationkey") % 3).alias("nation_group")), "s_suppkey").drop("rating")


@query("SELECT s_suppkey, s_name, 'superseded' AS status, 'replaced by v2' AS status_reason, CAST(NULL AS VARCHAR) AS note FROM supplier")
def superseded_rows(spark, sf):
    """Rows of an older layout in the newer one, all of them marked as superseded."""
    template = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("note", T.StringType())])
    rows = A.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")
    return P.supersede(P.migrate(rows, template), "superseded", "replaced by v2")


@query("""WITH f AS (SELECT p_partkey FROM part WHERE p_size = 7), r AS (SELECT p_partkey, row_number() OVER (ORDER BY sha256('fixtures:' || p_partkey), p_partkey) AS n FROM part WHERE p_size <> 7)
SELECT p_partkey, true AS fixture FROM f UNION ALL SELECT p_partkey, false FROM r WHERE n <= (SELECT greatest(0, 2 * count(*) - count(*)) FROM f)""")
def sample_with_fixtures(spark, sf):
    """All parts of one size, and as many others by their draw."""
    part = A.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), (F.col("p_size") == 7).alias("fixture"))
    fixtures = part.filter("fixture")
    return S.with_fixtures(part, "p_partkey", fixtures, 2 * fixtures.count(), "fixtures").select(F.col("p_partkey").cast("long").alias("p_partkey"), "fixture")


@query(WITH + TOTALS + LOTS + AGG + "SELECT ticker, count(*) AS facilities, CAST(sum(source_row_count) AS BIGINT) AS source_rows FROM agg GROUP BY ticker")
def validated_facilities(spark, sf):
    """Facilities counted after their ids were found unique and their amounts finite."""
    out = FA.aggregate(A.facilities(spark, sf)).select("economic_facility_id", "ticker", "source_row_count", "principal", "cost", "fair_value")
    out = materialize(out, "facilities")
    FA.validate(out)
    return out.groupBy("ticker").agg(F.count(F.lit(1)).alias("facilities"), F.sum("source_row_count").alias("source_rows"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":"' || p_size || '"}') AS fingerprint FROM part""")
def row_fingerprints(spark, sf):
    """The hash of a row's filled fields as JSON with sorted keys."""
    fields = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return A.table(spark, sf, "part").select("p_partkey", F.sha2(V.canonical_json(fields), 256).alias("fingerprint"))


# ---- files


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'a \"b\", ' || c_mktsegment END AS note, CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS positive FROM customer")
def csv_round_trip(spark, sf):
    """Customers written as a delimited table (quotes, commas, blanks, a boolean) and read back as strings."""
    rows = A.table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit('a "b", '), "c_mktsegment")).alias("note"), (F.col("c_acctbal") > 0).alias("positive"))
    path = scratch_path(spark, "csv")
    writers.write_csv(rows, path, rows.columns, ["c_custkey"])
    return readers.read_table(spark, path, rows.columns)


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def guarded_round_trip(spark, sf):
    """Suppliers written under a guard that none of them fails, and read back."""
    path = scratch_path(spark, "guarded")
    writers.write_guarded(A.table(spark, sf, "supplier"), path, F.col("s_suppkey").isNull())
    return spark.read.parquet(path).select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), near("s_acctbal", 2))


@query("""WITH t AS (SELECT page_id % 9 AS period, page_id, CASE WHEN page_id % 2 = 0 THEN '業績予想の修正' ELSE '決算' END AS title, CASE WHEN page_id % 3 = 0 THEN NULL ELSE CAST(1000 + page_id % 9000 AS VARCHAR) || '0' END AS code FROM pages)
SELECT CAST(page_id AS VARCHAR) AS id, title, left(code, 4) AS security_code FROM t WHERE page_id % 2 = 0 AND code IS NOT NULL""")
def index_events(spark, sf):
    """Pages as the items of index pages, of which those with the title and a code stay."""
    page = F.col("page_id")
    item = F.struct(page.cast("string").alias("id"), F.when(page % 2 == 0, "業績予想の修正").otherwise("決算").alias("title"), F.when(page % 3 != 0, F.concat((1000 + page % 9000).cast("string"), F.lit("0"))).alias("company_code"))
    pages = A.table(spark, sf, "pages").groupBy((page % 9).alias("period")).agg(F.collect_list(item).alias("items"))
    return readers.event_items(pages, "業績予想の修正").select("id", "title", "security_code")


_LOOKED_FOR = ('Customer#000000001', 'Customer#000000002', 'Customer#000000003', 'Customer#000000004', 'Customer#000000005')


@query(f"SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS name FROM customer WHERE c_name IN {_LOOKED_FOR}")
def company_hits(spark, sf):
    """Customers as results of a company search, of which those with the names looked for stay."""
    html = A.table(spark, sf, "customer").select(F.concat(F.lit('<a href="?CIK='), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit('&x">'), "c_name", F.lit("</a>")).alias("html"))
    return readers.company_matches(html, [n.upper() for n in _LOOKED_FOR])



