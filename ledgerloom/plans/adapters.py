"""The star-schema tables seen as holdings: funds are supplier nations, borrowers brands, quarters those of orders.

Every view is said twice, as a DataFrame and as the SQL that the checks run beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import values as V

LISTED = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility rows; every eleventh order is an unspecified issuer total, every seventh has no principal."""
    li, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    fund = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    rows = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(fund, F.col("l_suppkey") == F.col("s_suppkey"))
    total = F.col("l_orderkey") % 11 == 0
    period = V.quarter_end(F.to_date("o_orderdate"))
    results = F.date_add(F.col("period_end"), (14 + (F.col("s_nationkey") * 7) % 40).cast("int"))
    unless = lambda c, other=None: F.when(total, F.lit(other)).otherwise(c)
    rows = rows.withColumn("period_end", period)
    return rows.select(
        V.stable_id(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity").cast("long")).alias("facility_row_id"),
        F.concat_ws("-", "n_name", F.col("period_end").cast("string")).alias("adsh"), F.col("n_name").alias("ticker"), F.col("s_nationkey").cast("long").alias("cik"),
        "period_end", F.when(F.col("l_linenumber") <= 6, F.col("period_end")).otherwise(V.previous_quarter_end(F.col("period_end"))).alias("observation_date"), (F.col("l_linenumber") <= 6).alias("is_current_period"),
        F.date_add(results, F.col("l_linenumber") % 3).cast("timestamp").alias("accepted"), results.cast("timestamp").alias("results_ts"),
        F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" "))).alias("borrower_norm"), F.concat(F.col("p_brand"), F.lit(" Tranche "), (F.col("p_size") % 3).cast("string")).alias("investment_identifier"),
        unless(F.when(F.col("l_linestatus") == "O", "debt").otherwise("equity"), "debt").alias("debt_equity"), unless(F.lower("p_type"), "unknown").alias("facility_type"),
        unless(F.concat(F.lit("lien_"), F.lower("l_returnflag")), "unknown").alias("lien"), F.lit("USD").alias("currency"),
        unless(F.when(~F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"), F.col("o_orderpriority")).otherwise("UNKNOWN"), "UNKNOWN").alias("reference_rate"),
        unless(F.col("l_discount")).alias("spread"), (F.col("l_discount") + F.col("l_tax")).alias("total_interest_rate"), F.col("l_tax").alias("pik_rate"),
        unless(F.to_date(F.date_trunc("year", "l_shipdate"))).alias("maturity"), F.lit("unknown").alias("funded_status"), F.to_date("o_orderdate").alias("acquisition_date"),
        F.when((F.col("l_orderkey") % 7 != 0) & ~total, F.col("l_quantity") * F.col("p_retailprice")).alias("principal"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"), F.col("l_extendedprice").alias("fair_value"),
        (F.col("l_returnflag") == "R").alias("non_accrual"), (F.col("l_tax") > 0.07).alias("restructuring_flag"), F.col("l_partkey").alias("part"),
    )


FACILITIES = """
fac AS (
 SELECT substr(sha256(concat_ws(chr(31), CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))), 1, 24) AS facility_row_id,
  n_name || '-' || CAST(period_end AS VARCHAR) AS adsh, n_name AS ticker, CAST(s_nationkey AS BIGINT) AS cik, period_end,
  CASE WHEN l_linenumber <= 6 THEN period_end ELSE last_day(period_end - INTERVAL 3 MONTH) END AS observation_date, l_linenumber <= 6 AS is_current_period,
  CAST(period_end AS TIMESTAMP) + (14 + (s_nationkey * 7) % 40 + l_linenumber % 3) * INTERVAL 1 DAY AS accepted, CAST(period_end AS TIMESTAMP) + (14 + (s_nationkey * 7) % 40) * INTERVAL 1 DAY AS results_ts,
  lower(replace(p_brand, '#', ' ')) AS borrower_norm, p_brand || ' Tranche ' || CAST(p_size % 3 AS VARCHAR) AS investment_identifier,
  CASE WHEN total OR l_linestatus = 'O' THEN 'debt' ELSE 'equity' END AS debt_equity, CASE WHEN total THEN 'unknown' ELSE lower(p_type) END AS facility_type,
  CASE WHEN total THEN 'unknown' ELSE 'lien_' || lower(l_returnflag) END AS lien, 'USD' AS currency,
  CASE WHEN total OR o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'UNKNOWN' ELSE o_orderpriority END AS reference_rate,
  CASE WHEN total THEN NULL ELSE l_discount END AS spread, l_discount + l_tax AS total_interest_rate, l_tax AS pik_rate,
  CASE WHEN total THEN NULL ELSE CAST(date_trunc('year', l_shipdate) AS DATE) END AS maturity, 'unknown' AS funded_status, CAST(o_orderdate AS DATE) AS acquisition_date,
  CASE WHEN total OR l_orderkey % 7 = 0 THEN NULL ELSE l_quantity * p_retailprice END AS principal, l_extendedprice * (1 - l_discount) AS cost, l_extendedprice AS fair_value,
  l_returnflag = 'R' AS non_accrual, l_tax > 0.07::DOUBLE AS restructuring_flag, l_partkey AS part
 FROM (SELECT *, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS period_end, l_orderkey % 11 = 0 AS total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) t)
"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specified facility rows, each an economic facility without a maturity."""
    rows = facilities(spark, sf_dir).filter(F.col("facility_type") != "unknown")
    return rows.withColumns({"economic_facility_id": F.col("facility_row_id"), "maturity": F.lit(None).cast("date")})


POSITIONS = FACILITIES + ", pos AS (SELECT * REPLACE (NULL::DATE AS maturity), facility_row_id AS economic_facility_id FROM fac WHERE facility_type <> 'unknown')\n"


def calendar(positions: DataFrame) -> DataFrame:
    """A row for each fund and quarter held; every thirteenth has no verified results."""
    cells = positions.select("ticker", "cik", "period_end", "results_ts").distinct()
    missing = (F.col("cik") + F.quarter("period_end") + F.year("period_end")) % 13 == 0
    return cells.select("ticker", "cik", "period_end", F.when(~missing, F.col("results_ts")).alias("acceptance_timestamp_utc"), F.when(missing, "explicit_missing").when(F.col("cik") % 3 == 0, "verified_periodic_filing_fallback").otherwise("verified_exhibit_content").alias("verification_status"))


CALENDAR = """, cal AS (
 SELECT DISTINCT ticker, cik, period_end, CASE WHEN missing THEN NULL ELSE results_ts END AS acceptance_timestamp_utc,
  CASE WHEN missing THEN 'explicit_missing' WHEN cik % 3 = 0 THEN 'verified_periodic_filing_fallback' ELSE 'verified_exhibit_content' END AS verification_status
 FROM (SELECT *, (cik + quarter(period_end) + year(period_end)) % 13 = 0 AS missing FROM pos) t),
res AS (SELECT ticker, period_end, max(acceptance_timestamp_utc) AS results_ts FROM cal WHERE acceptance_timestamp_utc IS NOT NULL GROUP BY ALL)
"""


def listed(calendar: DataFrame) -> DataFrame:
    return calendar.filter(F.col("cik") < LISTED).select("ticker").distinct()


def strict_sql(l: str, r: str) -> str:  # noqa: E741
    """The strict predicate over two aliases."""
    known = lambda x: f"CASE WHEN {x} IN ('', 'unknown', 'UNKNOWN') THEN NULL ELSE {x} END"
    tests = [f"(({known(f'{l}.{c}')}) = ({known(f'{r}.{c}')}))" for c in ("debt_equity", "facility_type", "lien", "currency", "reference_rate", "funded_status")]
    tests += [f"(abs({l}.spread - {r}.spread) <= 0.0025::DOUBLE)", f"(abs(date_diff('day', {l}.maturity, {r}.maturity)) <= 45)"]
    return " AND ".join(f"coalesce({t}, true)" for t in tests) + " AND " + " + ".join(f"({t} IS NOT NULL)::INT" for t in tests) + " >= 3"


PRIOR = f""", cur AS (SELECT *, last_day(period_end - INTERVAL 3 MONTH) AS prior_end FROM pos WHERE is_current_period),
met AS (SELECT s.economic_facility_id AS s_id, p.economic_facility_id AS p_id, s.ticker AS s_ticker, p.ticker AS p_ticker, s.period_end AS period_end, s.borrower_norm AS borrower_norm,
  s.cik AS s_cik, p.cik AS p_cik, s.accepted AS s_accepted, p.accepted AS p_accepted, p.period_end AS p_period_end, s.fair_value / nullif(s.principal, 0) AS s_mark, p.fair_value / nullif(p.principal, 0) AS p_mark,
  count(*) OVER (PARTITION BY s.economic_facility_id, p.ticker) AS match_count
 FROM cur s JOIN cur p ON s.prior_end = p.period_end AND s.borrower_norm = p.borrower_norm WHERE {strict_sql("s", "p")})
"""

ELIGIBLE = f""", pub AS (SELECT m.*, greatest(rs.results_ts, s_accepted) AS s_public, greatest(rp.results_ts, p_accepted) AS p_public, rs.results_ts AS s_results
  FROM met m LEFT JOIN res rs ON rs.ticker = s_ticker AND rs.period_end = m.period_end LEFT JOIN res rp ON rp.ticker = p_ticker AND rp.period_end = p_period_end WHERE match_count = 1),
elig AS (SELECT 'SN3X_' || substr(sha256(concat_ws(chr(31), CAST(o.period_end AS VARCHAR), o.s_id, o.p_id, t.p_id, t.p_ticker)), 1, 28) AS observation_id, o.period_end, o.borrower_norm,
  o.s_ticker AS source_ticker, t.p_ticker AS target_ticker, o.s_cik AS source_cik, o.s_id AS source_facility_id, o.p_id AS source_prior_facility_id, t.p_id AS target_prior_facility_id, o.s_public AS source_information_ts,
  r.results_ts AS target_cutoff_ts, date_diff('microsecond', o.s_public, r.results_ts) / 86400000000.0::DOUBLE AS window_days, o.s_mark AS source_mark, o.p_mark AS source_prior_mark, o.s_mark - o.p_mark AS source_delta,
  coalesce(abs(o.s_mark - o.p_mark) >= 0.005::DOUBLE, false) AS movement_eligible
 FROM pub o JOIN pub t ON o.s_id = t.s_id AND o.s_ticker = o.p_ticker AND t.s_ticker <> t.p_ticker AND t.p_cik < {LISTED}
 JOIN res r ON r.ticker = t.p_ticker AND r.period_end = o.period_end
 WHERE o.s_results IS NOT NULL AND o.p_public < o.s_public AND t.p_public < t.s_public AND o.s_public < r.results_ts)
"""
