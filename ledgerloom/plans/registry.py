"""Queries of the analytic operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions import values as V
from ledgerloom.operators import eligibility as E
from ledgerloom.operators import evaluation as EV
from ledgerloom.operators import facilities as FA
from ledgerloom.operators import guards as G
from ledgerloom.operators import lineage as L
from ledgerloom.operators import matching as M
from ledgerloom.operators import overlap as O
from ledgerloom.operators import reporting as R
from ledgerloom.operators import projections as P
from ledgerloom.operators import sampling as S
from ledgerloom.operators import variants as VA
from ledgerloom.plans import adapters as A
from ledgerloom.shared import materialize
from ledgerloom.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from ledgerloom.plans import cases, parsing  # add their own

    assert cases and parsing
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def text(*columns: str) -> list:
    return [F.col(c).cast("string").alias(c) for c in columns]


def near(c: str, digits: int = 6, name: str | None = None):
    return F.round(F.col(c), digits).alias(name or c)


def count(c: str, name: str | None = None):
    return F.col(c).cast("long").alias(name or c)


WITH = "WITH " + A.FACILITIES
POS = "WITH " + A.POSITIONS
PRIOR = POS + A.CALENDAR + A.PRIOR
ELIGIBLE = PRIOR + A.ELIGIBLE
TOTALS = """, tot AS (SELECT *, principal IS NULL AND coalesce(funded_status, '') <> 'unfunded' AND coalesce(debt_equity, '') <> 'equity' AND coalesce(facility_type, '') IN ('', 'unknown', 'other_debt')
  AND coalesce(lien, '') IN ('', 'unknown') AND coalesce(reference_rate, '') IN ('', 'UNKNOWN') AND spread IS NULL AND maturity IS NULL
  AND max(CASE WHEN principal IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY adsh, observation_date, borrower_norm) = 1 AS is_issuer_total FROM fac WHERE borrower_norm <> '')
"""
LOTS = """, tr AS (SELECT *, coalesce(nullif(array_to_string(list_filter(string_split(trim(regexp_replace(lower(investment_identifier), '[^a-z0-9]+', ' ', 'g')), ' '),
   lambda t: NOT list_contains(string_split(borrower_norm, ' '), t)), ' '), ''), 'ROW:' || facility_row_id) AS tranche FROM tot WHERE NOT is_issuer_total),
lot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY adsh, observation_date, borrower_norm, debt_equity, facility_type, lien, currency, reference_rate, spread, maturity, funded_status, tranche,
   investment_identifier, principal, cost, fair_value, acquisition_date ORDER BY facility_row_id) AS n FROM tr) t WHERE n = 1)
"""
WEIGHT = "coalesce(nullif(abs(principal), 0), nullif(abs(cost), 0), 1.0::DOUBLE)"


# ---- facilities


@query(WITH + TOTALS + "SELECT facility_row_id, ticker, borrower_norm, is_issuer_total FROM tot")
def issuer_total_drop(spark, sf):
    return FA.issuer_totals(A.facilities(spark, sf)).select("facility_row_id", "ticker", "borrower_norm", "is_issuer_total")


@query(WITH + TOTALS + LOTS + "SELECT facility_row_id, tranche, ticker FROM lot")
def lot_dedup(spark, sf):
    rows = FA.issuer_totals(A.facilities(spark, sf)).filter("not is_issuer_total")
    return FA.first_lots(FA.with_tranche(rows)).select("facility_row_id", "tranche", "ticker")


AGG = f""", agg AS (SELECT adsh, observation_date, borrower_norm, debt_equity, facility_type, lien, currency, reference_rate, spread, maturity, funded_status, tranche,
  min(ticker) AS ticker, min(period_end) AS period_end, sum(principal) AS principal, sum(cost) AS cost, sum(fair_value) AS fair_value,
  sum(pik_rate * {WEIGHT}) / sum(CASE WHEN pik_rate IS NOT NULL THEN {WEIGHT} END) AS mean_pik_rate, sum(spread * {WEIGHT}) / sum(CASE WHEN spread IS NOT NULL THEN {WEIGHT} END) AS mean_spread,
  max(accepted) AS accepted, min(acquisition_date) AS acquisition_date, bool_or(non_accrual) AS non_accrual, count(DISTINCT investment_identifier) AS lot_count, count(*) AS source_row_count
 FROM lot GROUP BY adsh, observation_date, borrower_norm, debt_equity, facility_type, lien, currency, reference_rate, spread, maturity, funded_status, tranche)
"""


@query(WITH + TOTALS + LOTS + AGG + """SELECT 'EF_' || substr(sha256(concat_ws(chr(31), adsh, CAST(observation_date AS VARCHAR), borrower_norm, debt_equity, facility_type, lien, currency, reference_rate,
   coalesce(regexp_replace(printf('%.12f', spread), '\\.?0+$', ''), 'UNKNOWN'), coalesce(CAST(maturity AS VARCHAR), 'UNKNOWN'), funded_status, tranche)), 1, 28) AS economic_facility_id, ticker,
  CAST(period_end AS VARCHAR) AS period_end, round(principal, 4) AS principal, round(cost, 4) AS cost, round(fair_value, 4) AS fair_value, round(mean_pik_rate, 8) AS mean_pik_rate,
  round(fair_value / nullif(principal, 0), 8) AS mark, CAST(acquisition_date AS VARCHAR) AS acquisition_date, non_accrual, CAST(lot_count AS BIGINT) AS lot_count, CAST(source_row_count AS BIGINT) AS source_row_count FROM agg""")
def facility_aggregate(spark, sf):
    out = FA.aggregate(A.facilities(spark, sf))
    return out.select("economic_facility_id", "ticker", *text("period_end"), near("principal", 4), near("cost", 4), near("fair_value", 4), near("mean_pik_rate", 8), near("mark_fv_to_principal", 8, "mark"), *text("acquisition_date"), "non_accrual", count("lot_count"), count("source_row_count"))


@query(WITH + f"SELECT borrower_norm, round(sum(spread * {WEIGHT}) / sum(CASE WHEN spread IS NOT NULL THEN {WEIGHT} END), 8) AS mean_spread, count(spread) AS n FROM fac GROUP BY borrower_norm")
def weighted_spread(spark, sf):
    return A.facilities(spark, sf).groupBy("borrower_norm").agg(F.round(FA.weighted_mean("spread"), 8).alias("mean_spread"), F.count("spread").alias("n"))


@query(WITH + "SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, round(sum(fair_value) / nullif(sum(principal), 0), 8) AS mark, count(*) AS n_rows FROM (SELECT DISTINCT ON (facility_row_id) * FROM fac) t GROUP BY ticker, period_end")
def mark(spark, sf):
    return FA.mark_of(A.facilities(spark, sf), ["ticker", "period_end"]).select("ticker", *text("period_end"), near("mark", 8), "n_rows")


@query(WITH + "SELECT facility_row_id, round(round_even(spread / 0.0025::DOUBLE, 0) * 0.0025::DOUBLE, 6) AS bucket, strftime(maturity, '%Y-%m') AS month, CAST(year(period_end) AS VARCHAR) || 'Q' || CAST(quarter(period_end) AS VARCHAR) AS quarter, CAST(last_day(period_end - INTERVAL 3 MONTH) AS VARCHAR) AS prior FROM fac")
def scalar_keys(spark, sf):
    rows = A.facilities(spark, sf)
    return rows.select("facility_row_id", F.round(V.spread_bucket(F.col("spread")), 6).alias("bucket"), V.maturity_month(F.col("maturity").cast("string")).alias("month"), V.quarter_label(F.col("period_end")).alias("quarter"), V.previous_quarter_end(F.col("period_end")).cast("string").alias("prior"))


# ---- pairs

PAIRS = POS + """, side AS (SELECT * FROM pos WHERE is_current_period),
pair AS (SELECT l.*, r.facility_row_id AS r_id, r.ticker AS r_ticker, r.debt_equity AS r_debt_equity, r.facility_type AS r_facility_type, r.lien AS r_lien, r.reference_rate AS r_rate, r.spread AS r_spread
 FROM side l JOIN side r ON l.period_end = r.period_end AND l.part = r.part AND l.facility_row_id < r.facility_row_id AND l.cik <> r.cik),
cmp AS (SELECT *, debt_equity = r_debt_equity AS de, facility_type = r_facility_type AS ft, lien = r_lien AS li, nullif(reference_rate, 'UNKNOWN') = nullif(r_rate, 'UNKNOWN') AS rr, abs(spread - r_spread) AS sd FROM pair),
lab AS (SELECT *, coalesce(de::INT, 0) + coalesce(ft::INT, 0) + coalesce(li::INT, 0) + 1 + coalesce(rr::INT, 0) + (sd <= 0.0025::DOUBLE)::INT AS informative_matches,
  (NOT de)::INT + (NOT ft)::INT + (NOT li)::INT AS hard, (NOT de)::INT + (NOT ft)::INT + (NOT li)::INT + coalesce((NOT rr)::INT, 0) + (sd > 0.01::DOUBLE)::INT AS conflicts FROM cmp),
pairs AS (SELECT substr(sha256(concat_ws(chr(31), CAST(period_end AS VARCHAR), facility_row_id, r_id)), 1, 24) AS pair_id, *,
  CASE WHEN length(borrower_norm) < 4 THEN 'unrelated' WHEN conflicts > 0 THEN 'same_borrower_different_facility' WHEN informative_matches >= 4 AND sd <= 0.0025::DOUBLE THEN 'same_facility' ELSE 'uncertain' END AS predicted_label,
  CASE WHEN length(borrower_norm) < 4 THEN 'high' WHEN conflicts > 0 THEN CASE WHEN hard > 0 THEN 'high' ELSE 'medium' END WHEN informative_matches >= 4 AND sd <= 0.0025::DOUBLE THEN 'high' ELSE 'low' END AS match_confidence FROM lab)
"""


def pairs(spark, sf):
    return M.compare(M.candidate_pairs(A.positions(spark, sf), block="part"))


@query(PAIRS + "SELECT pair_id, facility_row_id AS left_id, r_id AS right_id, ticker AS left_ticker, r_ticker AS right_ticker FROM pairs")
def candidate_pairs(spark, sf):
    return pairs(spark, sf).select("pair_id", F.col("left_facility_row_id").alias("left_id"), F.col("right_facility_row_id").alias("right_id"), "left_ticker", "right_ticker")


@query(PAIRS + "SELECT pair_id, CAST(informative_matches AS BIGINT) AS informative_matches, CAST(conflicts AS BIGINT) AS conflicts, round(sd, 8) AS spread_diff, rr AS rate_match, predicted_label, match_confidence FROM pairs")
def pair_compare(spark, sf):
    return pairs(spark, sf).select("pair_id", count("informative_matches"), F.size("hard_conflicts").cast("long").alias("conflicts"), near("spread_diff", 8), F.col("reference_rate_match").alias("rate_match"), "predicted_label", "match_confidence")


@query(PAIRS + "SELECT predicted_label, match_confidence, count(*) AS n FROM pairs GROUP BY ALL")
def label_counts(spark, sf):
    return pairs(spark, sf).groupBy("predicted_label", "match_confidence").agg(F.count(F.lit(1)).alias("n"))


FLIP = "(strpos('0123456789abcdef', substr(sha256('7:' || pair_id), 1, 1)) - 1) % 2 = 1"


@query(PAIRS + f"SELECT pair_id, CASE WHEN {FLIP} THEN r_id ELSE facility_row_id END AS left_id, CASE WHEN {FLIP} THEN facility_row_id ELSE r_id END AS right_id FROM pairs")
def swap_sides(spark, sf):
    out = M.swap_sides(pairs(spark, sf), S.flip(7, "pair_id"))
    return out.select("pair_id", F.col("left_facility_row_id").alias("left_id"), F.col("right_facility_row_id").alias("right_id"))


@query(PAIRS + """, st AS (SELECT pair_id, CASE WHEN predicted_label = 'same_facility' AND match_confidence = 'high' THEN 'predicted_same_facility_high' WHEN predicted_label = 'same_borrower_different_facility' AND match_confidence = 'high'
  THEN 'hard_same_borrower_different_facility' WHEN predicted_label IN ('uncertain', 'unrelated') THEN 'uncertain_alias_distractor' END AS stratum FROM pairs)
SELECT pair_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('11:' || pair_id), pair_id) AS n FROM st) t
WHERE n <= CASE stratum WHEN 'predicted_same_facility_high' THEN 60 WHEN 'hard_same_borrower_different_facility' THEN 30 WHEN 'uncertain_alias_distractor' THEN 30 ELSE 0 END""")
def stratified_sample(spark, sf):
    quotas = {"predicted_same_facility_high": 60, "hard_same_borrower_different_facility": 30, "uncertain_alias_distractor": 30}
    return S.stratified_sample(pairs(spark, sf), "pair_id", S.candidate_stratum(), quotas, 11).select("pair_id", "stratum")


@query("SELECT event_id FROM events ORDER BY sha256('20260813:' || CAST(event_id AS VARCHAR)), event_id LIMIT 100")
def simple_sample(spark, sf):
    return S.simple_sample(A.table(spark, sf, "events"), "event_id", 100, 20260813).select("event_id")


@query("SELECT e.event_id, e.user_id FROM events e SEMI JOIN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) t ORDER BY sha256('3:' || CAST(user_id AS VARCHAR)), user_id LIMIT 12) u ON e.user_id = u.user_id")
def keyed_sample(spark, sf):
    return S.keyed_sample(A.table(spark, sf, "events"), "user_id", 12, 3).select("event_id", "user_id")


@query(PAIRS + "SELECT 'B' || substr(sha256('5-id:' || pair_id), 1, 12) AS blind_id, ticker AS left_ticker, r_ticker AS right_ticker, round(spread, 4) AS left_spread FROM pairs")
def blind_projection(spark, sf):
    public, _ = S.blind(pairs(spark, sf).withColumn("left_spread", F.round("left_spread", 4)), ["left_ticker", "right_ticker", "left_spread"], ["predicted_label", "match_confidence", "evidence"], 5, "pair_id")
    return public


# ---- point in time


def stored(spark, sf, *more: str) -> DataFrame:
    """Positions with what the operators read of them (and the columns named as more), scanned and written once."""
    return materialize(A.positions(spark, sf).select(*E.FACILITY, "is_current_period", *more), "positions")


@query(PRIOR + "SELECT s_id, p_id, match_count FROM met WHERE s_ticker = p_ticker")
def prior_quarter_match(spark, sf):
    return E.prior_matches(stored(spark, sf)).select(F.col("s_economic_facility_id").alias("s_id"), F.col("p_economic_facility_id").alias("p_id"), "match_count")


class Stored:
    """What the point-in-time queries share, each computed once: one scan of the facts for all of a query,
    of which the columns are kept that the operators read (and those named as more)."""

    def __init__(self, spark, sf, *more: str):
        self.positions = stored(spark, sf, "results_ts", *more)
        self.calendar = materialize(A.calendar(self.positions), "calendar")
        self.results, self.listed = E.calendar(self.calendar), A.listed(self.calendar)
        self.matches = materialize(E.match_table(self.positions, self.results), "matches")

    def eligible(self, **how) -> DataFrame:
        return E.eligible(self.positions, self.results, self.listed, matches=self.matches, **how)

    def losses(self) -> E.Losses:
        return E.loss_counts(self.positions, self.results, self.listed, matches=self.matches)


def observations(spark, sf) -> DataFrame:
    return Stored(spark, sf).eligible()


@query(ELIGIBLE + "SELECT observation_id, source_ticker, target_ticker, CAST(source_information_ts AS VARCHAR) AS source_information_ts, CAST(target_cutoff_ts AS VARCHAR) AS target_cutoff_ts, round(window_days, 6) AS window_days, round(source_delta, 8) AS source_delta, movement_eligible FROM elig")
def eligible_observations(spark, sf):
    return observations(spark, sf).select("observation_id", "source_ticker", "target_ticker", *text("source_information_ts", "target_cutoff_ts"), near("window_days"), near("source_delta", 8), "movement_eligible")


@query(PRIOR + "SELECT s_id, round(s_mark - p_mark, 8) AS delta FROM met WHERE s_ticker = p_ticker AND match_count = 1 AND abs(s_mark - p_mark) >= 0.005::DOUBLE")
def movement(spark, sf):
    return E.movements(stored(spark, sf)).select(F.col("s_economic_facility_id").alias("s_id"), near("delta", 8))


@query(ELIGIBLE + """SELECT CAST(year(period_end) AS VARCHAR) || 'Q' || CAST(quarter(period_end) AS VARCHAR) AS quarter, count(*) AS eligible, count(source_delta) AS computable, count(*) FILTER (WHERE movement_eligible) AS moved,
  count(DISTINCT CASE WHEN movement_eligible THEN source_ticker || '/' || source_facility_id END) AS moved_facilities, count(DISTINCT CASE WHEN movement_eligible THEN borrower_norm END) AS moved_borrowers,
  round(quantile_cont(window_days, 0.25), 6) AS p25, round(quantile_cont(window_days, 0.5), 6) AS median, round(quantile_cont(window_days, 0.75), 6) AS p75 FROM elig GROUP BY 1""")
def movement_summary(spark, sf):
    return E.movement_summary(observations(spark, sf)).select("quarter", "eligible", "computable", "moved", "moved_facilities", "moved_borrowers", near("p25"), near("median"), near("p75"))


@query(PRIOR + "SELECT s_id, round(s_mark, 8) AS mark, round(s_mark + (s_mark - p_mark), 8) AS b1 FROM met WHERE s_ticker = p_ticker AND match_count = 1")
def momentum(spark, sf):
    return EV.momentum(stored(spark, sf)).select(F.col("economic_facility_id").alias("s_id"), near("mark", 8), near("b1", 8))


VOTES = """, votes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period_end, target_ticker, target_prior_facility_id, source_ticker ORDER BY source_information_ts, observation_id) AS n FROM elig) t WHERE n = 1)
"""


@query(ELIGIBLE + VOTES + "SELECT observation_id, source_ticker FROM votes")
def one_fund_one_vote(spark, sf):
    return EV.one_fund_one_vote(observations(spark, sf), ["period_end", "target_ticker", "target_prior_facility_id"]).select("observation_id", "source_ticker")


@query(ELIGIBLE + VOTES + "SELECT target_prior_facility_id, target_ticker, round(median(source_mark), 8) AS b2, round(arg_min(source_mark, (source_information_ts, source_ticker)), 8) AS b3, count(*) AS n_votes FROM votes WHERE source_mark IS NOT NULL GROUP BY period_end, target_ticker, target_prior_facility_id")
def coholder_median(spark, sf):
    return EV.coholders(observations(spark, sf)).select("target_prior_facility_id", "target_ticker", near("b2", 8), near("b3", 8), "n_votes")


LENDERS = f""", len1 AS (SELECT s.economic_facility_id AS id, p.ticker AS lender, p.fair_value / nullif(p.principal, 0) AS m, count(*) OVER (PARTITION BY s.economic_facility_id, p.ticker) AS c
  FROM cur s JOIN cur p ON s.period_end = p.period_end AND s.borrower_norm = p.borrower_norm AND s.ticker <> p.ticker WHERE {A.strict_sql("s", "p")}),
len AS (SELECT id, median(m) AS b4, count(*) AS n_lenders FROM len1 WHERE c = 1 AND m IS NOT NULL GROUP BY id)
"""


@query(PRIOR + LENDERS + "SELECT id, round(b4, 8) AS b4, n_lenders FROM len")
def prior_lender_median(spark, sf):
    return EV.prior_lenders(stored(spark, sf)).select(F.col("economic_facility_id").alias("id"), near("b4", 8), "n_lenders")


EVAL = LENDERS + f""", mom AS (SELECT s_id AS id, s_mark + (s_mark - p_mark) AS b1 FROM met WHERE s_ticker = p_ticker AND match_count = 1),
nxt AS (SELECT s.economic_facility_id AS id, count(*) AS matches, CASE WHEN count(*) = 1 THEN any_value(p.fair_value / nullif(p.principal, 0)) END AS actual, CASE WHEN count(*) = 1 THEN bool_or(p.non_accrual) END AS next_na
  FROM cur s JOIN cur p ON last_day(s.period_end + INTERVAL 3 MONTH) = p.period_end AND s.borrower_norm = p.borrower_norm AND s.ticker = p.ticker WHERE {A.strict_sql("s", "p")} GROUP BY 1),
co AS (SELECT period_end, target_ticker, target_prior_facility_id, median(source_mark) AS b2, arg_min(source_mark, (source_information_ts, source_ticker)) AS b3 FROM votes WHERE source_mark IS NOT NULL GROUP BY ALL),
ev AS (SELECT e.*, p.fair_value / nullif(p.principal, 0) AS b0, mom.b1, co.b2, co.b3, len.b4, p.fair_value / nullif(p.principal, 0) + (e.source_mark - e.source_prior_mark) AS adjusted, nxt.actual, coalesce(nxt.matches, 0) AS matches, nxt.id IS NULL AS disappeared,
  coalesce(next_na, false) AND NOT p.non_accrual AS non_accrual_transition, date_diff('microsecond', source_information_ts, target_cutoff_ts) / 3600000000.0::DOUBLE AS hours
 FROM elig e JOIN pos p ON p.economic_facility_id = e.target_prior_facility_id LEFT JOIN mom ON mom.id = e.target_prior_facility_id LEFT JOIN len ON len.id = e.target_prior_facility_id LEFT JOIN nxt ON nxt.id = e.target_prior_facility_id
 LEFT JOIN co ON co.period_end = e.period_end AND co.target_ticker = e.target_ticker AND co.target_prior_facility_id = e.target_prior_facility_id),
err AS (SELECT *, abs(b0 - actual) * 100 AS b0_error_pp, abs(b1 - actual) * 100 AS b1_error_pp, abs(b2 - actual) * 100 AS b2_error_pp, abs(b3 - actual) * 100 AS b3_error_pp, abs(b4 - actual) * 100 AS b4_error_pp, abs(adjusted - actual) * 100 AS adjusted_error_pp,
  CASE WHEN hours <= 24 THEN '<=1d' WHEN hours <= 72 THEN '1-3d' ELSE '>3d' END AS bucket FROM ev)
"""


def evaluated(spark, sf):
    own = Stored(spark, sf, "pik_rate", "non_accrual", "restructuring_flag")
    return EV.evaluate(own.positions, materialize(own.eligible(), "eligible"), matches=own.matches)


@query(ELIGIBLE + VOTES + EVAL + "SELECT observation_id, round(b0, 8) AS b0, round(b1, 8) AS b1, round(b2, 8) AS b2, round(b3, 8) AS b3, round(b4, 8) AS b4, round(adjusted, 8) AS adjusted, round(actual, 8) AS actual, matches, disappeared, non_accrual_transition FROM err")
def nowcast_eval(spark, sf):
    return evaluated(spark, sf).select("observation_id", *[near(c, 8) for c in EV.BASELINES], near("actual", 8), count("matches"), "disappeared", "non_accrual_transition")


@query(PRIOR + """, pe AS (SELECT s_id, p_ticker, s_ticker AS grp, abs(s_mark - p_mark) * 100 AS e0, abs(s_mark - 1) * 100 AS e1 FROM met WHERE match_count = 1)
SELECT grp, measure, count(error) AS n, round(avg(error), 6) AS mae, round(sqrt(avg(error * error)), 6) AS rmse, round(median(error), 6) AS median_error FROM (SELECT grp, unnest(['e0', 'e1']) AS measure, unnest([e0, e1]) AS error FROM pe) t GROUP BY grp, measure""")
def error_metrics(spark, sf):
    return EV.error_metrics(prior_errors(spark, sf), ["e0", "e1"], ["grp"]).select("grp", "measure", "n", near("mae"), near("rmse"), near("median_error"))


def prior_errors(spark, sf):
    met = E.unique_priors(stored(spark, sf), same_fund=False)
    now, before = (V.mark(None, F.col(f"{x}_fair_value"), F.col(f"{x}_principal")) for x in ("s", "p"))
    return met.select(F.col("s_ticker").alias("grp"), F.col("s_borrower_norm").alias("borrower"), F.col("p_ticker").alias("target"), V.error_pp(now, before).alias("e0"), V.error_pp(now, F.lit(1.0)).alias("e1"), now.alias("now"), before.alias("before"))


ERRORS = PRIOR + ", pe AS (SELECT s_ticker AS grp, borrower_norm AS borrower, p_ticker AS target, abs(s_mark - p_mark) * 100 AS e0, abs(s_mark - 1) * 100 AS e1, s_mark, p_mark FROM met WHERE match_count = 1)\n"


@query(ERRORS + ", t AS (SELECT count(*) AS n, sum(e0) AS s0, count(e0) AS n0, sum(e1) AS s1, count(e1) AS n1 FROM pe), g AS (SELECT borrower, count(*) AS n, coalesce(sum(e0), 0) AS s0, count(e0) AS n0, coalesce(sum(e1), 0) AS s1, count(e1) AS n1 FROM pe GROUP BY borrower) SELECT borrower, t.n - g.n AS n_rows, round((t.s0 - g.s0) / nullif(t.n0 - g.n0, 0), 6) AS e0, round((t.s1 - g.s1) / nullif(t.n1 - g.n1, 0), 6) AS e1 FROM g, t")
def loo_sensitivity(spark, sf):
    return EV.leave_one_out(prior_errors(spark, sf), "borrower", ["e0", "e1"]).select("borrower", "n_rows", near("e0"), near("e1"))


@query(ERRORS + "SELECT count(*) AS clusters, round(avg(e0), 6) AS e0, round(avg(e1), 6) AS e1 FROM (SELECT borrower, grp, target, avg(e0) AS e0, avg(e1) AS e1 FROM pe GROUP BY ALL) t")
def cluster_mae(spark, sf):
    return EV.cluster_means(prior_errors(spark, sf), ["borrower", "grp", "target"], ["e0", "e1"]).select("clusters", near("e0"), near("e1"))


@query(ERRORS + "SELECT count(*) AS n, count(*) FILTER (WHERE abs(coalesce(s_mark, 0) - coalesce(p_mark, 0)) < 1e-12::DOUBLE) AS same FROM pe")
def degenerate_rows(spark, sf):
    return EV.degenerate(prior_errors(spark, sf), "now", "before")


@query(ELIGIBLE + "SELECT CASE WHEN window_days * 24 <= 24 THEN '<=1d' WHEN window_days * 24 <= 72 THEN '1-3d' ELSE '>3d' END AS bucket, count(*) AS n FROM elig GROUP BY 1")
def window_bucket(spark, sf):
    return observations(spark, sf).groupBy(V.window_bucket(F.col("window_days") * 24).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


LOSS = f""", tgt AS (SELECT DISTINCT ticker AS target FROM cal WHERE cik < {A.LISTED}),
rows_ AS (SELECT c.*, r.results_ts AS r_ts, greatest(r.results_ts, c.accepted) AS public_ts,
  (nullif(debt_equity, 'unknown') IS NOT NULL)::INT + (nullif(facility_type, 'unknown') IS NOT NULL)::INT + (nullif(lien, 'unknown') IS NOT NULL)::INT + 1 + (nullif(reference_rate, 'UNKNOWN') IS NOT NULL)::INT + (spread IS NOT NULL)::INT >= 3 AS ready
  FROM cur c LEFT JOIN res r ON r.ticker = c.ticker AND r.period_end = c.period_end),
held AS (SELECT DISTINCT period_end AS prior_end, borrower_norm, ticker AS target FROM cur SEMI JOIN tgt ON ticker = target),
ovl AS (SELECT prior_end, borrower_norm, list(target) AS holders FROM held GROUP BY ALL),
own AS (SELECT s_id FROM pub WHERE s_ticker = p_ticker), oth AS (SELECT s_id, p_ticker, p_id, p_public FROM pub WHERE s_ticker <> p_ticker),
coded AS (SELECT x.economic_facility_id, x.ticker, x.period_end, t.target, own.s_id IS NOT NULL AS own_prior, oth.p_id AS target_prior_id,
  CASE WHEN x.r_ts IS NULL OR k.results_ts IS NULL THEN 'A' WHEN NOT x.ready THEN 'B' WHEN len(list_filter(coalesce(ovl.holders, []), lambda h: h <> x.ticker)) = 0 THEN 'G' WHEN NOT list_contains(ovl.holders, t.target) THEN 'C' WHEN oth.p_id IS NULL THEN 'D'
   WHEN own.s_id IS NULL THEN 'E' WHEN NOT (oth.p_public < x.public_ts AND x.public_ts < k.results_ts) THEN 'F' ELSE 'eligible' END AS loss_code
 FROM rows_ x JOIN tgt t ON x.ticker <> t.target LEFT JOIN ovl ON ovl.prior_end = x.prior_end AND ovl.borrower_norm = x.borrower_norm LEFT JOIN own ON own.s_id = x.economic_facility_id
 LEFT JOIN res k ON k.ticker = t.target AND k.period_end = x.period_end LEFT JOIN oth ON oth.s_id = x.economic_facility_id AND oth.p_ticker = t.target)
"""


def coded(spark, sf):
    return Stored(spark, sf).losses().counts


@query(ELIGIBLE + LOSS + "SELECT loss_code, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 3) AS pct FROM coded GROUP BY loss_code")
def loss_funnel(spark, sf):
    return E.loss_funnel(coded(spark, sf))


@query(ELIGIBLE + LOSS + "SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, loss_code, n FROM (SELECT ticker, period_end, loss_code, count(*) AS n, row_number() OVER (PARTITION BY ticker, period_end ORDER BY count(*) DESC, loss_code) AS r FROM coded GROUP BY ticker, period_end, loss_code) t WHERE r = 1")
def modal_loss(spark, sf):
    return E.modal_loss(coded(spark, sf)).select("ticker", *text("period_end"), "loss_code", "n")


@query(WITH + """SELECT ticker, count(*) AS n_rows, round(100.0::DOUBLE * count(nullif(lien, 'unknown')) / count(*), 3) AS pct_lien, round(100.0::DOUBLE * count(nullif(reference_rate, 'UNKNOWN')) / count(*), 3) AS pct_reference_rate,
  round(100.0::DOUBLE * count(spread) / count(*), 3) AS pct_spread, round(100.0::DOUBLE * count(maturity) / count(*), 3) AS pct_maturity, round(100.0::DOUBLE * count(principal) / count(*), 3) AS pct_principal FROM fac GROUP BY ticker""")
def completeness(spark, sf):
    return E.completeness(A.facilities(spark, sf), ["ticker"], ["lien", "reference_rate", "spread", "maturity", "principal"])


SHOWN = ("borrower_norm", "debt_equity", "facility_type", "lien", "currency", "reference_rate", "spread", "maturity", "funded_status", "principal", "fair_value")
_PCT = ", ".join(f"round(100.0::DOUBLE * count(CASE WHEN CAST({c} AS VARCHAR) NOT IN ('', 'unknown', 'UNKNOWN') THEN 1 END) / count(*), 3) AS pct_{c}" for c in SHOWN)
_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.LOSSES.items())


@query(PAIRS + A.CALENDAR + A.PRIOR + A.ELIGIBLE + LOSS + f""", h AS (SELECT ticker, period_end, count(*) AS aggregated_facilities, count(*) FILTER (WHERE is_current_period) AS current_facilities FROM pos GROUP BY ALL),
sd AS (SELECT period_end, ticker, facility_row_id AS id, informative_matches, predicted_label FROM pairs UNION ALL SELECT period_end, r_ticker, r_id, informative_matches, predicted_label FROM pairs),
en AS (SELECT ticker, period_end, count(DISTINCT id) AS entering, count(*) AS pairs, count(*) FILTER (WHERE informative_matches >= 3) AS informative_pairs, count(*) FILTER (WHERE predicted_label = 'same_facility') AS predicted_same FROM sd GROUP BY ALL),
so AS (SELECT ticker, period_end, count(DISTINCT CASE WHEN own_prior THEN economic_facility_id END) AS with_prior FROM coded GROUP BY ALL),
ta AS (SELECT target AS ticker, period_end, count(DISTINCT target_prior_id) AS target_priors FROM coded WHERE loss_code IN ('F', 'eligible') GROUP BY ALL),
el AS (SELECT source_ticker AS ticker, period_end, count(*) AS eligible, count(*) FILTER (WHERE movement_eligible) AS moved FROM elig GROUP BY ALL),
sh AS (SELECT ticker, period_end, {_PCT} FROM pos WHERE is_current_period GROUP BY ALL),
md AS (SELECT ticker, period_end, loss_code FROM (SELECT ticker, period_end, loss_code, row_number() OVER (PARTITION BY ticker, period_end ORDER BY count(*) DESC, loss_code) AS r FROM coded GROUP BY ticker, period_end, loss_code) t WHERE r = 1),
pb AS (SELECT c.ticker, c.period_end, greatest(r.results_ts, min(c.accepted)) AS public_ts FROM cur c JOIN res r ON r.ticker = c.ticker AND r.period_end = c.period_end GROUP BY c.ticker, c.period_end, r.results_ts),
op AS (SELECT s.ticker, s.period_end, count(*) FILTER (WHERE t.ticker <> s.ticker AND s.public_ts < t.results_ts) AS opportunities FROM pb s LEFT JOIN (SELECT res.* FROM res SEMI JOIN tgt ON res.ticker = tgt.target) t ON t.period_end = s.period_end GROUP BY ALL),
gr AS (SELECT g.ticker, g.period_end, g.cik, h.*, en.*, so.*, ta.*, el.*, sh.*, op.opportunities, res.results_ts AS r_ts, tgt.target AS is_listed,
  coalesce(CASE md.loss_code {_LABELS} WHEN 'eligible' THEN 'none' END, CASE WHEN coalesce(current_facilities, 0) = 0 THEN 'no_current_period_facilities' ELSE 'none' END) AS first_loss
 FROM (SELECT DISTINCT ticker, period_end, cik FROM cal) g LEFT JOIN h USING (ticker, period_end) LEFT JOIN en USING (ticker, period_end) LEFT JOIN so USING (ticker, period_end) LEFT JOIN ta USING (ticker, period_end) LEFT JOIN el USING (ticker, period_end)
 LEFT JOIN sh USING (ticker, period_end) LEFT JOIN md USING (ticker, period_end) LEFT JOIN op USING (ticker, period_end) LEFT JOIN res USING (ticker, period_end) LEFT JOIN tgt ON tgt.target = g.ticker)
SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, CAST(year(period_end) AS VARCHAR) || 'Q' || CAST(quarter(period_end) AS VARCHAR) AS quarter, CASE WHEN is_listed IS NULL THEN 'not_listed' ELSE 'listed' END AS listed_status, r_ts IS NOT NULL AS verified_reporting_order_available,
 first_loss, first_loss AS dominant_exclusion_reason, coalesce(aggregated_facilities, 0) AS aggregated_facilities, coalesce(current_facilities, 0) AS current_facilities, coalesce(entering, 0) AS entering, coalesce(pairs, 0) AS pairs, coalesce(informative_pairs, 0) AS informative_pairs,
 coalesce(predicted_same, 0) AS predicted_same, coalesce(with_prior, 0) AS with_prior, coalesce(target_priors, 0) AS target_priors, coalesce(eligible, 0) AS eligible, coalesce(moved, 0) AS moved, coalesce(opportunities, 0) AS source_before_target_opportunities, {", ".join(f"coalesce(pct_{c}, 0) AS pct_{c}" for c in SHOWN)} FROM gr""")
def bottleneck_grid(spark, sf):
    own = Stored(spark, sf, "facility_row_id", "adsh", "investment_identifier", "acquisition_date", "part")
    entering = M.pair_counts(own.positions, block="part")
    out = E.bottlenecks(own.positions, entering, own.losses(), own.eligible(), own.calendar, own.listed, list(SHOWN))
    numbers = ("aggregated_facilities", "current_facilities", "entering", "pairs", "informative_pairs", "predicted_same", "with_prior", "target_priors", "eligible", "moved", "source_before_target_opportunities")
    return out.select("ticker", *text("period_end"), "quarter", "listed_status", "verified_reporting_order_available", "first_loss", "dominant_exclusion_reason", *[count(c) for c in numbers], *[f"pct_{c}" for c in SHOWN])


# ---- calendar


@query("SELECT user_id, event_type, event_id, CAST(ts AS VARCHAR) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) t WHERE n = 1")
def first_event(spark, sf):
    return R.first_events(A.table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", *text("ts"))


GAPS = POS + A.CALENDAR + """, gap AS (SELECT a.quarter, date_diff('microsecond', a.results_ts, b.results_ts) / 86400000000.0::DOUBLE AS days FROM
 (SELECT ticker, results_ts, CAST(year(period_end) AS VARCHAR) || 'Q' || CAST(quarter(period_end) AS VARCHAR) AS quarter FROM res) a JOIN
 (SELECT ticker, results_ts, CAST(year(period_end) AS VARCHAR) || 'Q' || CAST(quarter(period_end) AS VARCHAR) AS quarter FROM res) b ON a.quarter = b.quarter AND a.results_ts < b.results_ts)
"""


@query(GAPS + "SELECT quarter, count(*) AS n_pairs, round(quantile_cont(days, 0.25), 6) AS p25, round(quantile_cont(days, 0.5), 6) AS median, round(quantile_cont(days, 0.75), 6) AS p75, count(*) FILTER (WHERE days > 1) AS over_1d, count(*) FILTER (WHERE days > 3) AS over_3d, count(*) FILTER (WHERE days > 5) AS over_5d FROM gap GROUP BY GROUPING SETS ((quarter), ())")
def reporting_gaps(spark, sf):
    results = E.calendar(A.calendar(A.positions(spark, sf))).withColumn("quarter", V.quarter_label(F.col("period_end")))
    return R.gap_counts(results, "quarter", "results_ts").select("quarter", "n_pairs", near("p25"), near("median"), near("p75"), "over_1d", "over_3d", "over_5d")


@query(POS + A.CALENDAR + "SELECT CAST(period_end AS VARCHAR) AS period_end, count(*) AS expected, count(*) FILTER (WHERE verification_status <> 'explicit_missing') AS verified, count(*) FILTER (WHERE verification_status = 'verified_periodic_filing_fallback') AS fallback, count(*) FILTER (WHERE verification_status = 'explicit_missing') AS missing FROM cal GROUP BY period_end")
def coverage_matrix(spark, sf):
    return R.coverage(A.calendar(A.positions(spark, sf))).select(*text("period_end"), "expected", "verified", "fallback", "missing")


@query(POS + A.CALENDAR + """, lag AS (SELECT date_diff('day', period_end, CAST(acceptance_timestamp_utc AS DATE)) AS d FROM cal WHERE acceptance_timestamp_utc IS NOT NULL)
SELECT count(*) AS n, CAST(min(d) AS BIGINT) AS least, round(quantile_cont(d::DOUBLE, 0.25), 6) AS p25, round(quantile_cont(d::DOUBLE, 0.5), 6) AS median, round(quantile_cont(d::DOUBLE, 0.75), 6) AS p75, CAST(max(d) AS BIGINT) AS most, count(*) FILTER (WHERE d BETWEEN 20 AND 80) AS inside, count(*) FILTER (WHERE d NOT BETWEEN 20 AND 80) AS outside FROM lag""")
def lag_stats(spark, sf):
    cal = A.calendar(A.positions(spark, sf)).withColumn("lag_days", V.lag_days(F.col("acceptance_timestamp_utc"), F.col("period_end")))
    return R.lag_stats(cal).select("n", count("least"), near("p25"), near("median"), near("p75"), count("most"), "inside", "outside")


@query("SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M') AS eastern, CASE WHEN m < 570 THEN 'pre-market' WHEN m >= 960 THEN 'after-market' ELSE 'market-hours' END AS session FROM (SELECT *, hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') * 60 + minute(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS m FROM events) t")
def market_session(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return A.table(spark, sf, "events").select("event_id", F.date_format(V.eastern(ts), "yyyy-MM-dd HH:mm").alias("eastern"), V.market_session(ts).alias("session"))


@query("SELECT nation.n_name AS name, CAST(greatest(m, DATE '2024-09-01' + CAST(n_nationkey AS INT)) AS VARCHAR) AS start, CAST(least(last_day(m), DATE '2026-05-15') AS VARCHAR) AS stop FROM nation, (SELECT CAST(unnest(generate_series(DATE '2024-09-01', DATE '2026-05-15', INTERVAL 1 MONTH)) AS DATE) AS m) t WHERE last_day(m) >= DATE '2024-09-01' + CAST(n_nationkey AS INT)")
def month_chunks(spark, sf):
    start = F.date_add(F.lit("2024-09-01").cast("date"), F.col("n_nationkey"))
    chunks = A.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.inline(V.month_chunks(start, F.lit("2026-05-15").cast("date"))))
    return chunks.select("name", F.col("from").cast("string").alias("start"), F.col("to").cast("string").alias("stop"))


@query(POS + A.CALENDAR + """, o AS (SELECT ticker, period_end, min(accepted) AS t FROM pos GROUP BY ALL)
SELECT cal.ticker, CAST(cal.period_end AS VARCHAR) AS period_end, CAST(least(acceptance_timestamp_utc, o.t - INTERVAL 1 DAY) AS VARCHAR) AS ts, coalesce(o.t - INTERVAL 1 DAY < acceptance_timestamp_utc, false) AS shifted FROM cal LEFT JOIN o USING (ticker, period_end)""")
def fallback_override(spark, sf):
    pos = A.positions(spark, sf)
    over = pos.select("ticker", "period_end", (F.col("accepted") - F.expr("interval 1 day")).alias("acceptance_timestamp_utc"))
    out = R.override_earlier(A.calendar(pos), over, ["ticker", "period_end"], "acceptance_timestamp_utc")
    return out.select("ticker", *text("period_end"), F.col("acceptance_timestamp_utc").cast("string").alias("ts"), "shifted")


@query(POS + A.CALENDAR + "SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, CAST(coalesce(results_ts, least_) AS VARCHAR) AS results_ts FROM (SELECT ticker, period_end, min(accepted) AS least_ FROM pos WHERE is_current_period GROUP BY ALL) a FULL JOIN res USING (ticker, period_end)")
def reporting_cutoffs(spark, sf):
    pos = A.positions(spark, sf)
    now = pos.filter("is_current_period").select("ticker", "period_end", F.col("accepted").alias("results_ts"))
    return R.earliest_or_default(now, E.calendar(A.calendar(pos)), ["ticker", "period_end"], "results_ts").select("ticker", *text("period_end", "results_ts"))


# ---- lineage

CANDIDATES = WITH + """, cand AS (SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, borrower_norm, facility_type AS identifier, 'reference_rate' AS field, CASE WHEN spread < 0.05::DOUBLE THEN 'SOFR' ELSE 'PRIME' END AS value FROM fac WHERE reference_rate = '1-URGENT'),
fix AS (SELECT ticker, period_end, borrower_norm, identifier, min(value) AS value FROM cand GROUP BY ALL HAVING count(DISTINCT value) = 1)
"""
LINEAGE = ("ticker", "period_text", "borrower_norm", "identifier")


def lineage_inputs(spark, sf):
    rows = A.facilities(spark, sf).withColumns({"period_text": F.col("period_end").cast("string"), "identifier": F.col("facility_type")})
    cand = rows.filter("reference_rate = '1-URGENT'").select(*LINEAGE, F.lit("reference_rate").alias("field"), F.when(F.col("spread") < 0.05, "SOFR").otherwise("PRIME").alias("value"), F.col("facility_row_id").alias("source"))
    return rows, L.corrections(cand, LINEAGE)


@query(CANDIDATES + "SELECT f.facility_row_id, CASE WHEN x.value IS NOT NULL THEN x.value ELSE f.reference_rate END AS reference_rate, CASE WHEN x.value IS NULL THEN NULL WHEN f.reference_rate = 'UNKNOWN' THEN 'filled' WHEN f.reference_rate <> x.value THEN 'replaced' ELSE 'matched' END AS how FROM fac f LEFT JOIN fix x ON x.ticker = f.ticker AND x.period_end = CAST(f.period_end AS VARCHAR) AND x.borrower_norm = f.borrower_norm AND x.identifier = f.facility_type")
def lineage_fill(spark, sf):
    rows, fixes = lineage_inputs(spark, sf)
    return L.repair(rows, fixes, ["reference_rate"], LINEAGE).select("facility_row_id", "reference_rate", F.col("reference_rate_repair").alias("how"))


@query(CANDIDATES + """, rep AS (SELECT f.reference_rate AS old, coalesce(x.value, f.reference_rate) AS new, x.value AS fixed FROM fac f LEFT JOIN fix x ON x.ticker = f.ticker AND x.period_end = CAST(f.period_end AS VARCHAR) AND x.borrower_norm = f.borrower_norm AND x.identifier = f.facility_type)
SELECT 'reference_rate' AS field, count(nullif(old, 'UNKNOWN')) AS before, count(nullif(new, 'UNKNOWN')) AS after, count(*) FILTER (WHERE fixed IS NOT NULL AND old = 'UNKNOWN') AS filled, count(*) FILTER (WHERE old <> 'UNKNOWN' AND old <> fixed) AS replaced, count(fixed) AS matched FROM rep""")
def lineage_counts(spark, sf):
    rows, fixes = lineage_inputs(spark, sf)
    return L.repair_counts(L.repair(rows, fixes, ["reference_rate"], LINEAGE), ["reference_rate"])


@query(WITH + """, s AS (SELECT ticker, unnest(['lien', 'spread', 'maturity']) AS field, unnest([CASE WHEN lien <> 'unknown' THEN 1 ELSE 0 END, (spread IS NOT NULL)::INT, (maturity IS NOT NULL)::INT]) AS there FROM fac)
SELECT ticker, field, count(*) AS n_rows, CAST(sum(there) AS BIGINT) AS n_present, 'normalized' AS stage FROM s GROUP BY ticker, field""")
def stage_counts(spark, sf):
    return L.stage_counts(A.facilities(spark, sf), ["ticker"], ["lien", "spread", "maturity"], "normalized").select("ticker", "field", "n_rows", "n_present", "stage")


@query("""SELECT event_type, CASE WHEN raw = 0 THEN 'source_absent' WHEN export_ > 0 THEN 'export_loss' WHEN agg > 0 THEN 'aggregation_loss' WHEN par > 0 THEN 'parser_loss' ELSE 'source_absent' END AS diagnosis
FROM (SELECT event_type, count(*) AS raw, count(*) FILTER (WHERE value > 1e9) AS export_, count(*) FILTER (WHERE value > 40 AND event_type = 'view') AS agg, count(*) FILTER (WHERE user_id % 2 = 0 AND event_type <> 'click') AS par FROM events GROUP BY event_type) t""")
def loss_diagnosis(spark, sf):
    n = A.table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(F.col("value") > 1e9).alias("export"), F.count_if((F.col("value") > 40) & (F.col("event_type") == "view")).alias("agg"), F.count_if((F.col("user_id") % 2 == 0) & (F.col("event_type") != "click")).alias("par"))
    return n.select("event_type", L.diagnosis(F.col("raw"), F.col("export"), F.col("agg"), F.col("par"), F.lit(0)).alias("diagnosis"))


@query(WITH + TOTALS + LOTS + "SELECT facility_row_id, count(*) OVER (PARTITION BY adsh, observation_date, borrower_norm, debt_equity, facility_type, lien, currency, reference_rate, spread, maturity, funded_status, tranche) AS members FROM lot")
def explode_ids(spark, sf):
    agg = FA.aggregate(A.facilities(spark, sf))
    return agg.select(F.explode("source_row_ids").alias("facility_row_id"), F.size("source_row_ids").cast("long").alias("members"))


@query(PAIRS + "SELECT l.facility_row_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(n = known, false) AS all_present, coalesce(known > 0, false) AS any_present FROM (SELECT DISTINCT facility_row_id, period_end, part FROM side) l LEFT JOIN (SELECT period_end, part, count(*) AS n, count(nullif(reference_rate, 'UNKNOWN')) AS known FROM pos WHERE NOT is_current_period GROUP BY ALL) r USING (period_end, part)")
def multi_match(spark, sf):
    pos = A.positions(spark, sf)
    rows = pos.filter("is_current_period").select("facility_row_id", "period_end", "part").distinct()
    return L.multi_match(rows, pos.filter("not is_current_period"), ["period_end", "part"], "reference_rate", "facility_row_id").select("facility_row_id", count("n_matches"), "all_present", "any_present")


@query("SELECT event_type, list(event_id ORDER BY ts, event_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) t WHERE n <= 3 GROUP BY event_type".replace("list(event_id ORDER BY ts, event_id)", "array_to_string(list(CAST(event_id AS VARCHAR) ORDER BY ts, event_id), ',')"))
def bounded_examples(spark, sf):
    return L.examples(A.table(spark, sf, "events"), ["event_type"], "ts", 3, "event_id").select("event_type", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


# ---- semi and anti joins, sets


@query(POS + """, src AS (SELECT economic_facility_id, borrower_norm, period_end, ticker, accepted FROM pos WHERE is_current_period)
SELECT s.economic_facility_id FROM src s WHERE EXISTS (SELECT 1 FROM src t WHERE t.borrower_norm = s.borrower_norm AND t.period_end = s.period_end AND t.ticker <> s.ticker AND s.accepted < t.accepted)""")
def feasible_semi(spark, sf):
    src = A.positions(spark, sf).filter("is_current_period").select("economic_facility_id", "borrower_norm", "period_end", "ticker", "accepted")
    # the latest row of another fund decides, so two rows for each key stand for all
    best = src.groupBy("borrower_norm", "period_end", "ticker").agg(F.max("accepted").alias("accepted"))
    out = E.feasible(M.side(src, "e_"), M.side(best, "t_"), ["borrower_norm", "period_end"], (F.col("e_ticker") != F.col("t_ticker")) & (F.col("e_accepted") < F.col("t_accepted")))
    return out.select(F.col("e_economic_facility_id").alias("economic_facility_id"))


@query(WITH + "SELECT facility_row_id FROM fac WHERE borrower_norm NOT IN ('brand 1', 'brand 12', 'brand 23')")
def exclude_dev_anti(spark, sf):
    seen = spark.createDataFrame([("brand 1",), ("brand 12",), ("brand 23",)], "borrower_norm string")
    return A.facilities(spark, sf).join(F.broadcast(seen), "borrower_norm", "left_anti").select("facility_row_id")


@query(ELIGIBLE + "SELECT observation_id FROM elig e WHERE NOT EXISTS (SELECT 1 FROM elig x WHERE x.borrower_norm = e.borrower_norm AND x.source_ticker = e.source_ticker AND x.target_ticker = e.target_ticker AND x.period_end = e.period_end AND x.source_cik % 4 = 0)")
def contaminated_anti(spark, sf):
    own = Stored(spark, sf)
    keys = own.eligible().filter("source_cik % 4 = 0").select("borrower_norm", "source_ticker", "target_ticker", "quarter").distinct()
    return own.eligible(quarantined=keys).select("observation_id")


@query("SELECT event_type, count(*) AS n FROM (SELECT event_id, event_type FROM events WHERE value > 30 UNION SELECT event_id, event_type FROM events WHERE user_id % 5 = 0 UNION SELECT event_id, event_type FROM events WHERE event_type = 'signup') t GROUP BY event_type")
def scenario_union(spark, sf):
    ev = A.table(spark, sf, "events").select("event_id", "event_type", "value", "user_id")
    ids = [ev.filter(c).select("event_id", "event_type") for c in ("value > 30", "user_id % 5 = 0", "event_type = 'signup'")]
    return O.scenario_ids(*ids).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s AS nationkey, 'left' AS only_in FROM (SELECT DISTINCT s_nationkey AS s FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9800) t UNION ALL SELECT c, 'right' FROM (SELECT DISTINCT c_nationkey AS c FROM customer WHERE c_acctbal > 9800 EXCEPT SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000) t")
def universe_difference(spark, sf):
    left = A.table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey")).distinct()
    right = A.table(spark, sf, "customer").filter("c_acctbal > 9800").select(F.col("c_nationkey").alias("nationkey")).distinct()
    return G.same_members(left, right)


# ---- events


@query("""SELECT e.event_id, CAST(max(p.ts) AS VARCHAR) AS prior_time, CASE WHEN max(p.ts) IS NULL THEN 'none' ELSE 'found' END AS status FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = e.event_type AND p.ts < e.ts GROUP BY e.event_id""")
def asof_prior(spark, sf):
    ev = A.table(spark, sf, "events")
    return E.as_of(ev, ev, ["user_id", "event_type"], "ts", F.col("event_type"), "event_id").select("event_id", *text("prior_time"), "status")


@query("""SELECT e.event_id, CAST(count(p.event_id) AS BIGINT) AS n_records, CASE count(p.event_id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status
FROM (SELECT event_id, user_id, date_trunc('minute', ts) AS m FROM events WHERE event_type = 'click') e LEFT JOIN (SELECT event_id, user_id % 10 AS u, date_trunc('minute', ts) AS m FROM events WHERE event_type <> 'click') p ON p.u = e.user_id % 10 AND p.m = e.m GROUP BY e.event_id""")
def exact_ts_match(spark, sf):
    ev = A.table(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 10).alias("u"), F.date_trunc("minute", "ts").alias("m"))
    return E.exact_time(ev.filter("event_type = 'click'"), ev.filter("event_type != 'click'"), ["u", "m"], "event_id").select("event_id", count("n_records"), "status")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def doctype_hist(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return A.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("SELECT user_id AS event_id, count(*) AS attempts, count(*) FILTER (WHERE event_type <> 'error' AND value > 5) AS succeeded, arg_max(event_type, event_id) AS last_result FROM events GROUP BY user_id")
def attempt_status(spark, sf):
    from ledgerloom.operators import revisions

    tries = A.table(spark, sf, "events").select(F.col("user_id").alias("event_id"), F.col("event_id").alias("attempt_order"), F.col("event_type").alias("result"), "value")
    return revisions.attempt_status(tries, (F.col("result") != "error") & (F.col("value") > 5))


@query("SELECT event_id, round(value / nullif(prev, 0) - 1, 8) AS change, CASE WHEN prev IS NULL THEN 'mixed_or_unchanged' WHEN value > prev THEN 'upward' WHEN value < prev THEN 'downward' ELSE 'mixed_or_unchanged' END AS direction FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events) t")
def change_direction(spark, sf):
    from pyspark.sql import Window

    ev = A.table(spark, sf, "events").withColumn("prev", F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    return ev.select("event_id", F.round(V.pct_change(F.col("prev"), F.col("value")), 8).alias("change"), V.direction(F.array(F.col("value") - F.col("prev"))).alias("direction"))


# ---- labels, overlap, universe


@query("""SELECT quality, count(*) FILTER (WHERE called = 1) AS predicted_1, count(*) FILTER (WHERE called = 0) AS predicted_0 FROM (SELECT quality, CASE WHEN text LIKE '%!!%' OR text LIKE '%***%' OR text LIKE '% | %' THEN 0 ELSE 1 END AS called FROM documents JOIN labels USING (doc_id)) t GROUP BY quality""")
def confusion(spark, sf):
    return EV.confusion(called(spark, sf), "quality", "called", ["1", "0"])


def called(spark, sf):
    t = F.col("text")
    docs = A.table(spark, sf, "documents").select("doc_id", F.when(t.contains("!!") | t.contains("***") | t.contains(" | "), 0).otherwise(1).alias("called"))
    return docs.join(A.table(spark, sf, "labels"), "doc_id")


@query("""SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 8) AS precision, round(tp / nullif(tp + fn, 0), 8) AS recall, coalesce(tp / nullif(tp + fp, 0) >= 0.95, false) AS gate FROM (SELECT count(*) FILTER (WHERE called = 0 AND quality = 0) AS tp, count(*) FILTER (WHERE called = 0 AND quality <> 0) AS fp, count(*) FILTER (WHERE called <> 0 AND quality = 0) AS fn
 FROM (SELECT quality, CASE WHEN text LIKE '%!!%' OR text LIKE '%***%' OR text LIKE '% | %' THEN 0 ELSE 1 END AS called FROM documents JOIN labels USING (doc_id)) t) u""")
def precision_recall(spark, sf):
    return EV.precision_recall(called(spark, sf), F.col("quality") == 0, F.col("called") == 0).select("tp", "fp", "fn", near("precision", 8), near("recall", 8), "gate")


RECORDS = PAIRS + """, rec AS (SELECT 'candidates' AS layer, CAST(period_end AS VARCHAR) AS period, ticker AS source, r_ticker AS target, facility_row_id AS facility_id, borrower_norm AS borrower FROM pairs
 UNION ALL SELECT 'same', CAST(period_end AS VARCHAR), ticker, r_ticker, facility_row_id, borrower_norm FROM pairs WHERE predicted_label = 'same_facility'),
rel AS (SELECT *, CASE WHEN CAST(substr(source, 8) AS INT) // 2 = CAST(substr(target, 8) AS INT) // 2 THEN 'same_manager' ELSE 'cross_manager' END AS relationship, CAST(substr(source, 8) AS INT) // 2 AS sm FROM rec)
"""


def records(spark, sf):
    own = pairs(spark, sf).select(F.col("period_end").cast("string").alias("period"), F.col("left_ticker").alias("source"), F.col("right_ticker").alias("target"), F.col("left_facility_row_id").alias("facility_id"), F.col("left_borrower_norm").alias("borrower"), "predicted_label")
    managers = A.table(spark, sf, "nation").select(F.col("n_name").alias("ticker"), F.floor(F.col("n_nationkey") / 2).alias("manager"))
    both = O.layers(("candidates", own.drop("predicted_label")), ("same", own.filter("predicted_label = 'same_facility'").drop("predicted_label")))
    return O.relationships(both, managers)


@query(RECORDS + "SELECT layer, period, source, target, relationship, count(*) AS observations, count(DISTINCT facility_id) AS facilities, count(DISTINCT borrower) AS borrowers FROM rel GROUP BY ALL")
def manager_overlap(spark, sf):
    return O.grouped_overlap(records(spark, sf))


@query(RECORDS + """SELECT layer, count(*) AS observations, count(*) FILTER (WHERE relationship = 'same_manager') AS same_manager, round(avg(CASE WHEN relationship = 'same_manager' THEN 1.0::DOUBLE ELSE 0 END), 8) AS same_share,
  count(DISTINCT CASE WHEN relationship = 'same_manager' THEN period || facility_id END) AS same_facilities, count(DISTINCT CASE WHEN relationship <> 'same_manager' THEN period || facility_id END) AS cross_facilities,
  count(DISTINCT CASE WHEN relationship = 'same_manager' THEN borrower END) AS same_borrowers, count(DISTINCT CASE WHEN relationship <> 'same_manager' THEN borrower END) AS cross_borrowers, count(DISTINCT sm) AS source_managers FROM rel GROUP BY layer""")
def layer_share(spark, sf):
    return O.layer_shares(records(spark, sf)).withColumn("same_share", F.round("same_share", 8))


@query(PRIOR + """, now AS (SELECT * FROM pos WHERE is_current_period), b AS (SELECT cik, count(*) AS current, count(DISTINCT period_end) AS periods, round((avg((lien <> 'unknown')::INT) + avg((reference_rate <> 'UNKNOWN')::INT) + avg((spread IS NOT NULL)::INT)) * 100.0::DOUBLE / 3, 6) AS completeness FROM now GROUP BY cik),
ex AS (SELECT period_end, borrower_norm, cik FROM now WHERE cik < 15), p AS (SELECT n.cik, count(*) FILTER (WHERE ex.cik <> n.cik) AS pair_potential, count(DISTINCT n.borrower_norm) AS overlap_borrowers FROM now n JOIN ex USING (period_end, borrower_norm) GROUP BY n.cik),
m AS (SELECT s_cik AS cik, count(*) AS movements FROM met WHERE s_ticker = p_ticker AND match_count = 1 AND abs(s_mark - p_mark) >= 0.005::DOUBLE GROUP BY 1),
f AS (SELECT b.cik, current, periods, completeness, CAST(coalesce(pair_potential, 0) AS BIGINT) AS pair_potential, coalesce(overlap_borrowers, 0) AS overlap_borrowers, coalesce(movements, 0) AS movements, b.cik < 15 AS inside FROM b LEFT JOIN p USING (cik) LEFT JOIN m USING (cik))
SELECT * EXCLUDE (inside), NOT inside AND current >= 100 AND periods >= 4 AND pair_potential > 0 AND movements > 0 AND completeness >= 40 AS recommended,
 concat_ws(' | ', CASE WHEN inside THEN 'already in existing universe' END, CASE WHEN current < 100 THEN 'fewer than 100 current-period facilities' END, CASE WHEN periods < 4 THEN 'fewer than four position periods' END, CASE WHEN pair_potential = 0 THEN 'no borrower overlap' END, CASE WHEN movements = 0 THEN 'no movements' END) AS exclusion_reason FROM f""")
def fund_profile(spark, sf):
    pos = stored(spark, sf)
    moved = E.movements(pos).select(F.col("s_cik").alias("cik"))
    out = O.fund_profile(pos, moved, pos.filter("is_current_period and cik < 15"), ["lien", "reference_rate", "spread"])
    return out.select("cik", "current", "periods", near("completeness"), count("pair_potential"), "overlap_borrowers", "movements", "recommended", "exclusion_reason")


# ---- text


@query("SELECT doc_id, trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS normalized FROM documents")
def normalize_text(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("normalized"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\\b(common|preferred|equity|unit|warrant|partnership interest)\\b') THEN 'equity' WHEN regexp_matches(t, '\\b(loan|debt|note|bond|revolver|revolving|lien|secured|unitranche)\\b') THEN 'debt' ELSE 'unknown' END AS kind,
  CASE WHEN contains(t, 'sofr') THEN 'SOFR' WHEN contains(t, 'libor') THEN 'LIBOR' WHEN contains(t, 'euribor') THEN 'EURIBOR' WHEN contains(t, 'prime') THEN 'PRIME' WHEN contains(t, 'sonia') THEN 'SONIA' WHEN contains(t, 'ester') THEN 'ESTER' WHEN contains(t, 'fixed') THEN 'FIXED' ELSE 'UNKNOWN' END AS rate,
  CASE WHEN contains(t, 'unfunded') OR contains(t, 'commitment') THEN 'unfunded' WHEN contains(t, 'delayed draw') THEN 'unknown' ELSE 'funded' END AS funded
FROM (SELECT *, trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS t FROM conversations) c""")
def classify_text(spark, sf):
    t = F.col("text")
    return A.table(spark, sf, "conversations").select("conv_id", "turn", X.debt_equity(t).alias("kind"), X.reference_rate(t).alias("rate"), X.funded_status(t).alias("funded"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b[^>]*>.*?</script>', ' ', 'gis'), '<style\\b[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '[\\s\\x1c-\\x1f\\x85\\xa0]+', ' ', 'g')) AS plain FROM pages""")
def html_strip(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", X.strip_tags(F.col("html")).alias("plain"))


@query("SELECT page_id, CAST(len(list_distinct(list_filter(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), lambda x: starts_with(x, '/')))) AS BIGINT) AS n_links FROM pages")
def page_links(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", F.size(readers.links(F.col("html"), "^/")).cast("long").alias("n_links"))


TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda t: length(t) >= 4))"


@query(f"""WITH n AS (SELECT p_brand, p_type, lower(p_name) AS name, any_value({TOKENS}) AS t FROM part GROUP BY ALL)
SELECT a.p_brand, a.p_type, a.name AS a, b.name AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 8) AS jaccard FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.name < b.name WHERE list_has_any(a.t, b.t)""")
def token_jaccard(spark, sf):
    """The names of all parts, pairwise within brand and type, where they share a token."""
    part = A.table(spark, sf, "part").select("p_brand", "p_type", F.lower("p_name").alias("name"))
    met = O.similar_names(part, "name", ["p_brand", "p_type"]).filter("name < other")
    return met.select("p_brand", "p_type", F.col("name").alias("a"), F.col("other").alias("b"), near("jaccard", 8))


@query(f"""WITH n AS (SELECT p_brand, p_type, lower(p_name) AS name, count(*) AS members, any_value({TOKENS}) AS t FROM part GROUP BY ALL),
met AS (SELECT a.p_brand, a.p_type, a.name, b.name AS other, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 8) AS jaccard, b.members - (a.name = b.name)::INT AS members FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_type = b.p_type WHERE list_has_any(a.t, b.t))
SELECT p_partkey, other, jaccard, members FROM part p JOIN met m ON m.p_brand = p.p_brand AND m.p_type = p.p_type AND m.name = lower(p.p_name) WHERE members > 0""")
def token_jaccard_names(spark, sf):
    """Every part by the names of its brand and type that share a token with its own."""
    part = A.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.lower("p_name").alias("name"))
    return O.name_similarity(part, "p_partkey", "name", ["p_brand", "p_type"]).select("p_partkey", "other", near("jaccard", 8), "members")


@query()
def alias_topk(spark, sf):
    """Names of parts as aliases, 30 drawn in each brand as the sample that the operator asks for: no SQL
    has the sequence ratio; tests hold it against difflib."""
    part = A.table(spark, sf, "part").select(F.col("p_brand").alias("period_end"), F.lower("p_name").alias("borrower_norm")).distinct()
    return O.top_aliases(O.alias_candidates(S.block_sample(part, "borrower_norm", "period_end", 30, 20260813), part))


_TOKENS = f"list_distinct(list_filter(string_split({{0}}, ' '), lambda t: length(t) >= 4 AND NOT list_contains({list(X.GENERIC_TOKENS)}, t)))"


@query(f"""WITH nm AS (SELECT DISTINCT p_brand AS block, lower(p_name || ' ' || p_type) AS name FROM part),
tk AS (SELECT block, name, {_TOKENS.format("name")} AS tokens FROM nm),
pr AS (SELECT l.block, l.name AS left_name, r.name AS right_name, contains(l.name, r.name) OR contains(r.name, l.name) AS substring_match,
  coalesce(len(list_intersect(l.tokens, r.tokens)) / nullif(len(list_distinct(list_concat(l.tokens, r.tokens))), 0)::DOUBLE, 0) AS token_jaccard,
  array_to_string(list_sort(list_filter(list_intersect(l.tokens, r.tokens), lambda t: length(t) >= 6)), ',') AS shared_long FROM tk l JOIN tk r ON l.block = r.block)
SELECT block, left_name, right_name, substring_match, round(token_jaccard, 6) AS token_jaccard, shared_long FROM pr WHERE substring_match OR token_jaccard >= 0.5 OR shared_long <> ''""")
def alias_tests(spark, sf):
    """Names and types of all parts, each name searched among all of its brand; aliases by any test but the
    sequence ratio, which SQL does not have."""
    part = A.table(spark, sf, "part").select(F.col("p_brand").alias("period_end"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("borrower_norm")).distinct()
    found = O.alias_candidates(part, part).filter(F.col("substring_match") | (F.col("token_jaccard") >= 0.5) | (F.size("shared_long_tokens") > 0))
    return found.select(F.col("period_end").alias("block"), "left_name", "right_name", "substring_match", near("token_jaccard"), F.array_join("shared_long_tokens", ",").alias("shared_long"))


@query(WITH + "SELECT facility_row_id, concat_ws(',', CASE lien WHEN 'lien_a' THEN 'first lien' WHEN 'lien_n' THEN 'second lien' END, CASE facility_type WHEN 'economy' THEN 'revolver' WHEN 'small' THEN 'term loan' END) AS words FROM fac")
def facility_discriminators(spark, sf):
    lien = F.when(F.col("lien") == "lien_a", "first_lien").when(F.col("lien") == "lien_n", "second_lien").otherwise("unknown")
    kind = F.when(F.col("facility_type") == "economy", "revolver").when(F.col("facility_type") == "small", "term_loan").otherwise("unknown")
    return A.facilities(spark, sf).select("facility_row_id", F.array_join(X.discriminators(lien, kind), ",").alias("words"))


@query(WITH + "SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(facility_row_id), 1, 15)) AS BIGINT)) AS VARCHAR) AS digest FROM fac")
def ids_digest(spark, sf):
    return G.ids_digest(A.facilities(spark, sf), "facility_row_id").select("n", *text("digest"))


# ---- marks in exhibits

_LIEN = "CASE lien WHEN 'lien_a' THEN 'first_lien' WHEN 'lien_n' THEN 'second_lien' ELSE 'unknown' END"
_KIND = "CASE facility_type WHEN 'economy' THEN 'revolver' WHEN 'small' THEN 'term_loan' ELSE 'unknown' END"


def _tokens_sql(v: str) -> str:
    """Spellings of a whole number in units, thousands and millions, as number_tokens() gives them."""
    parts = [f"CAST({v} AS VARCHAR)"]
    for scale in (1_000, 1_000_000):
        parts.append(f"CAST(CAST(round_even({v} / {scale}.0::DOUBLE, 0) AS BIGINT) AS VARCHAR)")
        for digits in (1, 2):
            step = 10**digits
            n = f"(({v} * {step} + {scale // 2}) // {scale})"
            parts.append(f"regexp_replace(CAST({n} // {step} AS VARCHAR) || '.' || lpad(CAST({n} % {step} AS VARCHAR), {digits}, '0'), '\\.?0+$', '')")
    return f"list_filter([{', '.join(parts)}], lambda x: length(x) >= 2)"


EXHIBIT = POS + f""", bor AS (SELECT pos.*, lower(p_brand || '-' || p_name) AS borrower, CAST(round_even(fair_value, 0) AS BIGINT) AS whole, {_LIEN} AS own_lien, {_KIND} AS own_kind FROM pos JOIN part ON part = p_partkey),
ex AS (SELECT ticker, period_end, CAST(part % 3 AS VARCHAR) AS filename, 'schedule of investments ' || string_agg(trim(regexp_replace(borrower, '[^a-z0-9]+', ' ', 'g')) || ' ' || replace(own_lien, '_', ' ') || ' ' || replace(own_kind, '_', ' ') || ' ' || CAST(whole AS VARCHAR), ' ' ORDER BY facility_row_id) AS plain
  FROM bor WHERE acquisition_date < period_end - 20 GROUP BY ALL),
nm AS (SELECT economic_facility_id, ticker, period_end, trim(regexp_replace(borrower, '[^a-z0-9]+', ' ', 'g')) AS name, {_tokens_sql("whole")} AS tokens,
  list_filter([CASE own_lien WHEN 'first_lien' THEN 'first lien' WHEN 'second_lien' THEN 'second lien' END, CASE own_kind WHEN 'revolver' THEN 'revolver' WHEN 'term_loan' THEN 'term loan' END], lambda x: x IS NOT NULL) AS words FROM bor WHERE is_current_period),
mt AS (SELECT ex.filename, nm.*, ' ' || substr(plain, greatest(1, instr(plain, name) - {X.BEFORE}), instr(plain, name) - greatest(1, instr(plain, name) - {X.BEFORE}) + length(name) + {X.BEHIND}) || ' ' AS near
  FROM ex JOIN nm ON ex.ticker = nm.ticker AND ex.period_end = nm.period_end AND contains(plain, name) AND length(name) >= {X.LEAST_NAME})
"""


@query(EXHIBIT + """SELECT DISTINCT ticker, CAST(period_end AS VARCHAR) AS period_end, filename, economic_facility_id FROM mt
WHERE len(list_filter(words, lambda w: contains(near, w))) > 0 AND len(list_filter(tokens, lambda t: regexp_matches(near, '[^0-9.]' || replace(t, '.', '\\.') || '[^0-9.]'))) > 0""")
def exhibit_marks(spark, sf):
    """Schedules of each fund and quarter that list what was acquired early in it, searched for all its facilities."""
    part = A.table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.lower(F.concat_ws("-", "p_brand", "p_name")).alias("borrower_norm"))
    rows = A.positions(spark, sf).drop("borrower_norm").join(part, "part").withColumns({"fair_value": F.bround("fair_value"), "lien": F.expr(_LIEN), "facility_type": F.expr(_KIND)})
    rows = materialize(rows.select("economic_facility_id", "ticker", "period_end", "borrower_norm", "fair_value", "lien", "facility_type", "is_current_period", "acquisition_date", "part"), "borrowers")
    line = F.concat_ws(" ", "borrower_norm", F.translate("lien", "_", " "), F.translate("facility_type", "_", " "), F.col("fair_value").cast("long").cast("string"))
    listed = rows.filter(F.col("acquisition_date") < F.date_sub("period_end", 20)).groupBy("ticker", "period_end", (F.col("part") % 3).cast("string").alias("filename"))
    lines = listed.agg(F.array_sort(F.collect_list(F.struct("economic_facility_id", line.alias("line")))).alias("lines"))
    body = F.concat(F.lit("<h1>Schedule of Investments</h1><p>"), F.array_join(F.transform("lines", lambda x: x["line"]), "</p><p>"), F.lit("</p>"))
    exhibits = lines.select("ticker", "period_end", F.lit(None).cast("timestamp").alias("accepted"), F.lit("").alias("accession"), "filename", body.alias("text"))
    return R.exhibit_marks(exhibits, rows).select("ticker", *text("period_end"), "filename", "economic_facility_id")


# ---- first versions and projections

FIRST = POS + f""", cur AS (SELECT *, last_day(period_end - INTERVAL 3 MONTH) AS prior_end FROM pos WHERE is_current_period),
fp AS (SELECT s.economic_facility_id AS id, min(p.economic_facility_id) AS prior_id, arg_min(p.ticker, p.economic_facility_id) AS prior_ticker, count(*) AS n_matches FROM cur s JOIN cur p ON s.prior_end = p.period_end AND s.borrower_norm = p.borrower_norm
 WHERE p.accepted <= s.accepted AND {A.strict_sql("s", "p")} GROUP BY 1)
"""


@query(FIRST + "SELECT id, prior_id, prior_ticker, n_matches FROM fp")
def prior_any_fund(spark, sf):
    return VA.first_prior(stored(spark, sf)).select(F.col("economic_facility_id").alias("id"), "prior_id", "prior_ticker", "n_matches")


@query(POS + f""", s AS (SELECT *, last_day(period_end - INTERVAL 3 MONTH) AS prior_end FROM pos WHERE is_current_period), p AS (SELECT * FROM pos WHERE NOT is_current_period)
SELECT s.economic_facility_id AS id, count(*) AS n_prior, round(sum(p.fair_value) / nullif(sum(p.principal), 0), 8) AS prior_mark FROM s JOIN p ON s.prior_end = p.observation_date AND s.cik = p.cik AND s.investment_identifier = p.investment_identifier AND s.borrower_norm = p.borrower_norm
WHERE p.accepted <= s.accepted AND {A.strict_sql("s", "p")} GROUP BY 1""")
def prior_identifier(spark, sf):
    return VA.identifier_prior(A.positions(spark, sf)).select(F.col("economic_facility_id").alias("id"), "n_prior", near("prior_mark", 8))


@query(ELIGIBLE + LENDERS + f""", v AS (SELECT period_end, target_ticker, target_prior_facility_id, median(source_mark) AS b2 FROM elig GROUP BY ALL),
nxt AS (SELECT s.economic_facility_id AS id, CASE WHEN count(*) = 1 THEN any_value(p.fair_value / nullif(p.principal, 0)) END AS actual
  FROM cur s JOIN cur p ON last_day(s.period_end + INTERVAL 3 MONTH) = p.period_end AND s.borrower_norm = p.borrower_norm AND s.ticker = p.ticker WHERE {A.strict_sql("s", "p")} GROUP BY 1),
ipr AS (SELECT s.economic_facility_id AS id, s.fair_value / nullif(s.principal, 0) AS now, sum(p.fair_value) / nullif(sum(p.principal), 0) AS before FROM cur s JOIN (SELECT * FROM pos WHERE NOT is_current_period) p ON s.prior_end = p.observation_date AND s.cik = p.cik AND s.investment_identifier = p.investment_identifier AND s.borrower_norm = p.borrower_norm
  WHERE p.accepted <= s.accepted AND {A.strict_sql("s", "p")} GROUP BY s.economic_facility_id, s.fair_value, s.principal)
SELECT observation_id, round(p.fair_value / nullif(p.principal, 0), 8) AS b0, round(ipr.now + (ipr.now - ipr.before), 8) AS b1, round(b2, 8) AS b2, round(source_mark, 8) AS b3, round(b4, 8) AS b4, round(source_mark + (p.fair_value / nullif(p.principal, 0) - source_prior_mark), 8) AS adjusted, round(abs(source_mark - actual) * 100, 6) AS b3_error_pp,
  CASE WHEN window_days * 24 <= 24 THEN '<=1d' WHEN window_days * 24 <= 72 THEN '1-3d' ELSE '>3d' END AS bucket
FROM elig e JOIN pos p ON p.economic_facility_id = e.target_prior_facility_id LEFT JOIN v ON v.period_end = e.period_end AND v.target_ticker = e.target_ticker AND v.target_prior_facility_id = e.target_prior_facility_id LEFT JOIN nxt ON nxt.id = e.target_prior_facility_id
LEFT JOIN ipr ON ipr.id = e.target_prior_facility_id LEFT JOIN len ON len.id = e.target_prior_facility_id""")
def nowcast_eval_first(spark, sf):
    own = Stored(spark, sf, "observation_date", "investment_identifier", "pik_rate", "non_accrual", "restructuring_flag")
    marks = own.positions.select("economic_facility_id", V.mark(None, F.col("fair_value"), F.col("principal")).alias("mark"))
    out = VA.evaluate(own.eligible(), EV.outcomes(own.positions), marks, VA.momentum(own.positions), EV.prior_lenders(own.positions))
    return out.select("observation_id", *[near(b, 8) for b in ("b0", "b1", "b2", "b3", "b4", "adjusted")], near("b3_error_pp"), "bucket")


@query(WITH + "SELECT label, count(*) AS n FROM (SELECT 'all' AS label FROM fac UNION ALL SELECT 'non_accrual' FROM fac WHERE non_accrual UNION ALL SELECT 'restructured' FROM fac WHERE restructuring_flag) t GROUP BY label")
def cohort_fan_out(spark, sf):
    out = P.fan_out(A.facilities(spark, sf), {"all": F.lit(True), "non_accrual": F.col("non_accrual"), "restructured": F.col("restructuring_flag")})
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, coalesce(s_name, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def preserved_rows(spark, sf):
    new = A.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    old = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return P.preserve(new, old, ["c_custkey"])


@query(POS + A.CALENDAR + f""", src AS (SELECT p.ticker, p.period_end, greatest(r.results_ts, min(p.accepted)) AS public_ts FROM pos p JOIN res r ON r.ticker = p.ticker AND r.period_end = p.period_end WHERE is_current_period GROUP BY p.ticker, p.period_end, r.results_ts)
SELECT s.ticker, CAST(s.period_end AS VARCHAR) AS period_end, count(*) FILTER (WHERE t.ticker <> s.ticker AND s.public_ts < t.results_ts) AS opportunities FROM src s LEFT JOIN (SELECT res.* FROM res SEMI JOIN (SELECT DISTINCT ticker FROM cal WHERE cik < {A.LISTED}) l ON l.ticker = res.ticker) t ON t.period_end = s.period_end GROUP BY ALL""")
def timing_opportunities(spark, sf):
    pos = A.positions(spark, sf)
    cal = A.calendar(pos)
    results = E.calendar(cal)
    now = pos.filter("is_current_period").groupBy("ticker", "period_end").agg(F.min("accepted").alias("accepted")).join(results, ["ticker", "period_end"])
    sources = now.select("ticker", "period_end", V.later(F.col("results_ts"), F.col("accepted")).alias("public_ts"))
    return E.opportunities(results, sources, A.listed(cal)).select("ticker", *text("period_end"), "opportunities")
