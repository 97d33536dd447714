import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import eligibility as E
from ledgerloom.operators import evaluation as EV
from ledgerloom.operators import facilities as FA
from ledgerloom.operators import guards as G
from ledgerloom.operators import lineage as L
from ledgerloom.operators import matching as M
from ledgerloom.operators import overlap as O
from ledgerloom.operators import reporting as R
from ledgerloom.operators import revisions as V
from ledgerloom.operators import sampling as S
from ledgerloom.operators import variants as VA
from ledgerloom.sources import readers, writers

SCHEMA = (
    "facility_row_id string, archive_id string, adsh string, accepted timestamp, cik long, ticker string, period_end date, observation_date date, is_current_period boolean, investment_identifier string, borrower_raw string, borrower_norm string,"
    "debt_equity string, facility_type string, lien string, currency string, reference_rate string, spread double, total_interest_rate double, pik_rate double, maturity date, funded_status string, acquisition_date date, principal double, cost double, fair_value double, non_accrual boolean, restructuring_flag boolean"
)
Q3, Q2, Q1 = dt.date(2025, 9, 30), dt.date(2025, 6, 30), dt.date(2025, 3, 31)
BASE = {
    "facility_row_id": "row-0", "archive_id": "2025q4", "adsh": "f-17", "accepted": dt.datetime(2025, 10, 27, 9, 30), "cik": 1, "ticker": "AAA", "period_end": Q3, "observation_date": Q3, "is_current_period": True,
    "investment_identifier": "Harbor Mills Second Lien Note", "borrower_raw": "Harbor Mills GmbH", "borrower_norm": "harbor mills", "debt_equity": "debt", "facility_type": "note_or_bond", "lien": "second_lien", "currency": "EUR",
    "reference_rate": "EURIBOR", "spread": 0.0425, "total_interest_rate": 0.07, "pik_rate": None, "maturity": dt.date(2030, 4, 12), "funded_status": "funded", "acquisition_date": dt.date(2019, 5, 20), "principal": 640.0, "cost": 631.0, "fair_value": 608.0, "non_accrual": False, "restructuring_flag": False,
}


def table(spark, *changes):
    return spark.createDataFrame([tuple((BASE | c)[n.strip().split(" ")[0]] for n in SCHEMA.split(",")) for c in changes], SCHEMA)


def row(i, **c):
    return {"facility_row_id": f"row-{i}", **c}


def test_lots_are_summed(spark):
    """Lots that differ in an amount or a date add up; a row that repeats a lot does not count again."""
    rows = [row("p"), row("q", principal=160.0, cost=150.0, fair_value=152.0), row("r", principal=None, fair_value=None), row("s"), row("t", acquisition_date=dt.date(2021, 2, 2))]
    (got,) = FA.aggregate(table(spark, *rows)).collect()
    assert (got.principal, got.cost, got.fair_value, got.source_row_ids) == (1440.0, 2043.0, 1368.0, ["row-p", "row-q", "row-r", "row-t"])
    assert got.source_row_count == 4 and got.mark_fv_to_principal == pytest.approx(0.95) and got.acquisition_date == dt.date(2019, 5, 20)


def test_keys_are_exact(spark):
    """A row that differs in any one part of the key is a facility of its own."""
    parts = {
        "adsh": "f-18", "observation_date": Q2, "borrower_norm": "harbor", "debt_equity": "equity", "facility_type": "warrant", "lien": "unknown", "currency": "USD", "reference_rate": "UNKNOWN", "spread": 0.0426,
        "maturity": None, "funded_status": "unknown", "investment_identifier": "Harbor Mills Second Lien Note, Class X",
    }
    assert set(FA.KEY) - {"tranche"} == set(parts) - {"investment_identifier"}
    rows = [row(0), *[row(i, **{c: v}) for i, (c, v) in enumerate(parts.items(), 1)]]
    assert FA.aggregate(table(spark, *rows)).count() == len(rows)
    nothing_told = {"investment_identifier": "Harbor, Mills Inc", "principal": 5.0}
    assert FA.aggregate(table(spark, row("x", **nothing_told), row("y", **nothing_told))).count() == 2


def test_issuer_totals(spark):
    bare = {"principal": None, "facility_type": "unknown", "lien": "unknown", "reference_rate": "UNKNOWN", "spread": None, "maturity": None}
    rows = table(spark, row("a"), row("total", **bare), row("equity", **bare, debt_equity="equity"), row("other", **bare, borrower_norm="another"), row("blank", **bare, borrower_norm=""))
    got = {r.facility_row_id: r.is_issuer_total for r in FA.issuer_totals(rows).collect()}
    assert got == {"row-a": False, "row-total": True, "row-equity": False, "row-other": False}


def test_weighted_mean_and_mark(spark):
    rows = table(spark, row(1, spread=0.02, principal=300.0), row(2, spread=0.06, principal=None, cost=-100.0), row(3, spread=None), row(4, spread=0.04, principal=0.0, cost=0.0))
    assert rows.agg(FA.weighted_mean("spread").alias("m")).first().m == pytest.approx((0.02 * 300 + 0.06 * 100 + 0.04) / 401)
    assert rows.filter("false").agg(FA.weighted_mean("spread").alias("m")).first().m is None
    marks = table(spark, row(1, principal=512.0, fair_value=480.0), row(1, principal=512.0, fair_value=480.0), row(2, principal=128.0, fair_value=112.0))
    assert FA.mark_of(marks, ["ticker"]).first().mark == pytest.approx(592 / 640)
    FA.validate(FA.aggregate(rows))
    with pytest.raises(ValueError):
        FA.validate(FA.aggregate(table(spark, row(1, principal=float("inf")))))


def test_holdings_are_normalised(spark):
    raw = spark.createDataFrame(
        [("x", "20250930", "Quillon, Inc. First Lien Term Loan", "First Lien", "SOFR", "0.05", "2028-10-01", "1,000", "990", "985", "7"), ("x", "20250930", "", "", "", "", "", "1", "1", "1", "8"), ("x", "20250930", "Lone", "", "", "", "", "1", "", "", "9")],
        "adsh string, ddate string, `Investment, Identifier Axis` string, `Investment Type Axis` string, RateType string, `Investment, Basis Spread, Variable Rate` string, `Investment Maturity Date` string, `Investment Owned, Balance, Principal Amount` string, `Adjusted cost basis` string, `Initial fair value of Investment` string, line string",
    )
    subs = spark.createDataFrame([("x", dt.datetime(2025, 11, 1), 1, "AAA", "A", "10-Q", "2025-11-01", Q3)], "adsh string, accepted timestamp, cik long, ticker string, filer_name string, form string, filed string, period_end date")
    (got,) = FA.normalize_holdings(raw, subs, F.lit("2025q4"), F.col("line")).collect()
    assert (got.borrower_norm, got.lien, got.facility_type, got.raw_provenance, got.principal, got.is_current_period) == ("quillon", "first_lien", "term_loan", "2025q4:7", 1000.0, True)
    assert got.source_concepts["fair_value"] == "Initial fair value of Investment" and got.currency == "UNKNOWN"


def pair(spark, **c):
    left = row("a")
    right = row("b", ticker="BBB", cik=2, **c)
    return M.compare(M.candidate_pairs(table(spark, left, right))).first()


def test_pairs(spark):
    p = pair(spark)
    assert (p.predicted_label, p.match_confidence, p.hard_conflicts, p.informative_matches) == ("same_facility", "high", [], 8)
    p = pair(spark, lien="first_lien")
    assert (p.predicted_label, p.match_confidence, p.hard_conflicts) == ("same_borrower_different_facility", "high", ["lien"])
    p = pair(spark, lien="unknown", reference_rate="UNKNOWN")
    assert p.lien_match is None and p.predicted_label == "same_facility"
    p = pair(spark, spread=0.0625)
    assert (p.hard_conflicts, p.match_confidence, p.evidence[-1]) == (["spread_gt_100bp"], "medium", "conflict:spread_gt_100bp")
    p = pair(spark, spread=0.0475)
    assert p.spread_match_25bp is False
    assert M.candidate_pairs(table(spark, row("a"), row("b"))).count() == 0  # one fund
    assert M.candidate_pairs(table(spark, row("a"), row("b", cik=2, is_current_period=False))).count() == 0
    generic = M.compare(M.candidate_pairs(table(spark, row("a", borrower_norm="cash"), row("b", cik=2, borrower_norm="cash")))).first()
    assert (generic.predicted_label, generic.match_confidence) == ("unrelated", "high")
    swapped = M.swap_sides(M.compare(M.candidate_pairs(table(spark, row("a"), row("b", cik=2)))), F.lit(True)).first()
    assert (swapped.left_facility_row_id, swapped.right_facility_row_id) == ("row-b", "row-a")


def test_strict_predicate(spark):
    def fits(**c):
        both = M.side(table(spark, row("a")), "l_").join(M.side(table(spark, row("b", **c)), "r_"), F.col("l_borrower_norm") == F.col("r_borrower_norm"))
        return both.filter(M.strict_same_facility("l_", "r_")).count() == 1

    assert fits() and fits(lien="unknown") and fits(spread=None, maturity=None) and fits(maturity=dt.date(2030, 5, 27))
    assert not fits(maturity=dt.date(2030, 5, 28)) and not fits(lien="first_lien") and not fits(spread=0.0475)
    unknown = {c: "unknown" for c in M.CATEGORIES}
    assert not fits(**unknown) and fits(**(unknown | {"lien": "second_lien"}))


def holdings(spark, *more):
    """A source that files first, a target that files later, and their rows of the quarter before."""
    rows = [
        row("s1", accepted=dt.datetime(2025, 10, 24)), row("s0", period_end=Q2, observation_date=Q2, accepted=dt.datetime(2025, 7, 24), fair_value=576.0), row("t0", ticker="BBB", cik=2, period_end=Q2, observation_date=Q2, accepted=dt.datetime(2025, 8, 1), fair_value=592.0),
        row("t1", ticker="BBB", cik=2, accepted=dt.datetime(2025, 11, 5), fair_value=544.0), row("tt", ticker="BBB", cik=2, period_end=Q1, observation_date=Q1, accepted=dt.datetime(2025, 5, 5), fair_value=560.0), *more,
    ]
    return table(spark, *rows).withColumn("economic_facility_id", F.col("facility_row_id"))


def results(spark):
    cells = [("AAA", Q3, dt.datetime(2025, 10, 23)), ("BBB", Q3, dt.datetime(2025, 11, 4)), ("AAA", Q2, dt.datetime(2025, 7, 23)), ("BBB", Q2, dt.datetime(2025, 8, 1)), ("BBB", Q1, dt.datetime(2025, 5, 5))]
    return spark.createDataFrame(cells, "ticker string, period_end date, results_ts timestamp")


def tickers(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "ticker string")


def test_eligibility(spark):
    (o,) = E.eligible(holdings(spark), results(spark), tickers(spark, "AAA", "BBB")).collect()
    assert (o.source_facility_id, o.source_prior_facility_id, o.target_prior_facility_id) == ("row-s1", "row-s0", "row-t0")
    assert o.source_information_ts == dt.datetime(2025, 10, 24) and o.window_days == pytest.approx(11) and o.source_delta == pytest.approx(0.05) and o.movement_eligible
    twice = holdings(spark, row("t0b", ticker="BBB", cik=2, period_end=Q2, observation_date=Q2, accepted=dt.datetime(2025, 8, 1)))
    assert E.eligible(twice, results(spark), tickers(spark, "AAA", "BBB")).count() == 0  # two priors are none
    late = results(spark).withColumn("results_ts", F.when((F.col("ticker") == "BBB") & (F.col("period_end") == Q3), F.lit("2025-10-24 00:00:00").cast("timestamp")).otherwise(F.col("results_ts")))
    assert E.eligible(holdings(spark), late, tickers(spark, "BBB")).count() == 0  # not strictly before
    names = spark.createDataFrame([("harbor mills",)], "borrower_norm string")
    assert E.eligible(holdings(spark), results(spark), tickers(spark, "BBB"), excluded=names).count() == 0
    keys = spark.createDataFrame([("harbor mills", "AAA", "BBB", "2025Q3")], "borrower_norm string, source_ticker string, target_ticker string, quarter string")
    assert E.eligible(holdings(spark), results(spark), tickers(spark, "BBB"), quarantined=keys).count() == 0


def test_funnel(spark):
    codes = lambda rows, r=results(spark), t=("AAA", "BBB", "CCC"): {(x.economic_facility_id, x.target): x.loss_code for x in E.losses(rows, r, tickers(spark, *t)).collect()}
    got = codes(holdings(spark))
    assert got["row-s1", "BBB"] == "eligible" and got["row-s1", "CCC"] == "A" and got["row-t1", "AAA"] == "F" and got["row-tt", "AAA"] == "A"
    r = results(spark).unionByName(spark.createDataFrame([("CCC", Q3, dt.datetime(2025, 11, 4))], "ticker string, period_end date, results_ts timestamp"))
    assert codes(holdings(spark), r)["row-s1", "CCC"] == "C"
    lonely = row("z", borrower_norm="lonely")
    vague = row("v", **{c: "unknown" for c in M.CATEGORIES}, spread=None, maturity=None)
    got = codes(holdings(spark, lonely, vague), r)
    assert got["row-z", "BBB"] == "G" and got["row-v", "BBB"] == "B"
    funnel = {x.loss_code: (x.n, x.pct) for x in E.loss_funnel(E.losses(holdings(spark), results(spark), tickers(spark, "AAA", "BBB"))).collect()}
    assert sum(n for n, _ in funnel.values()) == 5 and sum(p for _, p in funnel.values()) == pytest.approx(100)


def test_funnel_of_odd_tables(spark):
    """No verified results: every pair is A. Repeated and null listed funds count once and never; without any there are no pairs."""
    rows, r = holdings(spark), results(spark)
    coded = lambda r, t: sorted((x.economic_facility_id, x.target, x.loss_code) for x in E.losses(rows, r, t).collect())
    odd = spark.createDataFrame([("AAA",), ("BBB",), ("BBB",), (None,)], "ticker string")
    assert coded(r, odd) == coded(r, tickers(spark, "AAA", "BBB"))
    assert {c for *_, c in coded(r.limit(0), odd)} == {"A"}
    assert coded(r, odd.limit(0)) == []
    assert E.losses(rows.limit(0), r, odd).count() == 0


def test_counts_are_those_of_the_pairs(spark):
    """Over funds listed or not, with and without results, holders, tags, matches and own priors."""
    import random

    rng = random.Random(11)
    funds = [f"F{i}" for i in range(7)]
    more = [
        row(f"r{i}", ticker=rng.choice([*funds, None]), cik=3, period_end=(q := rng.choice([Q1, Q2, Q3])), observation_date=q, accepted=dt.datetime(q.year, q.month, 28) + dt.timedelta(days=rng.randint(1, 50)),
            borrower_norm=rng.choice(["harbor mills", "oak", "other", "elm"]), lien=rng.choice(["first_lien", "second_lien", "unknown"]), facility_type=rng.choice(["term_loan", "revolver", "unknown"]),
            spread=rng.choice([None, 0.05, 0.06]), maturity=None, debt_equity=rng.choice(["debt", "equity", "unknown"]), reference_rate=rng.choice(["SOFR", "UNKNOWN"]))
        for i in range(160)
    ]
    rows = holdings(spark, *more)
    cells = [(f, q, dt.datetime(q.year, q.month, 28) + dt.timedelta(days=rng.randint(5, 45))) for f in funds for q in (Q1, Q2, Q3) if rng.random() < 0.8]
    r = results(spark).unionByName(spark.createDataFrame(cells, "ticker string, period_end date, results_ts timestamp"))
    t, gone = tickers(spark, "AAA", "BBB", *funds[:5], "ZZZ"), spark.createDataFrame([("elm",)], "borrower_norm string")
    seen = set()
    for excluded in (None, gone):
        matches = E.match_table(rows, r).cache()
        pairs = E.losses(rows, r, t, excluded, matches).cache()
        found = E.loss_counts(rows, r, t, excluded, matches)
        plain = lambda df: sorted(map(tuple, df.collect()))
        assert plain(found.counts) == plain(pairs.groupBy("ticker", "period_end", "loss_code").count())
        assert plain(found.with_prior) == plain(pairs.filter("own_prior").groupBy("ticker", "period_end").agg(F.count_distinct("economic_facility_id")))
        reached = pairs.filter("loss_code in ('F', 'eligible')").groupBy("target", "period_end").agg(F.count_distinct("target_prior_id"))
        assert plain(found.target_priors) == plain(reached)
        assert plain(E.loss_funnel(found.counts)) == plain(E.loss_funnel(pairs)) and plain(E.modal_loss(found.counts)) == plain(E.modal_loss(pairs))
        seen |= {x.loss_code for x in pairs.select("loss_code").distinct().collect()}
    assert seen == {*"ABCDEFG", "eligible"}


def test_pair_counts(spark):
    """Counts of groups are those of the pairs themselves."""
    import random

    rng = random.Random(4)
    rows = table(spark, *[
        row(f"r{i}", ticker=f"F{(c := rng.randint(1, 4))}", cik=c, period_end=(q := rng.choice([Q2, Q3])), observation_date=q, borrower_norm=rng.choice(["harbor mills", "oak", "other", "alone" if i == 0 else "elm tree"]),
            lien=rng.choice(["first_lien", "second_lien", "unknown"]), facility_type=rng.choice(["term_loan", "unknown"]), spread=rng.choice([None, 0.05, 0.0515, 0.07]), maturity=rng.choice([None, dt.date(2030, 1, 1), dt.date(2030, 3, 1), dt.date(2031, 1, 1)]))
        for i in range(120)
    ])
    pairs = M.compare(M.candidate_pairs(rows))
    sides = pairs.select("period_end", "informative_matches", "predicted_label", "match_confidence", F.explode(F.array(*[F.struct(F.col(f"{s}_ticker").alias("ticker"), F.col(f"{s}_facility_row_id").alias("id")) for s in ("left", "right")])).alias("s"))
    want = sides.select("*", "s.*").groupBy("ticker", "period_end").agg(
        F.count_distinct("id").alias("entering"), F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("informative_matches") >= 3).alias("informative_pairs"),
        F.count_if((F.col("predicted_label") == "same_facility") & (F.col("match_confidence") == "high")).alias("predicted_same"))
    got = M.pair_counts(rows).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("predicted_same > 0").count()


def test_copies_meet_as_groups(spark):
    """2,000 copies in each of two quarters are one pair of groups, not 4,000,000 of rows; and the single match beside them is found."""
    many = table(spark, *[row(f"{q.month}-{i}", period_end=q, observation_date=q) for q in (Q2, Q3) for i in range(2000)], row("alone", period_end=Q2, observation_date=Q2, borrower_norm="oak"), row("now", borrower_norm="oak"))
    many = many.withColumn("economic_facility_id", F.col("facility_row_id"))
    now, before, met = E._priors(many, True)
    assert sorted(x.match_count for x in met.pairs.collect()) == [1, 2000]
    assert [(x.s_economic_facility_id, x.p_economic_facility_id) for x in E.unique_priors(many).collect()] == [("row-now", "row-alone")]
    assert E.prior_matches(many.filter("substring_index(facility_row_id, '-', -1) < '12'")).filter("match_count > 1").count() > 10


def test_matches_of_odd_rows(spark):
    """Matches by groups, cells of spreads and incomplete rows against every pair of rows compared."""
    import random

    rng = random.Random(21)
    spreads = [None, 0.0, -0.0, 0.05, 0.0525, 0.0475, 0.055, 0.045, -0.05, 1e300, float("nan"), float("inf"), 0.049999999, 0.0500000001]
    rows = table(spark, *[
        row(f"r{i}", ticker=rng.choice(["AAA", "BBB", "CCC", None]), period_end=(q := rng.choice([Q1, Q2, Q3])), observation_date=q, borrower_norm=rng.choice(["harbor mills", "oak"]),
            accepted=dt.datetime(2025, 10, rng.randint(1, 9)), is_current_period=rng.random() < 0.95, lien=rng.choice(["first_lien", "first_lien", "unknown", None]), facility_type=rng.choice(["term_loan", "term_loan", ""]),
            debt_equity=rng.choice(["debt", "debt", "equity"]), reference_rate=rng.choice(["SOFR", "UNKNOWN", "PRIME"]), spread=rng.choice(spreads), maturity=rng.choice([None, dt.date(2030, 1, 1), dt.date(2030, 2, 10)]))
        for i in range(260)
    ]).withColumn("economic_facility_id", F.col("facility_row_id")).cache()
    now = rows.filter("is_current_period")
    s, p = M.side(now.withColumn("prior_end", F.last_day(F.add_months("period_end", -3))), "s_"), M.side(now, "p_")
    every = s.join(p, (F.col("s_prior_end") == F.col("p_period_end")) & (F.col("s_borrower_norm") == F.col("p_borrower_norm"))).filter(M.strict_same_facility("s_", "p_")).cache()
    from pyspark.sql import Window

    shown = ["s_economic_facility_id", "p_economic_facility_id", "match_count"]
    plain = lambda df, *c: sorted((tuple(x) for x in df.select(*(c or shown)).collect()), key=str)
    for same_fund in (True, False):
        want = every.filter("s_ticker = p_ticker") if same_fund else every
        want = want.withColumn("match_count", F.count(F.lit(1)).over(Window.partitionBy("s_economic_facility_id", "p_ticker")))
        for few in (10**6, 0):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(M, "FEW_PAIRS", few)
                assert plain(E.prior_matches(rows, same_fund)) == plain(want) != []
                assert plain(E.unique_priors(rows, same_fund)) == plain(want.filter("match_count = 1")) != []
    first = every.filter("p_accepted <= s_accepted").groupBy("s_economic_facility_id").agg(F.min("p_economic_facility_id"), F.count(F.lit(1)))
    assert plain(VA.first_prior(rows), "economic_facility_id", "prior_id", "n_matches") == plain(first, *first.columns) != []
    turned = every.filter("s_ticker = p_ticker").groupBy("p_economic_facility_id").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) == 1, F.any_value(F.col("s_fair_value") / F.col("s_principal"))))
    assert plain(EV.outcomes(rows), "economic_facility_id", "matches", "actual") == plain(turned, *turned.columns) != []


def test_sample_makes_its_rows_once(spark):
    """Counting the population and drawing from it read the rows in one pass."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def keep(_):
        made.add(1)
        return True

    assert S.simple_sample(spark.range(100).filter(keep("id")), "id", 5, 1, least=5).count() == 5
    assert made.value == 100


def test_facilities_are_validated_where_stored(spark, monkeypatch):
    """validated_facilities makes its facilities once, not again for each thing it asks of them."""
    from ledgerloom.plans import cases

    seen = []
    monkeypatch.setattr(FA, "validate", seen.append)
    cases.validated_facilities(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_lookups_of_some_rows(spark):
    """Lenders and outcomes of named rows are what those rows get among all."""
    rows = holdings(spark, row("u1", ticker="CCC", cik=3))
    for f in (EV.prior_lenders, EV.outcomes):
        every = {x.economic_facility_id: x for x in f(rows).collect()}
        assert every
        for name in every:
            only = spark.createDataFrame([(name,), ("absent",)], "economic_facility_id string")
            assert f(rows, only).collect() == [every[name]]


def test_evaluation(spark):
    obs = E.eligible(holdings(spark), results(spark), tickers(spark, "AAA", "BBB"))
    (e,) = EV.evaluate(holdings(spark), obs).collect()
    assert (e.b0, e.b1, e.b2, e.b3, e.b4, e.actual) == tuple(pytest.approx(x) for x in (0.925, 0.975, 0.95, 0.95, 0.90, 0.85))
    assert e.adjusted == pytest.approx(0.975) and e.adjusted_error_pp == pytest.approx(12.5) and e.matches == 1 and not e.disappeared and e.bucket == ">3d"
    gone = holdings(spark).filter("facility_row_id != 'row-t1'")
    (e,) = EV.evaluate(gone, obs).collect()
    assert e.disappeared and e.actual is None and e.b0_error_pp is None


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("b", "y", None), ("b", "z", 8.0)], "borrower string, cluster string, e double")
    m = EV.error_metrics(rows, ["e"]).first()
    assert (m.n, m.mae, m.median_error) == (3, 4.0, 3.0) and m.rmse == pytest.approx((74 / 3) ** 0.5)
    loo = {r.borrower: (r.n_rows, r.e) for r in EV.leave_one_out(rows, "borrower", ["e"]).collect()}
    assert loo == {"a": (2, 8.0), "b": (2, 2.0)}
    c = EV.cluster_means(rows, ["cluster"], ["e"]).first()
    assert (c.clusters, c.e) == (3, 5.0)
    predicted = spark.createDataFrame([(0.9, 0.96, 0.91), (None, 0.5, 0.75)], "s double, p double, a double")
    from ledgerloom.functions.values import error_pp

    got = [tuple(r) for r in predicted.select(error_pp(F.col("p"), F.col("a")), error_pp(F.col("s"), F.col("a"))).collect()]
    assert got == [(pytest.approx(5.0), pytest.approx(1.0)), (pytest.approx(25.0), None)]


def test_precision(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (1, 1)], "truth int, called int")
    r = EV.precision_recall(rows, F.col("truth") == 1, F.col("called") == 1).first()
    assert (r.tp, r.fp, r.fn, r.gate) == (2, 1, 1, False) and r.precision == pytest.approx(2 / 3)
    r = EV.precision_recall(rows.limit(0), F.col("truth") == 1, F.col("called") == 1).first()
    assert (r.tp, r.precision, r.gate) == (0, None, False)


def test_as_of(spark):
    ev = spark.createDataFrame([(1, "k", 10), (2, "k", 20), (3, "k", 20), (4, "j", 5), (5, "k", 30)], "id long, k string, t long")
    hist = spark.createDataFrame([("k", 10, "a"), ("k", 15, "b"), ("k", 20, "c"), ("k", 20, "d")], "k string, t long, v string")
    got = {r.id: (r.status, r.prior_value) for r in E.as_of(ev, hist, ["k"], "t", F.col("v"), "id").collect()}
    assert got == {1: ("none", None), 2: ("found", "b"), 3: ("found", "b"), 4: ("none", None), 5: ("ambiguous", None)}


def test_lineage(spark):
    keys = "archive_id string, adsh string, observation_date string, identifier string"
    cand = spark.createDataFrame([("a", "x", "d", "i", "currency", "usd", "1"), ("a", "x", "d", "i", "reference_rate", "SOFR", "1"), ("a", "x", "d", "j", "reference_rate", "SOFR", "1"), ("a", "x", "d", "j", "reference_rate", "Prime", "2"), ("a", "x", "d", "j", "maturity", "soon", "2")], keys + ", field string, value string, source string")
    fixes = L.corrections(L.normalized(cand))
    assert {(r.identifier, r.field, r.value) for r in fixes.collect()} == {("i", "currency", "USD"), ("i", "reference_rate", "SOFR")}
    rows = spark.createDataFrame([("a", "x", "d", "i", "UNKNOWN", "LIBOR"), ("a", "x", "d", "j", "EUR", "")], keys + ", currency string, reference_rate string")
    done = L.repair(rows, fixes, ["currency", "reference_rate"])
    got = {r.identifier: (r.currency, r.currency_repair, r.reference_rate, r.reference_rate_repair) for r in done.collect()}
    assert got == {"i": ("USD", "filled", "SOFR", "replaced"), "j": ("EUR", None, "", None)}
    counts = {r.field: (r.before, r.after, r.filled, r.replaced, r.matched) for r in L.repair_counts(done, ["currency", "reference_rate"]).collect()}
    assert counts == {"currency": (1, 2, 1, 0, 1), "reference_rate": (1, 1, 0, 1, 1)}


def test_facts(spark):
    tags = spark.createDataFrame([("InvestmentMaturityDate", "v", None, None), ("Other", "v", None, None)], "tag string, version string, tlabel string, doc string")
    nums = spark.createDataFrame([("x", "InvestmentMaturityDate", "v", "20250930", "InvestmentIdentifierAxis=Loan A();CurrencyAxis=USD()", "20281001"), ("x", "Other", "v", "20250930", None, "1"), ("y", "InvestmentMaturityDate", "v", "20250930", "InvestmentIdentifierAxis=B", "20281001")], "adsh string, tag string, version string, ddate string, segments string, value string")
    subs = spark.createDataFrame([("x", "2025q4")], "adsh string, archive_id string")
    got = {(r.identifier, r.field, r.value) for r in L.facts(nums, tags, subs).collect()}
    assert got == {("Loan A", "maturity", "2028-10-01"), ("Loan A", "currency", "USD")}


def test_sampling(spark):
    rows = spark.range(260).selectExpr("concat('p', id) as pair_id", "if(id < 100, 'same_facility', if(id < 180, 'same_borrower_different_facility', 'uncertain')) as predicted_label", "if(id < 180, 'high', 'low') as match_confidence")
    one = S.stratified_sample(rows, "pair_id", S.candidate_stratum(), {"predicted_same_facility_high": 60, "hard_same_borrower_different_facility": 30, "uncertain_alias_distractor": 30}, 7, total=240)
    ids = sorted(r.pair_id for r in one.collect())
    assert len(ids) == len(set(ids)) == 240
    again = S.stratified_sample(rows.repartition(5), "pair_id", S.candidate_stratum(), {"predicted_same_facility_high": 60, "hard_same_borrower_different_facility": 30, "uncertain_alias_distractor": 30}, 7, total=240)
    assert sorted(r.pair_id for r in again.collect()) == ids
    assert S.simple_sample(rows, "pair_id", 15, 3).count() == 15
    with pytest.raises(ValueError):
        S.simple_sample(rows, "pair_id", 15, 3, least=1000)
    public, private = S.blind(rows, ["predicted_label"], ["match_confidence"], 1, "pair_id")
    assert public.columns == ["blind_id", "predicted_label"] and private.count() == 260
    with pytest.raises(ValueError):
        S.blind(rows, ["match_confidence"], ["match_confidence"], 1, "pair_id")
    fixtures = rows.limit(3)
    assert S.with_fixtures(rows, "pair_id", fixtures, 10, 1).count() == 10
    assert S.python_sample([f"i{k}" for k in range(20)], 5, 20260813) == S.python_sample([f"i{k}" for k in reversed(range(20))], 5, 20260813)


FORECAST = "Code string, DiscNo string, DocType string, DiscDate string, DiscTime string, CurFYSt string, CurFYEn string, FSales string, FOP string, FOdP string, FNP string"


def test_revisions(spark):
    base = ("1301", "2025-04-01", "2026-03-31")
    rec = lambda no, kind, day, time, v, start=base[1]: (base[0], no, kind, day, time, start, base[2], *v)
    records = spark.createDataFrame([
        rec("1", "Annual", "2025-05-01", "15:00", ("100", "10", "8", "3")), rec("2", "Rev", "2025-08-01", "15:00", ("90", "-5", "-4", "-2")),
        rec("3", "Rev", "2025-09-01", "15:00", ("1", "1", "1", "1"), start="2024-04-01"), rec("4", "Rev", "2025-10-01", "15:00", ("1", "1", "1", None)),
    ], FORECAST)
    events = spark.createDataFrame([("e1", "1301", "2025-08-01 15:00"), ("e2", "1301", "2025-08-02 15:00"), ("e3", "1301", "2025-09-01 15:00"), ("e4", "1301", "2025-10-01 15:00")], "event_id string, code string, ts string")
    got = {r.event_id: r for r in V.reconstruct(events, records, ["Rev"]).collect()}
    assert {k: r.status for k, r in got.items()} == {"e1": "recovered", "e2": "revision_record_not_found", "e3": "prior_outside_window", "e4": "incomplete_new_forecast"}
    assert (got["e1"].old_revenue, got["e1"].new_revenue, got["e1"].basis, got["e1"].direction) == ("100", "90", "consolidated", "downward")
    titles = spark.createDataFrame([("業績予想の修正に関するお知らせ",), ("業績予想の修正及び配当予想",), ("その他",)], "t string")
    assert [r[0] for r in titles.select(V.clean_event(F.col("t"))).collect()] == [True, False, False]
    tries = spark.createDataFrame([("e1", 1, 404, 0, "missing"), ("e1", 2, 200, 900, "ok"), ("e2", 1, 200, 100, "short")], "event_id string, attempt_order int, http_status int, content_bytes int, result string")
    status = {r.event_id: (r.attempts, r.succeeded, r.last_result) for r in V.attempt_status(tries).collect()}
    assert status == {"e1": (2, 1, "ok"), "e2": (1, 0, "short")}
    rows = spark.createDataFrame([("e1", "pending"), ("e2", "pending"), ("e3", "pending"), ("e4", "recovered")], "event_id string, status string")
    assert {r.event_id: r.status for r in V.advance(rows, V.attempt_status(tries)).collect()} == {"e1": "archived", "e2": "archive_failed", "e3": "pending", "e4": "recovered"}


def test_reporting(spark):
    grid = spark.createDataFrame([("AAA", 1, Q3), ("BBB", 2, Q3), ("CCC", 3, Q3)], "ticker string, cik long, period_end date")
    filings = spark.createDataFrame([
        ("AAA", "1", Q3, "10-Q", Q3, dt.datetime(2025, 11, 6, 21), "0001-25-1", "a.htm", None, None), ("AAA", "1", Q3, "8-K", None, dt.datetime(2025, 11, 5, 12), "0001-25-2", "b.htm", "2.02", EXHIBIT),
        ("BBB", "2", Q3, "10-Q", Q3, dt.datetime(2025, 11, 7, 14), "0002-25-1", "c.htm", None, None), ("CCC", "3", Q3, "10-Q", Q3, dt.datetime(2026, 3, 1), "0003-25-1", "d.htm", None, None),
    ], "ticker string, cik string, period_end date, form string, report_date date, accepted timestamp, accession string, primary_document string, items string, raw string")
    judged = R.results_candidates(filings)
    assert judged.count() == 1
    cal = {r.ticker: r for r in R.reporting_calendar(grid, judged, R.periodic_candidates(filings)).collect()}
    assert (cal["AAA"].verification_status, cal["AAA"].lag_days, cal["AAA"].market_session) == ("verified_exhibit_content", 36, "pre-market")
    assert cal["BBB"].verification_status == "verified_periodic_filing_fallback" and cal["CCC"].verification_status == "explicit_missing" and cal["CCC"].acceptance_timestamp_utc is None


EXHIBIT = "<DOCUMENT><TYPE>EX-99.1\n<FILENAME>x.htm\n<TEXT>Results for September 30, 2025: net investment income $1.0, net asset value 14.2</TEXT></DOCUMENT>"


def test_aliases_and_layers(spark):
    sample = spark.createDataFrame([("q", "acme widgets"), ("q", "zzzz")], "period_end string, borrower_norm string")
    target = spark.createDataFrame([("q", "acme widgets international"), ("q", "acmee widget"), ("q", "other"), ("p", "acme widgets")], "period_end string, borrower_norm string")
    found = {(r.left_name, r.right_name) for r in O.alias_candidates(sample, target).collect()}
    assert found == {("acme widgets", "acme widgets international"), ("acme widgets", "acmee widget"), ("zzzz", None)}
    assert O.top_aliases(O.alias_candidates(sample, target), 1).filter("left_name = 'acme widgets'").count() == 1


def test_names_meet_for_every_row(spark):
    rows = [(i, "b", name) for i, name in enumerate(["acme steel", "acme steel", "acme brass", "other", "steel acme wire"] + ["common wire"] * 40)] + [(99, "c", "acme steel"), (100, None, "acme steel")]
    got = sorted((r.id, r.other, round(r.jaccard, 6), r.members) for r in O.name_similarity(spark.createDataFrame(rows, "id long, block string, name string"), "id", "name", ["block"]).collect())
    want = []
    for i, block, name in rows:
        for other in {n for _, b, n in rows if b == block and b is not None}:
            a, b = set(name.split()), set(other.split())
            members = sum(b == block and n == other and j != i for j, b, n in rows)
            if a & b and members:
                want.append((i, other, round(len(a & b) / len(a | b), 6), members))
    assert got == sorted(want) and len(got) < 45 * 5


def test_alias_query_searches_every_block(spark):
    import difflib

    from ledgerloom.plans.registry import queries

    sf = "/root/testdata/sf0.001"
    names: dict = {}
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        names.setdefault(r.p_brand, set()).add(r.p_name.lower())
    rows = queries()["alias_topk"](spark, sf).collect()
    found: dict = {}
    for r in rows:
        found.setdefault((r.period_end, r.left_name), []).append(r)
    per = {b: sum(k[0] == b for k in found) for b in names}
    assert per == {b: min(30, len(own)) for b, own in names.items()}
    for (block, left), own in found.items():
        near = [n for n in names[block] if difflib.SequenceMatcher(None, left, n).ratio() >= 0.72]
        assert len(own) >= min(12, len(near)) and sorted(r["rank"] for r in own) == list(range(1, len(own) + 1))


def test_rows_without_alias_stay_and_blocks_rank_apart(spark):
    sample = spark.createDataFrame([("p", "acme widgets"), ("q", "acme widgets"), ("q", "zzzz")], "period_end string, borrower_norm string")
    target = spark.createDataFrame([("q", "acme widgets one"), ("p", "acme widgets two")], "period_end string, borrower_norm string")
    got = {(r.period_end, r.left_name, r.right_name) for r in O.top_aliases(O.alias_candidates(sample, target), 1).collect()}
    assert got == {("p", "acme widgets", "acme widgets two"), ("q", "acme widgets", "acme widgets one"), ("q", "zzzz", None)}


def test_letters_never_rule_out_an_alias(spark):
    import difflib
    import random

    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc d") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abc d") for _ in range(rng.randint(0, 12)))) for _ in range(600)] + [("", ""), ("a", ""), ("ab", "ba")]
    got = spark.createDataFrame(pairs, "l string, r string").select("l", "r", O.may_be_alias(F.col("l"), F.col("r")).alias("may")).collect()
    near = [r for r in got if difflib.SequenceMatcher(None, r.l, r.r).ratio() >= 0.72]
    assert near and all(r.may for r in near) and sum(r.may for r in got) < 300


def test_alias_keys_lose_no_alias(spark):
    """Over random names of all lengths, the pairs found are those of brute force, and far fewer meet than there are."""
    import difflib
    import random

    from ledgerloom.functions import text as X

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9)))
    names = {" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"", "a", "ab", "abc", "bca", "holdings", "capital holdings"}
    for n in list(names):
        for _ in range(2):
            own = list(n)
            for _ in range(rng.randint(1, max(1, len(n) // 3))):
                if own:
                    own[rng.randrange(len(own))] = rng.choice("abcdefghijklmnop ")
            names.add("".join(own)[rng.choice([0, 0, 1]) :])
    rows = [(rng.choice(["p", "q"]), n) for n in sorted(names)]
    df = spark.createDataFrame([*rows, (None, "abc"), ("p", None)], "period_end string, borrower_norm string").cache()
    found = {(r.period_end, r.left_name, r.right_name) for r in O.alias_candidates(df, df).filter("right_name is not null").collect()}
    tokens = lambda n: {t for t in n.split() if len(t) >= 4 and t not in X.GENERIC_TOKENS}

    def alias(a, b):
        both, any_ = tokens(a) & tokens(b), tokens(a) | tokens(b)
        near = difflib.SequenceMatcher(None, a, b).ratio() >= 0.72
        return near or bool(a and b and (a in b or b in a)) or bool(any_) and len(both) / len(any_) >= 0.5 or any(len(t) >= 6 for t in both)

    want = {(p, a, b) for p, a in rows for q, b in rows if p == q and alias(a, b)}
    assert found == want
    plain = df.dropna().select(F.col("period_end").alias("block"), F.col("borrower_norm").alias("name")).distinct()
    assert len(want) <= O.alias_keys_met(plain, plain).count() < sum(p == q for p, _ in rows for q, _ in rows) / 2


def test_fund_profile_names_the_universe(spark):
    rows = holdings(spark)
    existing = rows.filter("cik = 1")
    moved = rows.select("cik").distinct()
    got = {r.cik: r for r in O.fund_profile(rows, moved, existing, ["lien"], most=1, universe="the list").collect()}
    assert not got[1].recommended and got[1].exclusion_reason.startswith("already in the list") and "already" not in got[2].exclusion_reason


def test_frozen_ids_and_seed(spark):
    import hashlib

    ids = spark.createDataFrame([("b",), ("ä",), ("a",)], "id string")
    want = hashlib.sha256('["a","b","ä"]'.encode()).hexdigest()
    assert G.id_list_digest(ids, "id") == want and G.require_ids(ids, "id", want) is ids
    with pytest.raises(RuntimeError):
        G.require_ids(ids, "id", "0")
    with pytest.raises(ValueError):
        G.id_list_digest(ids, "id", most=2)
    digest, seed = S.derived_seed("cafe", "p")
    assert digest == hashlib.sha256(b"pcafe").hexdigest() and seed == int(digest[:16], 16)
    G.unique_key(ids, ["id"])
    with pytest.raises(ValueError):
        G.unique_key(ids.unionByName(ids), ["id"])
    assert readers.sized(ids, 3) is ids
    with pytest.raises(ValueError):
        readers.sized(ids, 4)


def test_as_of_of_a_busy_key(spark):
    """A key with a million rows is the work of several tasks, and its values run over their borders."""
    from ledgerloom import shared

    n = 1_000_000
    rows = spark.range(n).select(F.when(F.col("id") % 50 == 0, "rare").otherwise("busy").alias("k"), F.timestamp_seconds("id").alias("t"), F.col("id").alias("v"))
    events = rows.withColumn("id", F.col("v"))
    sparse = rows.filter("v % 300000 = 7")  # most partitions hold no value of their own
    parts = shared.sorted_parts(rows, [F.col("k"), F.col("t")], "busy")
    sizes = [r["count"] for r in parts.filter("k = 'busy'").groupBy("_part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < n / 2
    got = E.as_of(events, sparse, ["k"], "t", F.col("v"), "id")
    want = F.when((F.col("k") == "busy") & (F.col("id") > 7), F.floor((F.col("id") - 8) / 300_000) * 300_000 + 7)
    assert got.count() == n and got.filter(~want.eqNullSafe(F.col("prior_value"))).count() == 0


def test_as_of_odd_values(spark):
    at = lambda s: dt.datetime(2025, 1, 1, 0, 0, s)
    hist = spark.createDataFrame([("a", at(1), 5), ("a", at(3), 5), ("a", at(3), 6), ("a", at(4), None), (None, at(1), 9)], "k string, t timestamp, v int")
    ev = spark.createDataFrame([("e1", "a", at(1)), ("e2", "a", at(2)), ("e3", "a", at(4)), ("e4", "a", at(5)), ("e5", None, at(2)), ("e6", "b", at(2)), ("e7", "a", None)], "id string, k string, t timestamp")
    got = {r.id: (r.status, r.prior_value) for r in E.as_of(ev, hist, ["k"], "t", F.col("v"), "id").collect()}
    assert got == {"e1": ("none", None), "e2": ("found", 5), "e3": ("ambiguous", None), "e4": ("ambiguous", None), "e5": ("found", 9), "e6": ("none", None), "e7": ("none", None)}
    assert E.as_of(ev.limit(0), hist, ["k"], "t", F.col("v"), "id").count() == 0


def test_gaps_without_pairs(spark):
    """Counts and quartiles by search are those of the pairs."""
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["q1", "q2", "q3", None]), rng.choice([None, *[dt.datetime(2025, 1, 1) + dt.timedelta(hours=rng.choice([1, 7, 24]) * rng.randint(0, 30), microseconds=rng.choice([0, 0, 1, 999])) for _ in range(8)]]), f"f{i}") for i in range(90)]
    rows += [("alone", dt.datetime(2025, 1, 1), "x"), ("tie", dt.datetime(2025, 1, 1), "x"), ("tie", dt.datetime(2025, 1, 1), "y"), ("two", dt.datetime(2025, 1, 1), "x"), ("two", dt.datetime(2025, 1, 4), "y")]
    df = spark.createDataFrame(rows, "g string, t timestamp, m string")
    plain = lambda x: sorted((r.g or "", r.n_pairs, *[round(v, 9) for v in (r.p25, r.median, r.p75)], r.over_1d, r.over_3d, r.over_5d) for r in x.collect())
    assert plain(R.gap_counts(df, "g", "t")) == plain(R.gap_summary(R.reporting_gaps(df, "g", "t", "m"), "g"))
    assert R.gap_counts(df.filter("g in ('alone', 'tie')"), "g", "t").count() == R.gap_counts(df.limit(0), "g", "t").count() == 0


def test_a_written_table_is_profiled_in_that_pass(spark, tmp_path):
    from ledgerloom.operators import profiling

    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    rows = spark.range(50).select("id", F.when(F.col("id") % 3 == 0, "unknown").when(F.col("id") % 5 == 0, None).otherwise("x").alias("lien")).mapInPandas(counted, "id long, lien string")
    got = profiling.write_profiled(rows, str(tmp_path / "t"), ["id", "lien", "absent"]).collect()
    present = sum(i % 3 != 0 and i % 5 != 0 for i in range(50))
    assert sorted(map(tuple, got)) == [("absent", 50, 0), ("id", 50, 50), ("lien", 50, present)]
    assert runs.value == 50 and spark.read.parquet(str(tmp_path / "t")).count() == 50
    with pytest.raises(Exception):
        profiling.write_profiled(rows, str(tmp_path / "t"), ["id"])
    none = profiling.write_profiled(rows.limit(0), str(tmp_path / "none"), ["id"]).collect()
    assert [tuple(r) for r in none] == [("id", 0, 0)]


def test_a_failed_guard_leaves_nothing(spark, tmp_path):
    """A guarded table is computed once; refused, broken or existing outputs leave the folder as it was."""
    import os

    from ledgerloom.sources import writers

    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(len(b))
            if (b["id"] > 900).any():
                raise RuntimeError("broken")
            yield b

    rows = lambda n: spark.range(n).mapInPandas(counted, "id long")
    where = str(tmp_path / "out")
    writers.write_guarded(rows(40), f"{where}/good", F.col("id") == 99)
    assert runs.value == 40 and spark.read.parquet(f"{where}/good").count() == 40
    for n, odd in ((40, F.col("id") == 3), (1000, F.lit(False))):
        with pytest.raises(Exception):
            writers.write_guarded(rows(n), f"{where}/bad", odd)
    with pytest.raises(FileExistsError):
        writers.write_guarded(rows(5), f"{where}/good", F.lit(False))
    with pytest.raises(ValueError):
        writers.write_csv(rows(0), f"{where}/none", ["id"])
    assert [x for x in os.listdir(where) if not x.startswith(".")] == ["good"] and spark.read.parquet(f"{where}/good").count() == 40


MOVES = {("pending", "ok"): "archived", ("pending", "bad"): "failed", ("failed", "ok"): "archived", ("archived", "bad"): "checked", ("checked", "bad"): "failed"}


def test_attempts_lead_to_a_status(spark):
    """Ordered by place, in whatever order and however often rows come; a busy key is many tasks."""
    import random

    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randint(0, 30), rng.choice(["ok", "bad", "odd", None])) for _ in range(200)]
    rows += rows[:50]
    rng.shuffle(rows)
    want = {}
    for k in {k for k, _, _ in rows}:
        own, status, changes = sorted({(at, o is not None, o or "") for x, at, o in rows if x == k}), "pending", 0
        for _, _, o in own:
            to = MOVES.get((status, o), status)
            changes, status = changes + (to != status), to
        want[k] = (status, len(own), changes)
    df = spark.createDataFrame(rows, "k string, place int, outcome string").repartition(7)
    assert {r.k: (r.status, r.attempts, r.changes) for r in V.settle(df, "k", ["place"], "outcome", MOVES, "pending").collect()} == want
    assert V.settle(df.limit(0), "k", ["place"], "outcome", MOVES, "pending").count() == 0
    busy = spark.range(300_000).select(F.lit("busy").alias("k"), "id", F.when(F.col("id") % 3 == 0, "ok").otherwise("bad").alias("outcome"))
    status, changes = "pending", 0
    for i in range(300_000):
        to = MOVES.get((status, "ok" if i % 3 == 0 else "bad"), status)
        changes, status = changes + (to != status), to
    assert [tuple(r) for r in V.settle(busy, "k", ["id"], "outcome", MOVES, "pending").collect()] == [("busy", status, 300_000, changes)]


def test_payloads_of_unknown_shape(spark):
    from ledgerloom.sources import readers

    texts = [
        '{"FSales": 12, "FOP": "3", "FNP": null}', '{"FSales": "", "FNCSales": 7.5}', '{"FSales": [1], "FOP": {"a": 1}}', '{"FNCNP2Q": true}', "[]", "{}", "no json", None, '{"FSales2Q": "1", "FNCSales": "2"}',
    ]
    got = [r.p for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", V.variant_payload(F.col("t")).alias("p")).orderBy("i").collect()]
    assert [None if p is None else tuple(p) for p in got] == [
        ("FY", "consolidated", "12", "3", None, None), ("FY", "standalone", "7.5", None, None, None), None, ("2Q", "standalone", None, None, None, "true"), None, None, None, None, ("FY", "standalone", "2", None, None, None),
    ]
    odd = spark.createDataFrame([(1, '{"recent": {"n": [1, 2], "f": ["a"]}}'), (2, '{"recent": {"n": 5}}'), (3, '{"other": 1}'), (4, None), (5, '{"recent": {"f": [null, "z"]}}')], "id int, t string")
    rows = readers.variant_arrays(odd, "t", "$.recent", ["n", "f"]).collect()
    assert sorted((r.id, r.place, r.n, r.f) for r in rows) == sorted([(1, 0, "1", "a"), (1, 1, "2", None), (5, 0, None, None), (5, 1, None, "z")])


def test_names_in_texts(spark, monkeypatch):
    """Each text is read once by all names of its keys, in chunks and parts of any size."""
    import random

    rng = random.Random(8)
    words = ["oak", "elm", "oak elm", "elm oak ash", "ash", "k e", "birch"]
    texts = [(rng.choice(["a", "b", None]), i, rng.choice([None, "", *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(6)]])) for i in range(60)]
    names = [(k, w) for k in ("a", "b", None) for w in [*words, "oak", "none of it", ""] if k != "b" or w != "oak"]
    for size, part in ((32 << 20, 50_000), (200, 2)):
        monkeypatch.setattr(R, "TEXT_BYTES", size)
        monkeypatch.setattr(R, "NAMES", part)
        got = R.first_places(spark.createDataFrame(texts, "k string, id int, text string"), spark.createDataFrame(names, "k string, name string"), ["k"], "text", "name", 5, 9)
        assert got.columns == ["k", "id", "name", "window"]
        want = {(k, i, n, t[max(0, t.find(n) - 5) : t.find(n) + len(n) + 9]) for k, i, t in texts for o, n in names if k and k == o and n and t and n in t}
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert R.first_places(spark.createDataFrame([], "k string, id int, text string"), spark.createDataFrame(names, "k string, name string"), ["k"], "text", "name").count() == 0


def test_marks_in_exhibits(spark):
    rows = holdings(spark).filter("facility_row_id in ('row-s1', 'row-t1')")
    said = "Consolidated Schedule&nbsp;of Investments: Harbor Mills, second lien note, fair value 608"
    shown = [("AAA", Q3, dt.datetime(2025, 10, 1), "n1", "x.htm", said), ("BBB", Q3, dt.datetime(2025, 10, 1), "n2", "y.htm", said), ("AAA", Q2, dt.datetime(2025, 10, 1), "n3", "z.htm", said), ("AAA", Q3, dt.datetime(2025, 10, 2), "n4", "v.htm", "Harbor Mills second lien 608")]
    exhibits = spark.createDataFrame(shown, "ticker string, period_end date, accepted timestamp, accession string, filename string, text string")
    assert [(r.accession, r.economic_facility_id) for r in R.exhibit_marks(exhibits, rows).collect()] == [("n1", "row-s1")]


def test_a_record_without_a_fiscal_end_has_no_prior(spark):
    rec = lambda no, kind, day, end: ("1301", no, kind, day, "15:00", "2025-04-01", end, "5", "4", "3", "2")
    records = spark.createDataFrame([rec("1", "Annual", "2025-05-01", ""), rec("2", "Rev", "2025-08-01", ""), rec("3", "Annual", "2025-05-01", "2026-03-31"), rec("4", "Rev", "2025-09-01", "2026-03-31"), rec("5", "Rev", "2025-09-02", "2026-03-31")], FORECAST)
    events = spark.createDataFrame([("e2", "1301", "2025-08-01 15:00"), ("e4", "1301", "2025-09-01 15:00"), ("e5", "1301", "2025-09-02 15:00")], "event_id string, code string, ts string")
    got = {r.event_id: (r.status, r.old_disc_no) for r in V.reconstruct(events, records, ["Rev"]).collect()}
    assert got == {"e2": ("ambiguous_old_forecast", None), "e4": ("recovered", "3"), "e5": ("recovered", "4")}


def test_scratch_tables_are_refused_off_a_local_master_and_released(spark):
    import os

    from ledgerloom import shared

    kept = shared.materialize(spark.range(3).toDF("id"), "t")
    path = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    shared.release(spark)
    assert not os.path.exists(path)

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(RuntimeError):
        shared.shared_folder(Cluster)


def test_scratch_tables_go_with_their_owner(spark):
    from ledgerloom import shared

    kept = shared.materialize(spark.range(3), "kept")
    with shared.scratch(spark):
        outer = shared.materialize(spark.range(5), "outer")
        with shared.scratch(spark):
            inner = shared.materialize(spark.range(7), "inner")
            assert inner.count() == 7
        assert outer.count() == 5
        with pytest.raises(Exception):
            inner.count()
    with pytest.raises(Exception):
        outer.count()
    assert kept.count() == 3


def test_guards(spark):
    a, b = spark.range(3), spark.range(1, 4)
    assert {(r.id, r.only_in) for r in G.same_members(a, b).collect()} == {(0, "left"), (3, "right")}
    with pytest.raises(ValueError):
        G.require_same(a, b)
    with pytest.raises(ValueError):
        G.require_columns(a, {"x"})
    with pytest.raises(RuntimeError):
        G.require_hash(b"x", "0")
    assert G.ids_digest(a, "id").first() == G.ids_digest(a.repartition(3), "id").first() != G.ids_digest(b, "id").first()


def test_archives_as_a_source(spark, tmp_path):
    """Rows, numbers and hashes are those of zip_rows; columns are pruned; a wrong hash is refused."""
    from ledgerloom.sources import archives

    submissions = "adsh\tcik\tname\tform\tperiod\taccepted\tfiled\n"
    for q in ("2025q3", "2025q4"):
        with zipfile.ZipFile(tmp_path / f"{q}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a/one.tsv", "\ufeff" + submissions + "".join(f"{q}-{i}\t{i}\tÉ {i}\t10-Q\t20250930\t\t20251101\n" for i in range(25_000)))
            z.writestr("two.tsv", "adsh\tddate\tInvestment, Identifier Axis\tInvestment Owned, Fair Value\nx\t20250930\tTern Bay LLC\t95\n")
    (tmp_path / "notes.txt").write_text("no archive")
    plain = readers.zip_rows(spark, str(tmp_path / "*.zip"), "submissions")
    got = archives.archive_rows(spark, str(tmp_path), "submissions")
    assert got.rdd.getNumPartitions() == 2 and got.schema == plain.schema
    key = ["archive_id", "sha256", "member", "line_number"]
    told = lambda df: df.select(*key, F.to_json("fields").alias("f"))
    assert told(got).exceptAll(told(plain)).isEmpty() and got.count() == plain.count() == 50_000
    few = archives.archive_rows(spark, f"file://{tmp_path}/2025q4.zip", "submissions", ["name", "accepted", "absent"])
    assert few.columns == [*key, "name", "accepted", "absent"] and few.filter("accepted is null and absent is null").count() == 25_000
    assert few.filter("line_number = 3").first().name == "É 1"
    sha = {r.archive_id: r.sha256 for r in got.select("archive_id", "sha256").distinct().collect()}
    assert archives.archive_rows(spark, str(tmp_path), "holdings", ["adsh"], sha).count() == 2
    with pytest.raises(Exception):
        archives.archive_rows(spark, str(tmp_path), "holdings", ["adsh"], sha | {"2025q4": "0"}).count()
    with pytest.raises(Exception):
        archives.archive_rows(spark, str(tmp_path / "none"), "holdings").count()


@pytest.mark.parametrize("kind", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_an_archive_is_never_in_memory(tmp_path, kind):
    """Eighty megabytes of rows, packed or not, are read with a few."""
    import tracemalloc

    from ledgerloom.sources import archives

    with zipfile.ZipFile(tmp_path / "big.zip", "w", kind) as z, z.open("one.tsv", "w", force_zip64=True) as member:
        member.write(b"adsh\tcik\tname\tform\tperiod\taccepted\tfiled\n")
        for i in range(160):
            member.write(b"".join(b"%08d\t%d\t%s\t10-Q\t20250930\t20251101\t20251101\n" % (i, j, b"n" * 450) for j in range(1000)))
    with zipfile.ZipFile(tmp_path / "big.zip", "a", kind) as z:
        z.writestr("two.tsv", "adsh\tddate\tInvestment, Identifier Axis\nx\t1\tT\n")
    reader = archives.ArchiveReader({"role": "submissions", "path": str(tmp_path / "big.zip"), "columns": '["adsh"]'})
    (own,) = reader.partitions()
    tracemalloc.start()
    n = sum(batch.num_rows for batch in reader.read(own))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 160_000 and peak < 24 << 20


def test_archives_and_sinks(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("one.tsv", "adsh\tcik\tname\tform\tperiod\taccepted\tfiled\nx\t0000001\tA\t10-Q\t20250930\t2025-11-01 10:00:00\t20251101\ny\t2\tB\t8-K\t20250930\t2025-11-01 10:00:00\t20251101\n")
        z.writestr("two.tsv", "adsh\tddate\tInvestment, Identifier Axis\tInvestment Owned, Fair Value\tAdjusted cost basis\nx\t20250930\tTern Bay LLC\t95\t96\n")
    (tmp_path / "2025q4.zip").write_bytes(buffer.getvalue())
    rows = readers.zip_rows(spark, str(tmp_path / "*.zip"), "submissions")
    wide = readers.widen(rows, sorted(readers.SUBMISSION))
    universe = spark.createDataFrame([(1, "AAA")], "cik long, ticker string")
    (s,) = readers.submissions(wide, universe).collect()
    assert (s.ticker, s.period_end, s.accepted) == ("AAA", Q3, dt.datetime(2025, 11, 1, 10))
    holdings = readers.zip_rows(spark, str(tmp_path / "*.zip"), "holdings").first()
    assert holdings.line_number == 2 and holdings.fields["Investment, Identifier Axis"] == "Tern Bay LLC" and holdings.archive_id == "2025q4"
    with pytest.raises(ValueError):
        readers.identify_members({"a": ["x"]})
    sha = {"2025q4": rows.first().sha256}
    assert readers.zip_rows(spark, str(tmp_path / "*.zip"), "submissions", sha).count() == 2
    with pytest.raises(Exception, match="is expected"):
        readers.zip_rows(spark, str(tmp_path / "*.zip"), "submissions", {"2025q4": "0"}).count()
    # the whole chain, from an archive to facility rows
    wide_holdings = readers.widen(readers.zip_rows(spark, str(tmp_path / "*.zip"), "holdings").drop("archive_id"), ["adsh", "ddate", "Investment, Identifier Axis", "Investment Owned, Fair Value", "Adjusted cost basis"])
    (f,) = FA.normalize_holdings(wide_holdings, readers.submissions(wide, universe), F.lit("2025q4"), F.col("line_number")).collect()
    assert (f.borrower_norm, f.fair_value, f.ticker, f.raw_provenance) == ("tern bay", 95.0, "AAA", "2025q4:2")
    (tmp_path / "sub").mkdir()
    with pytest.raises(ValueError):
        writers.write_csv(spark.createDataFrame([], "id int"), str(tmp_path / "sub" / "none"), ["id"])
    with pytest.raises(ValueError):
        writers.write_guarded(spark.range(3), str(tmp_path / "sub" / "odd"), F.col("id") == 2)
    writers.write_guarded(spark.range(3), str(tmp_path / "sub" / "even"), F.col("id") == 7)
    writers.write_pair(spark.range(2), spark.range(3), str(tmp_path / "sub" / "pair"))
    assert [spark.read.parquet(str(tmp_path / "sub" / p)).count() for p in ("even", "pair/public", "pair/private")] == [3, 2, 3]
    with pytest.raises(Exception):
        writers.write_table(spark.range(3), str(tmp_path / "sub" / "even"))
    writers.write_table(spark.range(4), str(tmp_path / "sub" / "even"), replace=True)
    assert spark.read.parquet(str(tmp_path / "sub" / "even")).count() == 4
    writers.write_summary(spark.range(1), str(tmp_path / "sub" / "summary"))
    assert '"id": 0' in "".join(r.value for r in spark.read.text(str(tmp_path / "sub" / "summary")).collect())
    out = spark.createDataFrame([(2, True, None, ["a"]), (1, False, "x", [])], "id int, ok boolean, t string, l array<string>")
    writers.write_csv(out, str(tmp_path / "csv"), ["id", "ok", "t", "l"], ["id"])
    back = readers.read_table(spark, str(tmp_path / "csv"), ["id", "ok", "t", "l"])
    assert [tuple(r) for r in back.orderBy("id").collect()] == [("1", "False", "x", "[]"), ("2", "True", None, '["a"]')]
    assert '"id": 1' in writers.summary_json(out)
    with pytest.raises(Exception):
        writers.write_csv(out, str(tmp_path / "csv"), ["id"])
    payload = spark.createDataFrame([("1", ([1, 2], ["a", "b"]))], "cik string, recent struct<n:array<int>,f:array<string>>")
    assert [(r.n, r.f) for r in readers.unzip_arrays(payload, ["n", "f"]).collect()] == [(1, "a"), (2, "b")]


def test_streams(spark, tmp_path):
    from ledgerloom.streaming import events as ST

    ev = spark.createDataFrame([(1, "a", dt.datetime(2025, 1, 1)), (1, "a", dt.datetime(2025, 1, 1, 1)), (2, "b", dt.datetime(2025, 1, 2))], "user_id int, event_type string, ts timestamp")
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = ST.first_events(stream, ["user_id", "event_type"], "ts").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2
    q = ST.windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.event_type, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def test_projections(spark):
    from pyspark.sql import types as T

    from ledgerloom.operators import projections as P

    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    template = T.StructType([T.StructField("t", T.StringType()), T.StructField("n", T.LongType()), T.StructField("id", T.IntegerType())])
    assert [tuple(r) for r in P.with_defaults(rows, template, {"t": "x"}).orderBy("id").collect()] == [("a", None, 1), ("x", None, 2)]
    assert P.migrate(rows, template).columns == ["id", "t", "n"]
    with pytest.raises(ValueError):
        P.migrate(rows, T.StructType([T.StructField("id", T.StringType())]))
    kept = P.preserve(rows, spark.createDataFrame([(2, "old")], "id int, t string"), ["id"])
    assert sorted(map(tuple, kept.collect())) == [(1, "a"), (2, "old")]
    assert P.supersede(rows, "void", "late").filter("status = 'void'").count() == 2
    assert sorted(r.label for r in P.fan_out(rows, {"all": F.lit(True), "one": F.col("id") == 1}).collect()) == ["all", "all", "one"]
    with pytest.raises(ValueError):
        P.allow(rows, ["id"], ["id"])


def test_index_pages(spark):
    page = spark.createDataFrame([([("1", "業績予想の修正", "1301 x"), ("2", "other", "1302"), ("3", "業績予想の修正", "none")],)], "items array<struct<id:string,title:string,company_code:string>>")
    assert [(r.id, r.security_code) for r in readers.event_items(page, "業績予想の修正").collect()] == [("1", "1301")]
    html = spark.createDataFrame([('<a href="?CIK=0000000123&x">Alpha Fund</a><a href="?CIK=0000000124">Beta</a>',)], "html string")
    assert [tuple(r) for r in readers.company_matches(html, ["alpha fund"]).collect()] == [("0000000123", "Alpha Fund")]
    assert html.select(readers.links(F.col("html"), "CIK").alias("l")).first().l == ["?CIK=0000000123&x", "?CIK=0000000124"]
