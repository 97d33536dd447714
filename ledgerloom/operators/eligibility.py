"""Point-in-time joins: prior-quarter matches, eligible observations, losses on the way, movement."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.operators import matching as M
from ledgerloom.shared import broadcast_if_small, last_before, materialize, sorted_parts

MOVEMENT = 0.005
LOSSES = {
    "A": "A_missing_reporting_calendar", "B": "B_weak_XBRL_tagging", "C": "C_borrower_matching", "D": "D_facility_matching",
    "E": "E_missing_prior_quarter_position", "F": "F_insufficient_reporting_window", "G": "G_limited_19_fund_universe",
}
FACILITY = ("economic_facility_id", "ticker", "cik", "period_end", "borrower_norm", "accepted", *M.CATEGORIES, "spread", "maturity", "principal", "fair_value")


def latest_by_key(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """A value for each key: that of the last row in an order."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def calendar(rows: DataFrame) -> DataFrame:
    """ticker, period_end, results_ts of the periods whose results have a verified time."""
    known = rows.filter((F.col("verification_status") != "explicit_missing") & F.col("acceptance_timestamp_utc").isNotNull())
    return known.groupBy("ticker", "period_end").agg(F.max("acceptance_timestamp_utc").alias("results_ts"))


def with_results(facilities: DataFrame, results: DataFrame) -> DataFrame:
    """facilities with the time of the fund's results and public_ts, when the row was known to all."""
    met = facilities.join(results.select("ticker", "period_end", "results_ts"), ["ticker", "period_end"], "left")
    return met.withColumn("public_ts", V.later(F.col("results_ts"), F.col("accepted")))


def _priors(facilities: DataFrame, same_fund: bool) -> tuple[DataFrame, DataFrame, M.Met]:
    """Current rows (s_*), the rows that may be their priors (p_*), and which groups of them meet.

    Both sides are read from one table of groups."""
    now = facilities.filter("is_current_period")
    before = lambda df: df.withColumn("prior_end", V.previous_quarter_end(F.col("period_end")))
    groups = materialize(M.alike(now, ["period_end", "borrower_norm", "ticker"]), "alike")
    keys = [("s_prior_end", "p_period_end"), ("s_borrower_norm", "p_borrower_norm"), *([("s_ticker", "p_ticker")] if same_fund else [])]
    return M.side(before(now), "s_"), M.side(now, "p_"), M.met_groups(M.side(before(groups), "s_"), M.side(groups, "p_"), keys, ["p_ticker"])


def prior_matches(facilities: DataFrame, same_fund: bool = True) -> DataFrame:
    """Each current row (s_*) with all rows (p_*) of the quarter before that are strictly the same facility,
    of the same fund or of any, and match_count, the number for the row and fund. economic_facility_id is unique."""
    return M.all_matches(*_priors(facilities, same_fund))


def unique_priors(facilities: DataFrame, same_fund: bool = True) -> DataFrame:
    """Of prior_matches() those whose match_count is 1, without making the others. The rows are read three
    times, so they are worth storing."""
    return M.unique_matches(*_priors(facilities, same_fund))


#: What the match table tells of each side.
SIDE = ("economic_facility_id", "ticker", "cik", "public_ts", "mark")


def match_table(facilities: DataFrame, results: DataFrame) -> DataFrame:
    """Current rows with their unique prior matches, at most one in each fund: s_* and p_* of SIDE, and the
    source's period, borrower and results. What looks at unique priors reads this table, so that it is
    worth storing: it is narrow, and has no row for matches that are not unique."""
    rows = with_results(facilities.select(*FACILITY, "is_current_period"), results).withColumn("mark", V.mark(None, F.col("fair_value"), F.col("principal")))
    met = unique_priors(rows, same_fund=False)
    return met.select(*[f"{p}{c}" for p in ("s_", "p_") for c in SIDE], "s_period_end", "s_borrower_norm", "s_results_ts")


def eligible(facilities: DataFrame, results: DataFrame, listed: DataFrame, excluded: DataFrame | None = None, quarantined: DataFrame | None = None, prefix: str = "SN3X_", matches: DataFrame | None = None) -> DataFrame:
    """Observations (source row, target fund) that could be predicted from what was public before the target's results.

    The source has one prior row of its own fund; so has the target, and both were public before the
    source, which in turn was public before the target's results. The target's current row is never read.
    listed holds the tickers of targets, excluded borrower names and quarantined 4-part keys to leave out;
    matches is match_table(), where that has been stored."""
    matches = match_table(facilities, results) if matches is None else matches
    priors = matches.filter(F.col("s_results_ts").isNotNull())
    if excluded is not None:
        priors = priors.join(excluded.select(F.col("borrower_norm").alias("s_borrower_norm")), "s_borrower_norm", "left_anti")
    own = priors.filter((F.col("s_ticker") == F.col("p_ticker")) & (F.col("p_public_ts") < F.col("s_public_ts")))
    other = priors.filter((F.col("s_ticker") != F.col("p_ticker")) & (F.col("p_public_ts") < F.col("s_public_ts")))
    other = other.join(listed.select(F.col("ticker").alias("p_ticker")), "p_ticker", "left_semi")
    other = other.select("s_economic_facility_id", F.col("p_economic_facility_id").alias("t_id"), F.col("p_ticker").alias("t_ticker"), F.col("p_cik").alias("t_cik"), F.col("p_public_ts").alias("t_prior_public_ts"))
    cutoffs = results.select(F.col("ticker").alias("t_ticker"), F.col("period_end").alias("s_period_end"), F.col("results_ts").alias("cutoff_ts"))
    met = own.join(other, "s_economic_facility_id").join(cutoffs, ["t_ticker", "s_period_end"]).filter(F.col("s_public_ts") < F.col("cutoff_ts"))
    now, before = F.col("s_mark"), F.col("p_mark")
    delta = now - before
    out = met.select(
        F.concat(F.lit(prefix), V.stable_id(F.col("s_period_end"), F.col("s_economic_facility_id"), F.col("p_economic_facility_id"), F.col("t_id"), F.col("t_ticker"), length=28)).alias("observation_id"),
        F.col("s_period_end").alias("period_end"), V.quarter_label(F.col("s_period_end")).alias("quarter"), F.col("s_borrower_norm").alias("borrower_norm"),
        F.col("s_ticker").alias("source_ticker"), F.col("t_ticker").alias("target_ticker"), F.col("s_cik").alias("source_cik"), F.col("t_cik").alias("target_cik"),
        F.col("s_economic_facility_id").alias("source_facility_id"), F.col("p_economic_facility_id").alias("source_prior_facility_id"), F.col("t_id").alias("target_prior_facility_id"),
        F.col("s_public_ts").alias("source_information_ts"), F.col("t_prior_public_ts").alias("target_prior_public_ts"), F.col("cutoff_ts").alias("target_cutoff_ts"),
        (V.hours_between(F.col("s_public_ts"), F.col("cutoff_ts")) / 24).alias("window_days"), now.alias("source_mark"), before.alias("source_prior_mark"),
        delta.alias("source_delta"), F.coalesce(F.abs(delta) >= MOVEMENT, F.lit(False)).alias("movement_eligible"),
    )
    if quarantined is not None:
        out = out.join(quarantined, ["borrower_norm", "source_ticker", "target_ticker", "quarter"], "left_anti")
    return out.dropDuplicates(["observation_id"])


def own_priors(facilities: DataFrame | None, matches: DataFrame | None = None) -> DataFrame:
    """Current rows with their unique prior row in the same fund, both with their marks."""
    if matches is not None:
        return matches.filter("s_ticker = p_ticker")
    return unique_priors(facilities.withColumn("mark", V.mark(None, F.col("fair_value"), F.col("principal"))))


def movements(facilities: DataFrame, threshold: float = MOVEMENT, matches: DataFrame | None = None) -> DataFrame:
    """Current rows whose mark moved since their unique prior row in the same fund."""
    return own_priors(facilities, matches).withColumn("delta", F.col("s_mark") - F.col("p_mark")).filter(F.abs("delta") >= threshold)


def movement_summary(observations: DataFrame) -> DataFrame:
    """Counts, distinct sources and quartiles of the reporting window for each quarter."""
    q = F.percentile("window_days", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    moved = lambda c: F.when(F.col("movement_eligible"), c)
    return observations.groupBy("quarter").agg(
        F.count(F.lit(1)).alias("eligible"), F.count("source_delta").alias("computable"), F.count_if("movement_eligible").alias("moved"),
        F.count_distinct(moved(F.struct("source_ticker", "source_facility_id"))).alias("moved_facilities"), F.count_distinct(moved(F.col("borrower_norm"))).alias("moved_borrowers"),
        F.array_sort(F.collect_set("source_ticker")).alias("source_tickers"), F.array_sort(F.collect_set("target_ticker")).alias("target_tickers"),
        F.get(q, 0).alias("p25"), F.get(q, 1).alias("median"), F.get(q, 2).alias("p75"),
    )


def _funds(listed: DataFrame) -> DataFrame:
    """The listed funds as target, each once."""
    return listed.select(F.col("ticker").alias("target")).filter("target is not null").distinct()


def _sources(facilities: DataFrame, results: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """Current rows with what their losses depend on."""
    rows = with_results(facilities.select(*FACILITY, "is_current_period").filter("is_current_period"), results)
    if excluded is not None:
        rows = rows.join(excluded.select("borrower_norm"), "borrower_norm", "left_anti")
    return rows.select("economic_facility_id", "ticker", "period_end", "borrower_norm", "results_ts", "public_ts", V.previous_quarter_end(F.col("period_end")).alias("prior_end"), M.tagging_ready().alias("ready"))


def _holders(facilities: DataFrame, funds: DataFrame) -> DataFrame:
    """prior_end, borrower_norm and target: the listed funds with a current row of the borrower in a period, each once."""
    held = facilities.filter("is_current_period").select(F.col("period_end").alias("prior_end"), "borrower_norm", F.col("ticker").alias("target"))
    return held.join(broadcast_if_small(funds), "target", "left_semi").distinct()


def _matched(matches: DataFrame, cutoffs: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """The pairs of a row and another listed fund in which it has a unique prior match, where both have results, with their code.

    That the fund held the borrower, and that the row is tagged (three features are known on both sides),
    is part of being a match; what is left is a generic name, the own prior row and the times."""
    same = F.col("s_ticker") == F.col("p_ticker")
    met = matches.withColumn("own_prior", F.max(F.when(same, True)).over(Window.partitionBy("s_economic_facility_id")))
    met = met.filter(~same & F.col("s_results_ts").isNotNull() & ~F.col("s_borrower_norm").isin(*M.GENERIC))
    if excluded is not None:
        met = met.join(excluded.select(F.col("borrower_norm").alias("s_borrower_norm")), "s_borrower_norm", "left_anti")
    met = met.join(cutoffs.select(F.col("target").alias("p_ticker"), F.col("period_end").alias("s_period_end"), "cutoff"), ["p_ticker", "s_period_end"])
    in_time = F.coalesce((F.col("p_public_ts") < F.col("s_public_ts")) & (F.col("s_public_ts") < F.col("cutoff")), F.lit(False))
    code = F.when(F.col("own_prior").isNull(), "E").when(~in_time, "F").otherwise("eligible")
    return met.select(F.col("s_economic_facility_id").alias("economic_facility_id"), F.col("s_ticker").alias("ticker"), F.col("s_period_end").alias("period_end"), F.col("p_ticker").alias("target"), F.col("p_economic_facility_id").alias("target_prior_id"), code.alias("loss_code"))


class Losses(NamedTuple):
    """counts: ticker, period_end, loss_code, n over all pairs of a current row and another listed fund.
    with_prior: ticker, period_end and the number of rows with a prior of their own.
    target_priors: the same of the target's prior rows in pairs that got as far as the times."""

    counts: DataFrame
    with_prior: DataFrame
    target_priors: DataFrame


def moved_by_ticker(observations: DataFrame) -> DataFrame:
    """quarter, source_ticker and the number of its facilities that moved, each facility once."""
    return observations.filter("movement_eligible").groupBy("quarter", "source_ticker").agg(F.count_distinct("source_facility_id").alias("moved_facilities"))


def loss_counts(facilities: DataFrame, results: DataFrame, listed: DataFrame, excluded: DataFrame | None = None, matches: DataFrame | None = None) -> Losses:
    """How many pairs of a current row and another listed fund each reason takes, without the pairs.

    Rows that agree in fund, period, borrower and tagging lose the same funds, so they are counted first.
    Of such a group's pairs, the funds without results in the period are A, of the rest all are B without
    tagging and all G without another holder, the funds that are no holders are C; and of the holders all
    are D but those with a match. Set sizes give each number; only matched pairs are rows, and they are
    coded one by one. Null tickers have no pairs; repeated rows count each time, repeated listed funds once.
    """
    funds = _funds(listed)
    dated = results.filter(F.col("results_ts").isNotNull()).select(F.col("ticker").alias("target"), "period_end", F.col("results_ts").alias("cutoff")).join(broadcast_if_small(funds), "target", "left_semi")
    rows = _sources(facilities, results, excluded)
    group = ["ticker", "period_end", "prior_end", "borrower_norm", "ready"]
    own = rows.filter("ticker is not null").groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.count("results_ts").alias("with_results"))
    own = materialize(own.join(funds.select(F.col("target").alias("ticker"), F.lit(1).alias("listed")), "ticker", "left").fillna(0, ["listed"]), "sources")
    periods = own.select("period_end", "prior_end").distinct()
    held = _holders(facilities, funds).join(F.broadcast(periods), "prior_end").join(dated.select("target", "period_end", F.lit(1).alias("is_dated")), ["target", "period_end"], "left")
    held = materialize(held.select("period_end", "borrower_norm", "target", F.coalesce("is_dated", F.lit(0)).alias("is_dated")).distinct(), "held")
    holders = held.groupBy("period_end", "borrower_norm").agg(F.count(F.lit(1)).alias("holders"), F.sum("is_dated").alias("dated_holders"))
    itself = held.select("period_end", "borrower_norm", F.col("target").alias("ticker"), F.lit(1).alias("holds"))
    wide = own.join(broadcast_if_small(dated.groupBy("period_end").agg(F.count(F.lit(1)).alias("dated"))), "period_end", "left").crossJoin(F.broadcast(funds.agg(F.count(F.lit(1)).alias("funds"))))
    wide = wide.join(holders, ["period_end", "borrower_norm"], "left").join(itself, ["period_end", "borrower_norm", "ticker"], "left").fillna(0, ["dated", "holders", "dated_holders", "holds"])
    # the row's own fund is no target; where the row has results, it is dated if listed
    all_funds, others = F.col("funds") - F.col("listed"), F.col("holders") - F.col("holds")
    later, held_later = F.col("dated") - F.col("listed"), F.col("dated_holders") - F.col("holds")
    known = F.col("with_results")
    tagged, shared = F.when(F.col("ready"), known).otherwise(0), F.col("ready") & (others > 0)
    parts = {
        "A": (F.col("rows") - known) * all_funds + known * (all_funds - later), "B": (known - tagged) * later, "G": F.when(others == 0, tagged * later).otherwise(0),
        "C": F.when(shared, known * (later - held_later)).otherwise(0), "D": F.when(shared, known * held_later).otherwise(0),
    }
    key = ["ticker", "period_end"]
    early = wide.select(*key, F.inline(F.array(*[F.struct(F.lit(c).alias("loss_code"), n.cast("long").alias("n")) for c, n in parts.items()]))).groupBy(*key, "loss_code").agg(F.sum("n").alias("n"))
    matches = match_table(facilities, results) if matches is None else matches
    coded = materialize(_matched(matches, dated, excluded), "matched_pairs")
    late = coded.groupBy(*key, "loss_code").agg(F.count(F.lit(1)).alias("n"))
    moved = late.groupBy(*key).agg((-F.sum("n")).alias("n")).select(*key, F.lit("D").alias("loss_code"), "n")
    counts = early.unionByName(late).unionByName(moved).groupBy(*key, "loss_code").agg(F.sum("n").alias("n")).filter("n > 0")
    prior = matches.filter("s_ticker = p_ticker").select(F.col("s_ticker").alias("ticker"), F.col("s_period_end").alias("period_end"), F.col("s_borrower_norm").alias("borrower_norm"), "s_economic_facility_id")
    if excluded is not None:
        prior = prior.join(excluded.select("borrower_norm"), "borrower_norm", "left_anti")
    prior = prior.join(counts.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count_distinct("s_economic_facility_id").alias("with_prior"))
    target = coded.filter(F.col("loss_code").isin("F", "eligible")).groupBy(F.col("target").alias("ticker"), "period_end").agg(F.count_distinct("target_prior_id").alias("target_priors"))
    return Losses(counts, prior, target)


def losses(facilities: DataFrame, results: DataFrame, listed: DataFrame, excluded: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """Each current row by every other listed fund, with the first reason why it gives no observation, or eligible.

    This is the list of pairs itself, as long as rows times funds; for counts of it take loss_counts().
    A period's pairs are made by a join on the period with the listed funds, which Spark splits where it is skewed."""
    rows = _sources(facilities, results, excluded)
    funds = _funds(listed)
    cutoffs = results.select(F.col("ticker").alias("target"), "period_end", F.col("results_ts").alias("cutoff"))
    targets = rows.select("period_end").distinct().crossJoin(funds).join(cutoffs, ["target", "period_end"], "left")
    held = _holders(facilities, funds)
    holders = held.groupBy("prior_end", "borrower_norm").agg(F.count(F.lit(1)).alias("holders"))
    itself = held.select("prior_end", "borrower_norm", F.col("target").alias("ticker"), F.lit(1).alias("holds"))
    matches = match_table(facilities, results) if matches is None else matches
    own = matches.filter("s_ticker = p_ticker").select(F.col("s_economic_facility_id").alias("economic_facility_id"), F.lit(True).alias("own_prior")).distinct()
    prior = matches.filter("s_ticker <> p_ticker").select(F.col("s_economic_facility_id").alias("economic_facility_id"), F.col("p_ticker").alias("target"), F.col("p_economic_facility_id").alias("target_prior_id"), F.col("p_public_ts").alias("target_public_ts"))
    wide = rows.join(own, "economic_facility_id", "left").join(holders, ["prior_end", "borrower_norm"], "left").join(itself, ["prior_end", "borrower_norm", "ticker"], "left").fillna(0, ["holders", "holds"])
    pairs = wide.join(targets, "period_end").filter("ticker <> target").join(held.withColumn("target_holds", F.lit(True)), ["prior_end", "borrower_norm", "target"], "left").join(prior, ["economic_facility_id", "target"], "left")
    in_time = (F.col("target_public_ts") < F.col("public_ts")) & (F.col("public_ts") < F.col("cutoff"))
    code = (
        F.when(F.col("results_ts").isNull() | F.col("cutoff").isNull(), "A").when(~F.col("ready"), "B").when(F.col("holders") == F.col("holds"), "G")
        .when(F.col("target_holds").isNull(), "C").when(F.col("target_prior_id").isNull(), "D").when(F.col("own_prior").isNull(), "E").when(~F.coalesce(in_time, F.lit(False)), "F").otherwise("eligible")
    )
    return pairs.select("economic_facility_id", "ticker", "period_end", "target", "own_prior", "target_prior_id", code.alias("loss_code"))


def _counted(coded: DataFrame) -> DataFrame:
    """The pairs of losses() as counts; counts stay as they are."""
    return coded if "n" in coded.columns else coded.groupBy("ticker", "period_end", "loss_code").agg(F.count(F.lit(1)).alias("n"))


def loss_funnel(coded: DataFrame) -> DataFrame:
    """Counts and percentages of the losses (pairs, or counts of them), over all pairs."""
    n = _counted(coded).groupBy("loss_code").agg(F.sum("n").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 3))


def modal_loss(coded: DataFrame) -> DataFrame:
    """The most frequent code of each fund and period; ties go to the first by name."""
    first = F.row_number().over(Window.partitionBy("ticker", "period_end").orderBy(F.desc("n"), "loss_code"))
    return _counted(coded).select("ticker", "period_end", "loss_code", "n").withColumn("_r", first).filter("_r = 1").drop("_r")


def completeness(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Percentage of rows with a known value, for each group and column."""
    shown = [F.round(100.0 * F.count_if(V.known(F.col(c).cast("string")).isNotNull()) / F.count(F.lit(1)), 3).alias(f"pct_{c}") for c in columns]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *shown)


def opportunities(results: DataFrame, sources: DataFrame, listed: DataFrame) -> DataFrame:
    """For each fund and period (ticker, period_end, public_ts) the listed funds whose results were still to come."""
    late = results.join(listed.select("ticker"), "ticker", "left_semi").select(F.col("ticker").alias("target"), "period_end", F.col("results_ts").alias("cutoff"))
    met = sources.join(late, "period_end", "left")
    return met.groupBy("ticker", "period_end").agg(F.count_if((F.col("target") != F.col("ticker")) & (F.col("public_ts") < F.col("cutoff"))).alias("opportunities"))


def bottlenecks(facilities: DataFrame, entering: DataFrame, lost: Losses, observations: DataFrame, calendar_rows: DataFrame, listed: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each fund and period of the calendar with what it holds, enters, matches and loses; no gap stays null.

    entering is matching.pair_counts() of the facilities. A source counts as public with its first current
    row, and its opportunities are the listed funds whose verified results came later. The first loss is
    the most frequent one."""
    grid = calendar_rows.select("ticker", "cik", "period_end").distinct()
    key = ["ticker", "period_end"]
    results = calendar(calendar_rows)
    status = listed.select("ticker", F.lit("listed").alias("listed_status"))
    first = facilities.filter("is_current_period").groupBy(*key).agg(F.min("accepted").alias("_accepted")).join(results, key)
    timing = opportunities(results, first.select(*key, V.later(F.col("results_ts"), F.col("_accepted")).alias("public_ts")), listed)
    verified = results.select(*key, F.lit(True).alias("verified_reporting_order_available"))
    held = facilities.groupBy(*key).agg(F.count(F.lit(1)).alias("aggregated_facilities"), F.count_if("is_current_period").alias("current_facilities"))
    shown = completeness(facilities.filter("is_current_period"), key, fields).drop("n_rows")
    ready = observations.groupBy(F.col("source_ticker").alias("ticker"), "period_end").agg(F.count(F.lit(1)).alias("eligible"), F.count_if("movement_eligible").alias("moved"))
    first_lost = modal_loss(lost.counts).select(*key, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LOSSES.items() for x in p]), F.col("loss_code")), F.lit("none")).alias("first_loss"))
    out = grid
    for part in (held, shown, entering, lost.with_prior, lost.target_priors, ready, first_lost, timing.withColumnRenamed("opportunities", "source_before_target_opportunities"), verified):
        out = out.join(part, key, "left")
    counts = [c for c, t in out.dtypes if t in ("bigint", "int", "double") and c not in ("cik",)]
    none = F.when(F.coalesce(F.col("current_facilities"), F.lit(0)) == 0, "no_current_period_facilities").otherwise("none")
    out = out.join(status, "ticker", "left").fillna(0, counts).fillna({"listed_status": "not_listed", "verified_reporting_order_available": False})
    first_loss = F.coalesce("first_loss", none)
    return out.withColumns({"first_loss": first_loss, "dominant_exclusion_reason": first_loss, "quarter": V.quarter_label(F.col("period_end"))})


def as_of(events: DataFrame, history: DataFrame, keys: list[str], time: str, value: Column, event_id: str, carry: Column | None = None) -> DataFrame:
    """events with the value of the latest earlier row of history with the same keys, if that is a single value.

    Both are sorted once by key and time, over all tasks, and the last value runs along: no event meets more
    than one row, and the rows of one key are dealt to as many tasks as they need. status tells apart found,
    none and ambiguous; of what is to be carried along, the largest of that time comes as prior_carry.
    Null keys meet null keys, a null time is before all others, and null values are no single value."""
    latest = history.withColumns({"_v": value, "_c": F.lit(None).cast("string") if carry is None else carry}).groupBy(*keys, time).agg(F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.max("_c").alias("_carry"))
    told = latest.select(*keys, F.col(time).alias("_t"), F.lit(None).cast(events.schema[event_id].dataType).alias("_id"), F.struct(F.col(time).alias("t"), F.when(F.col("_least") == F.col("_most"), F.col("_least")).alias("value"), F.col("_carry").alias("carry")).alias("_told"))
    asked = events.select(*keys, F.col(time).alias("_t"), F.col(event_id).alias("_id"), F.lit(None).cast(told.schema["_told"].dataType).alias("_told"))
    # of the same time, events come first: only strictly earlier rows count
    parts = sorted_parts(asked.unionByName(told), [*[F.col(k) for k in keys], F.col("_t"), F.col("_told").isNotNull()], "as_of")
    run = last_before(parts, keys, F.col("_told"), "_prior").filter(F.col("_told").isNull())
    single = F.col("_prior.value").isNotNull()
    status = F.when(F.col("_prior").isNull(), "none").when(single, "found").otherwise("ambiguous")
    out = run.select(F.col("_id").alias(event_id), *keys, F.col("_t").alias(time), F.col("_prior.t").alias("prior_time"), F.col("_prior.value").alias("prior_value"), F.col("_prior.carry").alias("prior_carry"), status.alias("status"))
    return out if carry is not None else out.drop("prior_carry")


def exact_time(events: DataFrame, records: DataFrame, keys: list[str], event_id: str) -> DataFrame:
    """events with the number of records at exactly their keys and a status; one is a match."""
    n = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"))
    met = events.join(n, keys, "left").fillna(0, ["n_records"])
    return met.select(event_id, *keys, "n_records", F.when(F.col("n_records") == 0, "not_found").when(F.col("n_records") == 1, "matched").otherwise("ambiguous").alias("status"))


def feasible(events: DataFrame, targets: DataFrame, keys: list[str], before: Column) -> DataFrame:
    """events for which some target with the same keys meets the time condition."""
    return events.join(targets, [F.col(f"e_{k}") == F.col(f"t_{k}") for k in keys] + [before], "left_semi")
