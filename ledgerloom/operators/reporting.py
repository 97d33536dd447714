"""Reporting calendars: first events, periodic candidates, gaps, coverage and fallback audits."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions import values as V
from ledgerloom.shared import broadcast_if_small, materialize

MAX_LAG = 120


def first_events(events: DataFrame, keys: list[str], time: str, seen: str) -> DataFrame:
    """The first event of each key; of equal times, the one seen first."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(time).asc_nulls_last(), seen))
    return events.withColumn("_n", order).filter("_n = 1").drop("_n")


def within_lag(accepted: Column, period_end: Column, most: int = MAX_LAG) -> Column:
    return V.lag_days(accepted, period_end).between(0, most)


def periodic_candidates(filings: DataFrame) -> DataFrame:
    """For each fund and period its first periodic report of that very period within the lag."""
    own = filings.filter(F.col("form").isin("10-Q", "10-K") & (F.col("report_date") == F.col("period_end")) & within_lag(F.col("accepted"), F.col("period_end")))
    named = own.withColumn("periodic_url", F.concat_ws("/", V.accession_folder(F.col("cik"), F.col("accession")), F.col("primary_document")))
    return first_events(named, ["ticker", "period_end"], "accepted", "accession").withColumns({"event_type": F.col("form"), "verification_status": F.lit("verified_periodic_filing_fallback")})


def results_candidates(filings: DataFrame) -> DataFrame:
    """Current reports within the lag that name item 2.02 or 7.01, with the judgement of their exhibits.

    Rows that were not accepted stay, with the reason, for the log of exclusions."""
    items = F.coalesce(F.col("items"), F.lit(""))
    own = filings.filter((F.col("form") == "8-K") & within_lag(F.col("accepted"), F.col("period_end")) & (items.contains("2.02") | items.contains("7.01")))
    judged = own.withColumn("judged", X.classify_documents(X.submission_documents(F.col("raw")), F.col("period_end"), items.contains("2.02")))
    j = F.col("judged")
    return judged.select(*own.columns, j["filename"].alias("filename"), j["event_type"].alias("event_type"), j["accepted"].alias("accepted_exhibit"), j["reason"].alias("reason")).drop("raw")


def reporting_calendar(grid: DataFrame, results: DataFrame, periodic: DataFrame) -> DataFrame:
    """A row for each cell of the grid: its earliest accepted results, else its periodic report, else explicit_missing."""
    key = ["ticker", "period_end"]
    r = first_events(results.filter("accepted_exhibit"), key, "accepted", "accession").select(*key, F.struct(F.col("accepted").alias("ts"), "event_type", F.lit("verified_exhibit_content").alias("status")).alias("r"))
    p = periodic.select(*key, F.struct(F.col("accepted").alias("ts"), "event_type", F.col("verification_status").alias("status")).alias("p"))
    met = grid.join(r, key, "left").join(p, key, "left")
    # of the same time, results come first
    one = F.when(F.col("r.ts") <= F.coalesce(F.col("p.ts"), F.col("r.ts")), F.col("r")).otherwise(F.coalesce("p", "r"))
    met = met.withColumn("x", one)
    ts = F.col("x.ts")
    return met.select(*grid.columns, ts.alias("acceptance_timestamp_utc"), V.eastern_text(ts).alias("timestamp_et"), V.market_session(ts).alias("market_session"), V.lag_days(ts, F.col("period_end")).alias("lag_days"), F.col("x.event_type").alias("event_type"), F.coalesce("x.status", F.lit("explicit_missing")).alias("verification_status"))


#: A day in the units that gaps are counted in, and the thresholds of a search round.
DAY, SPLITS = 86_400_000_000, 15


class _Times:
    """The distinct times of a group (microseconds) with how many rows have each, for counting gaps."""

    def __init__(self, times: np.ndarray, rows: np.ndarray):
        order = np.argsort(times)
        self.times, self.rows = times[order], rows[order]
        self.upto = np.concatenate([[0], np.cumsum(self.rows)])

    def pairs(self) -> int:
        return int(self.rows @ (self.upto[-1] - self.upto[1:]))

    def within(self, gap: int) -> int:
        """Pairs whose gap is no longer."""
        ends = np.searchsorted(self.times, self.times + gap, side="right")
        return int(self.rows @ (self.upto[ends] - self.upto[1:]))

    def above(self, gap: int) -> int | None:
        """The least gap that is longer."""
        ends = np.searchsorted(self.times, self.times + gap, side="right")
        some = ends < len(self.times)
        return int((self.times[ends[some]] - self.times[some]).min()) if some.any() else None

    def nth(self, n: int) -> int:
        """The nth gap (from 0) by length: the least that so many pairs are within."""
        low, high = 0, int(self.times[-1] - self.times[0])
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.within(middle) > n else (middle + 1, high)
        return low


def _places(n_pairs: int) -> list[tuple[int, float]]:
    """(rank, share of the next rank) of the three quartiles."""
    return [(int((n_pairs - 1) * q), (n_pairs - 1) * q % 1) for q in (0.25, 0.5, 0.75)]


def _quartile(low: int, high: int, share: float) -> float:
    return ((1 - share) * low + share * high) / DAY


def gap_counts(rows: DataFrame, group: str, time: str, over: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """What gap_summary() says of reporting_gaps(), without a pair: for each group with a gap, and with a null
    group for all, n_pairs, the quartiles p25, median and p75 in days, and how many are over so many days.

    Rows are first counted by group and time. A group's distinct times, at most one for each microsecond
    that its reports are apart and in truth one for each second, are then one sorted array, on which a count of
    the pairs within a gap is a search for each time; a quartile is the gap that enough pairs are within,
    found by halving. Those of all groups together are found by the same search in rounds: every task
    counts its groups' pairs within a few gaps, and the sums narrow the range. Null groups and times have
    no gaps, equal times neither."""
    import pandas as pd

    known = rows.filter(F.col(group).isNotNull() & F.col(time).isNotNull())
    kind = known.schema[group].dataType.simpleString()
    counted = materialize(known.groupBy(F.col(group).alias("g"), F.unix_micros(time).alias("t")).agg(F.count(F.lit(1)).alias("n")), "times")
    shown = ["n_pairs", "p25", "median", "p75", *[f"over_{d}d" for d in over]]

    def summary(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        times = _Times(own["t"].to_numpy(), own["n"].to_numpy())
        n = times.pairs()
        if not n:
            return pd.DataFrame(columns=["g", *shown, "longest"])
        quartiles = []
        for rank, share in _places(n):
            low = times.nth(rank)
            quartiles.append(_quartile(low, low if times.within(low) > rank + 1 or not share else times.above(low), share))
        return pd.DataFrame([(key[0], n, *quartiles, *[n - times.within(d * DAY) for d in over], times.times[-1] - times.times[0])], columns=["g", *shown, "longest"])

    counts = ", ".join(f"over_{d}d long" for d in over)
    each = materialize(counted.groupBy("g").applyInPandas(summary, f"g {kind}, n_pairs long, p25 double, median double, p75 double, {counts}, longest long"), "gaps")
    total = each.agg(F.sum("n_pairs"), F.max("longest"), *[F.sum(f"over_{d}d") for d in over]).first()
    out = each.select(F.col("g").alias(group), *shown)
    if not total[0]:
        return out
    lows = _all_places(counted, total[0], total[1])
    of_all = [(None, total[0], *[_quartile(low, high, share) for (low, high), (_, share) in zip(lows, _places(total[0]), strict=True)], *total[2:])]
    return out.unionByName(rows.sparkSession.createDataFrame(of_all, out.schema))


def _all_places(counted: DataFrame, n_pairs: int, longest: int) -> list[tuple[int, int]]:
    """For each quartile of the gaps of all groups together the gap of its rank and the next one."""
    import pandas as pd

    def ask(gaps: list[int], count: Callable[[_Times, int], int | None], merge: Callable) -> list[int]:
        """What count gives for each gap, merged over the groups; a task sends a number for each."""

        def own(table: pd.DataFrame) -> pd.DataFrame:
            times = _Times(table["t"].to_numpy(), table["n"].to_numpy())
            return pd.DataFrame({"i": range(len(gaps)), "v": pd.array([count(times, g) for g in gaps], "Int64")})

        return [r.v for r in counted.groupBy("g").applyInPandas(own, "i int, v long").groupBy("i").agg(merge("v").alias("v")).orderBy("i").collect()]

    places = _places(n_pairs)
    ranges = [(0, longest)] * len(places)
    while any(low < high for low, high in ranges):
        cuts = [sorted({low + (high - low) * k // (SPLITS + 1) for k in range(1, SPLITS + 1)} - {high}) for low, high in ranges]
        within = iter(ask([c for own in cuts for c in own], _Times.within, F.sum))
        for i, (rank, _) in enumerate(places):
            low, high = ranges[i]
            for cut in cuts[i]:
                if next(within) > rank:
                    high = min(high, cut)
                else:
                    low = max(low, cut + 1)
            ranges[i] = (low, high)
    lows = [low for low, _ in ranges]
    within, above = ask(lows, _Times.within, F.sum), ask(lows, _Times.above, F.min)
    return [(low, low if n > rank + 1 or not share else more) for low, n, more, (rank, share) in zip(lows, within, above, places, strict=True)]


def reporting_gaps(rows: DataFrame, group: str, time: str, member: str) -> DataFrame:
    """Days between every earlier and later reporter of a group (equal times give none)."""
    side = lambda p: rows.select(group, F.col(member).alias(f"{p}_member"), F.col(time).alias(f"{p}_time"))
    met = side("early").join(side("late"), group).filter(F.col("early_time") < F.col("late_time"))
    return met.withColumn("days", V.hours_between(F.col("early_time"), F.col("late_time")) / 24)


def gap_summary(gaps: DataFrame, group: str) -> DataFrame:
    """Counts, quartiles and counts over thresholds for each group and, with a null group, for all."""
    q = F.percentile("days", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return gaps.groupingSets([[group], []], group).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.get(q, 0).alias("p25"), F.get(q, 1).alias("median"), F.get(q, 2).alias("p75"),
        *[F.count_if(F.col("days") > d).alias(f"over_{d}d") for d in (1, 3, 5)],
    )


def coverage(calendar: DataFrame) -> DataFrame:
    """expected, verified, fallback and missing cells of each period."""
    status = F.col("verification_status")
    return calendar.groupBy("period_end").agg(F.count(F.lit(1)).alias("expected"), F.count_if(status != "explicit_missing").alias("verified"), F.count_if(status == "verified_periodic_filing_fallback").alias("fallback"), F.count_if(status == "explicit_missing").alias("missing"))


def lag_stats(rows: DataFrame, lag: str = "lag_days", low: int = 20, high: int = 80) -> DataFrame:
    q = F.percentile(lag, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    known = rows.filter(F.col(lag).isNotNull())
    inside = F.col(lag).between(low, high)
    return known.agg(F.count(lag).alias("n"), F.min(lag).alias("least"), F.get(q, 0).alias("p25"), F.get(q, 1).alias("median"), F.get(q, 2).alias("p75"), F.max(lag).alias("most"), F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


def override_earlier(rows: DataFrame, overrides: DataFrame, keys: list[str], time: str) -> DataFrame:
    """rows with an override's time where that is earlier, and whether it moved."""
    met = rows.join(overrides.groupBy(*keys).agg(F.min(time).alias("_earlier")), keys, "left")
    shifted = F.coalesce(F.col("_earlier") < F.col(time), F.lit(False))
    return met.withColumn("shifted", shifted).withColumn(time, F.least(time, "_earlier")).drop("_earlier")


def earliest_or_default(rows: DataFrame, known: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The known time of each key, else the earliest of its rows."""
    least = rows.groupBy(*keys).agg(F.min(time).alias("_least"))
    return least.join(known.select(*keys, F.col(time).alias("_known")), keys, "full").select(*keys, F.coalesce("_known", "_least").alias(time))


#: Bytes of text and names, about, that meet in one task.
TEXT_BYTES, NAMES = 32 << 20, 50_000


def first_places(texts: DataFrame, names: DataFrame, keys: list[str], text: str, name: str, before: int = X.BEFORE, behind: int = X.BEHIND) -> DataFrame:
    """Each text with each name of its keys that it contains: the columns of texts without the text, the name, and
    window, what stands around the name where it comes first.

    One automaton of all names reads a text once, so the time is that of the texts and of what is found, not of
    texts times names. Texts of a key are dealt out in chunks and names in parts, by their sums; a text
    goes over the network once (for each part of the names, where there are more than NAMES), and only
    windows come back. Rows with a null key, text or name find nothing; repeated rows find the same."""
    known = [F.col(k).isNotNull() for k in keys]
    texts = texts.filter(functools.reduce(operator.and_, [*known, F.col(text).isNotNull()]))
    names = names.filter(functools.reduce(operator.and_, [*known, F.col(name) != ""])).select(*keys, F.col(name).alias("_name")).distinct()
    sizes = texts.groupBy(*keys).agg(F.ceil(F.sum(F.octet_length(text)) / TEXT_BYTES).cast("int").alias("_chunks"))
    grid = names.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / NAMES).cast("int").alias("_parts")).join(sizes, keys)
    grid = broadcast_if_small(materialize(grid.withColumn("_chunks", F.greatest("_chunks", F.lit(1))), "grid"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = [*keys, "_chunk", "_part"]
    dealt = texts.join(grid, keys).withColumns({"_chunk": F.pmod(F.xxhash64(text), "_chunks").cast("int"), "_part": spread("_parts")}).select(*both, *[c for c in texts.columns if c not in keys])
    asked = names.join(grid, keys).withColumn("_chunk", spread("_chunks")).withColumn("_part", F.pmod(F.xxhash64("_name"), "_parts").cast("int"))
    asked = asked.select(*[F.col(c).alias(c) for c in (*both, "_name")])  # columns of its own, where both sides come from one table
    kept = [c for c in texts.columns if c != text]
    kinds = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes if c != text)

    def run(texts: pa.Table, names: pa.Table) -> pa.Table:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for own in names.column("_name").to_pylist():
            automaton.add_word(own, own)
        automaton.make_automaton()
        rows, found, windows = [], [], []
        for i, whole in enumerate(texts.column(text)) if len(automaton) else ():
            plain, seen = whole.as_py(), set()
            for end, own in automaton.iter(plain):
                if own not in seen:
                    seen.add(own)
                    start = end + 1 - len(own)
                    rows.append(i)
                    found.append(own)
                    windows.append(plain[max(0, start - before) : end + 1 + behind])
        made = texts.select(kept).take(pa.array(rows, pa.int64()))
        return made.append_column(name, pa.array(found, pa.string())).append_column("window", pa.array(windows, pa.string()))

    return dealt.groupBy(*both).cogroup(asked.groupBy(*both)).applyInArrow(run, f"{kinds}, `{name}` string, window string")


def exhibit_marks(exhibits: DataFrame, facilities: DataFrame) -> DataFrame:
    """ticker, period_end, accepted, accession, filename, economic_facility_id: current facilities whose fair
    value an exhibit of their fund and period shows beside their borrower's name.

    Names are found in the texts, and facilities meet only the windows around their own."""
    key = ["ticker", "period_end"]
    now = facilities.filter("is_current_period").select(*key, "economic_facility_id", X.plain_name(F.col("borrower_norm")).alias("name"), "fair_value", "lien", "facility_type").filter(F.length("name") >= X.LEAST_NAME)
    plain = exhibits.select(*key, "accepted", "accession", "filename", X.compact_text(F.col("text")).alias("plain")).filter(F.col("plain").contains("schedule of investments"))
    met = first_places(plain, now, key, "plain", "name").join(now, [*key, "name"])
    return met.filter(X.mark_in_window(F.col("window"), F.col("fair_value"), F.col("lien"), F.col("facility_type"))).select(*key, "accepted", "accession", "filename", "economic_facility_id").distinct()


def fallback_audit(fallbacks: DataFrame, disclosures: DataFrame, marks: DataFrame) -> DataFrame:
    """Periodic fallbacks (ticker, period_end, acceptance_timestamp_utc) with the earliest time at which
    results, and marks of single facilities, were public in other filings (ticker, period_end, accepted)."""
    key, original = ["ticker", "period_end"], F.col("acceptance_timestamp_utc")
    results = disclosures.groupBy(*key).agg(F.min("accepted").alias("_results"), F.count(F.lit(1)).alias("disclosures"))
    shown = marks.groupBy(*key).agg(F.min("accepted").alias("_marks"), F.array_sort(F.collect_set("economic_facility_id")).alias("exact_facility_ids"))
    met = fallbacks.join(results, key, "left").join(shown, key, "left").fillna(0, ["disclosures"])
    met = met.withColumns({"target_results_public_ts": F.coalesce("_results", original), "source_mark_public_ts": F.coalesce("_marks", original), "exact_facility_ids": F.coalesce("exact_facility_ids", F.array().cast("array<string>"))})
    target, source = F.col("target_results_public_ts"), F.col("source_mark_public_ts")
    return met.withColumns({"target_cutoff_shifted_earlier": target < original, "source_mark_timestamp_shifted_earlier": source < original, "target_and_source_timestamps_differ": target != source, "exact_facility_mark_present": F.size("exact_facility_ids") > 0}).drop("_results", "_marks")


def movement_guard(before: DataFrame, after: DataFrame, development: str, guard: int = 20) -> DataFrame:
    """Moved facilities outside the development quarter in two movement summaries, and whether enough are left."""
    total = lambda df, name: df.filter(F.col("quarter") != development).agg(F.coalesce(F.sum("moved_facilities"), F.lit(0)).alias(name))
    return total(before, "before").crossJoin(total(after, "after")).withColumn("guard_met", F.col("after") >= guard)  # one row each
