"""Forecast revisions: payloads of disclosures, the latest compatible one before, and the log of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.operators import eligibility as E
from ledgerloom.shared import sorted_parts

METRICS = ("revenue", "operating_profit", "ordinary_profit", "net_income")
# The columns of each horizon and basis, in the order in which they are tried.
FORECASTS = (
    ("FY", "consolidated", ("FSales", "FOP", "FOdP", "FNP")),
    ("FY", "standalone", ("FNCSales", "FNCOP", "FNCOdP", "FNCNP")),
    ("2Q", "consolidated", ("FSales2Q", "FOP2Q", "FOdP2Q", "FNP2Q")),
    ("2Q", "standalone", ("FNCSales2Q", "FNCOP2Q", "FNCOdP2Q", "FNCNP2Q")),
)
# Titles that announce a revision, and words that make one unfit.
TITLE = "業績予想の修正"
UNFIT = ("配当", "撤回", "取下げ", "取り下げ", "中止", "未定", "実績値との差異", "予想と実績", "実績との差異", "差異に関する")


def clean_event(title: Column) -> Column:
    return title.contains(TITLE) & ~title.rlike("|".join(UNFIT))


def payload(records: DataFrame) -> Column:
    """horizon, basis and the four metrics of the first configuration with any value, else null."""
    out = F.lit(None).cast(f"struct<horizon:string,basis:string,{','.join(f'{m}:string' for m in METRICS)}>")
    for horizon, basis, fields in reversed(FORECASTS):
        values = [F.nullif(F.col(f).cast("string"), F.lit("")) if f in records.columns else F.lit(None).cast("string") for f in fields]
        some = F.lit(False)
        for v in values:
            some = some | v.isNotNull()
        out = F.when(some, F.struct(F.lit(horizon).alias("horizon"), F.lit(basis).alias("basis"), *[v.alias(m) for v, m in zip(values, METRICS, strict=True)])).otherwise(out)
    return out


def disclosures(records: DataFrame) -> DataFrame:
    """code, disc_no, doc_type, ts (local text) and payload with the signature that makes two comparable."""
    start, end = V.digits_date(F.col("CurFYSt")), V.digits_date(F.col("CurFYEn"))
    p = payload(records)
    return records.select(
        F.col("Code").alias("code"), F.col("DiscNo").alias("disc_no"), F.col("DocType").cast("string").alias("doc_type"),
        F.concat_ws(" ", V.digits_date(F.col("DiscDate")), V.clock(F.col("DiscTime").cast("string"))).alias("ts"), p.alias("p"),
        start.alias("fiscal_start"), end.alias("fiscal_end"), V.period_length_days(F.to_date(start), F.to_date(end)).alias("period_length_days"),
    )


def same_fiscal_period(left: Column, right: Column) -> Column:
    """Both ends of a fiscal year are told, and equal."""
    return F.coalesce((left != "") & (left == right), F.lit(False))


def attempt(source_type: Column, url: Column, result: Column, note: Column, status: Column | None = None, size: Column | None = None, at: Column | None = None) -> Column:
    """A row of the log of attempts."""
    none = F.lit(None)
    return F.struct(
        source_type.alias("source_type"), url.alias("source_url"), V.utc_text(F.current_timestamp() if at is None else at).alias("attempted_utc"),
        (none if status is None else status).cast("int").alias("http_status"), F.coalesce((none if size is None else size).cast("long"), F.lit(0).cast("long")).alias("content_bytes"), result.alias("result"), note.alias("evidence_note"),
    )


def reconstruct(events: DataFrame, records: DataFrame, approved: list[str], window_start: str = "2024-09-01") -> DataFrame:
    """A row for each event (event_id, code, ts to the minute) with its status and, if recovered, old and new values.

    The revision is the one approved record of that minute; the old values are those of the latest
    earlier record of the same signature, unless that time holds conflicting ones."""
    told = disclosures(records)
    now = told.filter(F.col("doc_type").isin(*approved)).withColumn("minute", F.substring("ts", 1, 16))
    one = now.groupBy("code", "minute").agg(F.count(F.lit(1)).alias("n"), *[F.any_value(c).alias(c) for c in ("disc_no", "doc_type", "ts", "p", "fiscal_start", "fiscal_end", "period_length_days")])
    ev = events.select("event_id", "code", F.substring("ts", 1, 16).alias("minute")).join(one, ["code", "minute"], "left").fillna(0, ["n"])
    full = lambda p: F.forall(F.array(*[F.col(f"{p}.{m}") for m in METRICS]), lambda x: x.isNotNull())
    signature = ["code", "fiscal_start", "fiscal_end", "horizon", "basis"]
    signed = lambda df: df.filter(F.col("p").isNotNull() & same_fiscal_period(F.col("fiscal_end"), F.col("fiscal_end"))).withColumns({"horizon": F.col("p.horizon"), "basis": F.col("p.basis")})
    found = E.as_of(signed(ev.filter("n = 1")), signed(told), signature, "ts", F.col("p"), "event_id", F.col("disc_no"))
    last = found.filter("status != 'none'").select("event_id", F.when(F.col("status") == "found", 1).otherwise(2).alias("n_old"), F.col("prior_value").alias("old"), F.col("prior_carry").alias("old_disc_no"), F.col("prior_time").alias("old_ts"))
    out = ev.join(last, "event_id", "left")
    status = (
        F.when(F.col("n") == 0, "revision_record_not_found").when(F.col("n") > 1, "ambiguous_revision_record")
        .when(F.col("p").isNull() | ~F.coalesce(full("p"), F.lit(False)), "incomplete_new_forecast")
        .when(F.col("n_old").isNull(), F.when(F.col("fiscal_start") < window_start, "prior_outside_window").otherwise("ambiguous_old_forecast"))
        .when((F.col("n_old") > 1) | ~F.coalesce(full("old"), F.lit(False)), "ambiguous_old_forecast").otherwise("recovered")
    )
    out = out.withColumn("status", status)
    ok = F.col("status") == "recovered"
    shown = [F.when(ok, F.col(f"{s}.{m}")).alias(f"{n}_{m}") for m in METRICS for n, s in (("old", "old"), ("new", "p"))]
    deltas = F.array(*[F.when(ok, V.number(F.col(f"p.{m}")) - V.number(F.col(f"old.{m}"))) for m in METRICS])
    return out.select("event_id", "code", "status", *shown, F.when(ok, F.col("p.horizon")).alias("horizon"), F.when(ok, F.col("p.basis")).alias("basis"), F.when(ok, F.col("old_disc_no")).alias("old_disc_no"), F.when(ok, F.col("disc_no")).alias("new_disc_no"), F.when(ok, F.col("old_ts")).alias("prior_ts"), F.when(ok, V.direction(deltas)).alias("direction"))


def attempt_status(attempts: DataFrame, ok: Column | None = None) -> DataFrame:
    """For each event its tries, the number that succeeded (status 200, over 500 bytes) and the last result."""
    good = (F.col("http_status") == 200) & (F.col("content_bytes") > 500) if ok is None else ok
    return attempts.groupBy("event_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(good).alias("succeeded"), F.max_by("result", "attempt_order").alias("last_result"))


def advance(rows: DataFrame, tried: DataFrame, key: str = "event_id") -> DataFrame:
    """Status of pending rows moved on by what was tried; all others keep theirs."""
    met = rows.join(tried.select(key, "succeeded"), key, "left")
    new = F.when((F.col("status") == "pending") & (F.col("succeeded") > 0), "archived").when((F.col("status") == "pending") & (F.col("succeeded") == 0), "archive_failed").otherwise(F.col("status"))
    return met.withColumn("status", new).drop("succeeded")


def recent(event_date: Column, today: Column, days: int = 730) -> Column:
    """The event is no further back than the free history reaches; null if its date is."""
    return event_date >= F.date_sub(today, days)


def settle(attempts: DataFrame, key: str, order: list[str], outcome: str, moves: dict[tuple[str, str], str], start: str) -> DataFrame:
    """key, status, attempts and changes: the status that each key's attempts lead to, one after the other in their order.

    moves has the next status for a status and an outcome; where it has none, the status stays. What a run
    of attempts does is a status for each status it may begin with; runs of a key are made inside each
    partition of the ordered log and put together in order, so that a key with very many attempts is the
    work of many tasks. Rows that repeat a key, order and outcome are one attempt, whatever order they come
    in; null outcomes change nothing, null keys are a key of their own, equal places go by the outcome."""
    names = sorted({start, *(s for s, _ in moves), *moves.values()})
    table = F.create_map(*[F.lit(x) for (s, o), to in moves.items() for x in (f"{s}\x1f{o}", to)])
    empty = F.array(*[F.struct(F.lit(n).alias("status"), F.lit(0).cast("long").alias("changes")) for n in names])

    def step(state: Column, x: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat_ws("\x1f", state["status"], x)), state["status"])
        return F.struct(to.alias("status"), (state["changes"] + (to != state["status"]).cast("long")).alias("changes"))

    def after(run: Column, state: Column) -> Column:
        told = F.element_at(run, F.array_position(F.array(*map(F.lit, names)), state["status"]).cast("int"))
        return F.struct(told["status"].alias("status"), (state["changes"] + told["changes"]).alias("changes"))

    log = attempts.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)], F.col(outcome).alias("_outcome")).distinct()
    parts = sorted_parts(log, [F.col("_key"), *[F.col(f"_by{i}") for i in range(len(order))], F.col("_outcome")], "attempts")
    own = parts.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_row", F.coalesce("_outcome", F.lit("")).alias("x")))).alias("_run"))
    own = own.select("_key", "_part", "n", F.aggregate("_run", empty, lambda acc, x: F.transform(acc, lambda s: step(s, x["x"]))).alias("run"))
    begin = F.struct(F.lit(start).alias("status"), F.lit(0).cast("long").alias("changes"))
    whole = own.groupBy("_key").agg(F.sum("n").alias("attempts"), F.array_sort(F.collect_list(F.struct("_part", "run"))).alias("_runs"))
    told = whole.select(F.col("_key").alias(key), "attempts", F.aggregate("_runs", begin, lambda acc, x: after(x["run"], acc)).alias("_end"))
    return told.select(key, "_end.status", "attempts", "_end.changes")


def variant_payload(text: Column) -> Column:
    """payload() of a record that comes as JSON text of any shape, read as a variant: members may be missing, or be
    numbers or texts; null, blank and nested ones count as missing, and so does all of a text that is no JSON."""
    record = F.try_parse_json(text)
    out = F.lit(None).cast(f"struct<horizon:string,basis:string,{','.join(f'{m}:string' for m in METRICS)}>")
    for horizon, basis, fields in reversed(FORECASTS):
        values = [F.nullif(F.try_variant_get(record, f"$.{f}", "string"), F.lit("")) for f in fields]
        nested = [F.schema_of_variant(F.try_variant_get(record, f"$.{f}", "variant")).rlike("^(ARRAY|OBJECT)") for f in fields]
        values = [F.when(~F.coalesce(n, F.lit(False)), v) for n, v in zip(nested, values, strict=True)]
        out = F.when(F.coalesce(*values).isNotNull(), F.struct(F.lit(horizon).alias("horizon"), F.lit(basis).alias("basis"), *[v.alias(m) for v, m in zip(values, METRICS, strict=True)])).otherwise(out)
    return out


def merge_seed(rows: DataFrame, seed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with seed values where the row has none."""
    met = rows.join(seed.select(key, *[F.col(c).alias(f"_seed_{c}") for c in columns]), key, "left")
    return met.withColumns({c: F.coalesce(c, f"_seed_{c}") for c in columns}).drop(*[f"_seed_{c}" for c in columns])
