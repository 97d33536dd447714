"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.batches import apart
from ledgerloom.shared import broadcast_if_small, materialize, running_totals, with_position

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_240_601
#: Units that one step of the reduction tree folds into one residual.
BLOCK = 64

# One step: the carried unit a meets the next unit b. Either mass goes from b to a or from a to b, as
# much as makes one of them integral; the chances keep every unit's expectation. `to_a` is the
# direction, `a_done` tells which of the two is settled, and it gets a copy exactly if they agree.
_FOLD = f"""
aggregate(
  units,
  named_struct('last', cast(null as {{unit}}), 'done', cast(array() as array<{{done}}>)),
  (acc, b) -> if(acc.last is null, named_struct('last', b, 'done', acc.done),
    transform(array(named_struct(
        'up', least(acc.last.w * (1 - acc.last.p), b.w * b.p),
        'down', least(acc.last.w * acc.last.p, b.w * (1 - b.p)),
        'u', ((xxhash64({SEED}, acc.last.doc_id, acc.last.size, b.doc_id, b.size) & 9007199254740991L) / 9007199254740992D))),
      t -> transform(array(named_struct(
          'to_a', t.u * (t.up + t.down) < t.down,
          'a_done', if(t.u * (t.up + t.down) < t.down, acc.last.w * (1 - acc.last.p) <= b.w * b.p, acc.last.w * acc.last.p <= b.w * (1 - b.p)),
          'moved', if(t.u * (t.up + t.down) < t.down, t.up, t.down))),
        s -> named_struct(
          'last', if(s.a_done,
             named_struct('w', b.w, 'order', b.order, 'doc_id', b.doc_id, 'size', b.size, 'rows', b.rows, 'base', b.base, 'whole', b.whole,
                          'p', least(1D, greatest(0D, b.p + if(s.to_a, -1, 1) * s.moved / b.w))),
             named_struct('w', acc.last.w, 'order', acc.last.order, 'doc_id', acc.last.doc_id, 'size', acc.last.size, 'rows', acc.last.rows, 'base', acc.last.base, 'whole', acc.last.whole,
                          'p', least(1D, greatest(0D, acc.last.p + if(s.to_a, 1, -1) * s.moved / acc.last.w)))),
          'done', concat(acc.done, array(if(s.a_done,
             named_struct('doc_id', acc.last.doc_id, 'size', acc.last.size, 'rows', acc.last.rows, 'base', acc.last.base, 'extra', acc.last.whole + if(s.to_a, 1L, 0L)),
             named_struct('doc_id', b.doc_id, 'size', b.size, 'rows', b.rows, 'base', b.base, 'extra', b.whole + if(s.to_a, 0L, 1L)))))
        ))[0])[0]))
"""


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Add weight and target to (source, source_size): all sizes shared by weight, none above cap times its size.

    Sources are ranked by code point, null last, and weigh 1, 2, 3, repeating. In the order of cap by
    weight, a source meets its cap if its share of what those before it leave is no less; so running
    totals tell all that do, however many rounds of resharing that stands for.
    """
    ranked = with_position(sources, [F.col("source").isNull(), F.col("source")], "sources")
    ranked = ranked.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int")), "cap": (F.col("source_size") * cap).cast("long")}).drop("position")
    keys = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    run = materialize(running_totals(ranked, keys, "caps", {"capped": F.col("cap"), "weights": F.col("weight")}), "ranked")
    whole = run.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0)).alias("every"))
    share = (F.col("total") - F.col("capped")) / (F.col("every") - F.col("weights"))
    full = run.crossJoin(F.broadcast(whole)).filter(F.col("cap") <= share * F.col("weight"))  # one row
    met = full.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("met"), F.coalesce(F.sum("weight"), F.lit(0)).alias("met_weight"))
    level = whole.crossJoin(met).select(F.coalesce(F.try_divide((F.col("total") - F.col("met")).cast("double"), F.col("every") - F.col("met_weight")), F.lit(0.0)).alias("level"))
    return run.crossJoin(F.broadcast(level)).withColumn("target", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).select(*sources.columns, "weight", "target")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = BLOCK) -> DataFrame:
    """How often each document enters the mix: doc_id, source, size, source_size, target, copies, taken.

    A source's rate is target / size; every document gets its whole part, and pivotal rounding deals
    the fractions so that a source's words stay the same but for one last document. A first pass folds
    blocks of about `block` documents, dealt by a hash of the id, each to one residual; residuals are
    folded in turn until a source has one, which its own hash rounds. The tree has log(n) / log(block)
    levels, and no task sees more than a few times `block` units.

    Null text or a text of white space has size 0 and takes nothing. A null source is a source of its
    own, last in rank; null ids are kept. Rows that agree in id, source and size are one unit with a
    count, and get copies that differ by one at most. An empty table gives an empty one. Reruns agree:
    every draw is a hash of the ids that meet. Other columns are not looked at.
    """
    words = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    units = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").alias("doc_id"), words.alias("size"))
    units = materialize(units.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    shares = materialize(targets(sources, weights, cap).withColumnRenamed("source", "of"), "targets")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    held = units.join(shares, F.col("source").eqNullSafe(F.col("of"))).drop("of", "weight")
    held = held.withColumn("base", F.floor(rate)).withColumn("mass", F.col("rows") * (rate - F.col("base")))
    held = held.withColumn("whole", F.floor("mass")).withColumn("p", F.col("mass") - F.col("whole"))
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    out = ["source", "doc_id", "size", "rows", "base", "extra"]
    parts = [held.filter(~open_).select(*out[:-1], F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("extra"))]

    kind = dict(held.dtypes)["doc_id"]
    unit = f"struct<w:double,order:bigint,doc_id:{kind},size:bigint,rows:bigint,base:bigint,whole:bigint,p:double>"
    fold = F.expr(_FOLD.format(unit=unit, done=f"struct<doc_id:{kind},size:bigint,rows:bigint,base:bigint,extra:bigint>"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("units") / block))
    level = held.filter(open_).select(
        "source", blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), blocks).alias("block"),
        F.struct(F.col("size").cast("double").alias("w"), F.xxhash64(F.lit(SEED + 1), "doc_id", "size").alias("order"), "doc_id", "size", "rows", "base", "whole", "p").alias("unit"),
    )
    most = shares.agg(F.coalesce(F.max(blocks), F.lit(0))).first()[0]
    while most:
        # the largest first: what is left at the end of a block is then mostly a short document
        grouped = level.groupBy("source", "blocks", "block").agg(F.reverse(F.array_sort(F.collect_list("unit"))).alias("units"))
        folded = materialize(grouped.select("source", "blocks", "block", fold.alias("f")), "folded")
        parts.append(folded.select("source", F.inline("f.done")))
        level = folded.select("source", F.ceil(F.col("blocks") / block).alias("blocks"), F.floor(F.col("block") / block).alias("block"), F.col("f.last").alias("unit"))
        most = -(-most // block) if most > 1 else 0
    draw = F.xxhash64(F.lit(SEED + 2), "doc_id", "size").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    parts.append(level.select("source", "unit.*").select(*out[:-1], (F.col("whole") + (draw < F.col("p")).cast("long")).alias("extra")))

    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    copies = F.col("base") + (F.col("nth") <= F.col("extra")).cast("long")
    every = every.join(shares.select("of", "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
    return every.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "nth", "rows")


def repeat(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of docs as often as mix() says, all its columns kept, whatever those are called.

    Rows without a copy go: those of null or empty text always do. Rows that agree in id, source and size
    share out their unit's copies in the order of a hash of the text. Null ids and sources are values like
    any other. An empty table gives an empty one."""
    chosen = materialize(mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).filter("copies > 0"), "mixed")
    chosen = chosen.select(F.struct("doc_id", "source", "size").alias("unit"), "nth", "copies", "rows")
    flat, at, back = apart(docs)
    text = F.col(at[text_col])
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    keyed = flat.withColumn("unit", F.struct(F.col(at[id_col]).alias("doc_id"), F.col(at[source_col]).cast("string").alias("source"), words.alias("size")))
    # only rows that share id, source and size with another need a number of their own
    many = materialize(chosen.filter("rows > 1").select("unit").distinct(), "repeated")
    numbered = keyed.withColumn("nth", F.lit(1).cast("long"))
    if not many.isEmpty():
        same = keyed.join(many, "unit", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("unit").orderBy(F.xxhash64(text))).cast("long"))
        numbered = numbered.join(many, "unit", "left_anti").unionByName(same)
    # only the rows of the mix travel if a count finds them few; else texts are shuffled once, by their key
    taken = numbered.join(broadcast_if_small(chosen), ["unit", "nth"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return back(taken)
