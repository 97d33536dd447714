"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import append_columns, apart, columns, texts
from ledgerloom.llm.components import components
from ledgerloom.llm.words import spaced_words
from ledgerloom.shared import broadcast_if_small, materialize

SHINGLE = 3
SEED = 42
#: Fingerprints of at most this many differing bits are linked; the segments below are made for it.
DISTANCE = 3
#: Segment tables hold the fingerprints of a value; a fuller one is split by the other segment's halves.
FULL = 128
_SLICE = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: a bit is set if it is in over half of the shingles' hashes."""
    words = spaced_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    pieces = zip(starts.tolist(), ends[k - 1 :].tolist(), strict=False)
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pieces), np.dtype("<u8"), len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _SLICE):
        ones += np.unpackbits(h[i : i + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """docs with a long fingerprint column, in a map without a shuffle; null text has fingerprint 0."""

    def start():
        return lambda batch: [pa.array([fingerprint(x, shingle) for x in texts(batch, text_col)], pa.int64())]

    return append_columns(docs, [T.StructField(name, T.LongType())], start, [text_col])


def _ball(value: Column, bits: int, upward: bool = False) -> Column:
    """The value and those that differ from it in one of its bits; upward: only by setting one."""
    near = [F.when((value.bitwiseAND(F.lit(1 << i)) == 0), value + F.lit(1 << i)) if upward else value.bitwiseXOR(F.lit(1 << i)) for i in range(bits)]
    return F.filter(F.array(value, *near), lambda x: x.isNotNull())


def links(prints: DataFrame) -> DataFrame:
    """a, b: pairs of the distinct fingerprints (column fp) that differ in at most DISTANCE bits.

    Of two segments of 32 bits, one differs in at most one bit: each fingerprint looks up its segments
    and the values that set one more bit of them (the partner does so for bits to clear) in the
    segment's table. A value with over FULL fingerprints is looked up again by the halves of the other
    segment, of which again one differs in at most one bit; such a table holds at most 2**16
    fingerprints. Every pair met is compared whole, inside the join, so only links leave it; and as a
    fingerprint has fewer than 2**16 neighbours within 3 bits, links grow with the fingerprints.
    Spark sizes the probes as if they had not been exploded, by which it would broadcast some 35 rows for
    each fingerprint; the hints have both sides shuffled and sorted instead.
    """
    low = F.lit((1 << 32) - 1)
    fp = F.col("fp")
    halves = F.array(F.struct(F.lit(0).alias("seg"), fp.bitwiseAND(low).alias("value"), F.shiftrightunsigned(fp, 32).alias("rest")), F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned(fp, 32).alias("value"), fp.bitwiseAND(low).alias("rest")))
    table = prints.select(fp, F.inline(halves))
    full = materialize(table.groupBy("seg", "value").count().filter(F.col("count") > FULL).select("seg", "value"), "full")
    probes = table.select(fp.alias("other"), "seg", F.col("value").alias("own"), "rest", F.explode(_ball(F.col("value"), 32, upward=True)).alias("value"))
    near = F.bit_count(fp.bitwiseXOR(F.col("other"))) <= DISTANCE
    once = (F.col("own") != F.col("value")) | (fp > F.col("other"))
    pair = [F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")]
    if full.isEmpty():
        return table.drop("rest").join(probes.drop("rest").hint("merge"), ["seg", "value"]).filter(near & once).select(*pair)
    few = broadcast_if_small(full)
    cold = table.drop("rest").join(few, ["seg", "value"], "left_anti").join(probes.drop("rest").hint("merge"), ["seg", "value"])
    quarter = lambda x: F.array(F.struct(F.lit(0).alias("part"), x.bitwiseAND(F.lit(0xFFFF)).alias("bits")), F.struct(F.lit(1).alias("part"), F.shiftrightunsigned(x, 16).alias("bits")))
    hot = table.join(few, ["seg", "value"], "left_semi").select("fp", "seg", "value", F.inline(quarter(F.col("rest"))))
    asked = probes.join(few, ["seg", "value"], "left_semi").select("other", "seg", "own", "value", F.inline(quarter(F.col("rest"))))
    asked = asked.select("other", "seg", "own", "value", "part", F.explode(_ball(F.col("bits"), 16)).alias("bits"))
    warm = hot.join(asked.hint("merge"), ["seg", "value", "part", "bits"])
    return cold.filter(near & once).select(*pair).unionByName(warm.filter(near & once).select(*pair))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links of at most 3 bits lead to.

    Documents of one fingerprint are a single node, however many they are. Texts without a word have
    fingerprint 0 and are linked like any other; null text is such a text. Repeated rows each get a
    row. Null ids get the component of their fingerprint (null if no id is reachable). An empty table
    gives an empty one. Other columns are not looked at.
    """
    return _grouped(docs, id_col, text_col, shingle).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """near_duplicates with root, the component's smallest fingerprint, which no other component shares."""
    named = columns(docs, **{id_col: "doc_id", text_col: "text"})
    rows = materialize(fingerprints(named, "text", "fp", shingle).select("doc_id", "fp"), "prints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(links(prints.select("fp")))
    groups = materialize(prints.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "groups")
    roots = materialize(groups.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    of = materialize(groups.join(roots, "root").select(F.col("fp").alias("print"), "root", "component_id"), "of")
    # both sides are read from tables, so Spark can split the fingerprint of a large group of copies
    return rows.join(of, F.col("fp") == F.col("print"), "left").select("doc_id", "fp", "root", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns, whatever those are called.

    Rows without an id are kept, as nothing tells them apart. Rows that repeat an id count by their own
    texts: one stays in each group of which the id is the smallest, by fingerprint and a hash of the text.
    Null and wordless texts are one group. An empty table gives an empty one.
    """
    found = materialize(_grouped(docs, id_col, text_col, shingle), "found")
    fate = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    fate = materialize(fate.filter("n > 1 or not stays"), "fate")
    flat, at, back = apart(docs)
    own, text = F.col(at[id_col]), F.col(at[text_col])
    kept = flat.join(broadcast_if_small(fate.filter("not stays").select(F.col("doc_id").alias("gone"))), own == F.col("gone"), "left_anti")
    again = fate.filter("stays").select(F.col("doc_id").alias("again"))
    if again.isEmpty():
        return back(kept)
    few = broadcast_if_small(again)
    least = found.filter("doc_id = component_id").join(few, F.col("doc_id") == F.col("again"), "left_semi").select(F.col("doc_id").alias("id"), F.col("fp").alias("print"), "root").distinct()
    rows = fingerprints(kept.join(few, own == F.col("again"), "left_semi"), at[text_col], "fp", shingle).join(least, (own == F.col("id")) & (F.col("fp") == F.col("print")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "root").orderBy("fp", F.xxhash64(text), text))).filter("n = 1")
    return back(kept.join(few, own == F.col("again"), "left_anti").unionByName(rows.select(*at.values())))
