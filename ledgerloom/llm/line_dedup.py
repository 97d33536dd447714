"""Removal of lines that spread over many sites, by HyperLogLog sketches and exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.batches import apart
from ledgerloom.shared import BROADCAST_ROWS, broadcast_if_small, materialize

#: A line on at least so many sites is boilerplate.
SITES = 8
#: log2 of a sketch's registers; its relative error is about 1.04 / sqrt(2**LG_K).
LG_K = 10
#: Estimates within so many errors of the threshold are counted exactly.
ERRORS = 5
#: Places of removed lines (and four for each text that has any) that are broadcast at most, of 4 bytes each.
PLACES = 8_000_000
#: White space at the ends of a line does not tell lines apart.
BLANK = " \t\x0b\x0c\r"


def line_key(line: Column) -> list[Column]:
    """96 bits of a trimmed line."""
    own = F.btrim(line, F.lit(BLANK))
    return [F.xxhash64(own).alias("h1"), F.crc32(own.cast("binary")).alias("h2")]


def _lines(text_col: str) -> Column:
    return F.split(F.col(f"`{text_col}`"), "\n", -1)


def _keys(text_col: str) -> Column:
    """The key of each line of a text, null for one of white space."""
    return F.transform(_lines(text_col), lambda x: F.when(F.btrim(x, F.lit(BLANK)) != "", F.struct(*line_key(x))))


def spread(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """h1, h2, n_sites, exact: the lines on at least `sites` distinct sites. A null site is no site."""
    return _spread(docs.select(F.col(f"`{site_col}`").cast("string").alias("site"), _keys(text_col).alias("keys")), sites)


def _spread(rows: DataFrame, sites: int) -> DataFrame:
    """The same of site and keys of the lines.

    Lines are counted by hash first: one that does not occur `sites` times cannot be on as many sites,
    and is let go before any sketch. Sketches merge by aggregation, with a partial one in each task, so
    the most frequent line costs a sketch per task. Estimates near the threshold give way to exact
    distinct counts.
    """
    keyed = rows.filter("site is not null").select("site", F.explode("keys").alias("key")).filter("key is not null").select("site", "key.*")
    often = materialize(keyed.groupBy("h1", "h2").count().filter(F.col("count") >= sites).select("h1", "h2"), "often")
    few = often.count() <= BROADCAST_ROWS
    # where both sides are shuffled, a line is as many rows as it has sites, not as it has places
    asked = keyed.join(F.broadcast(often), ["h1", "h2"]) if few else keyed.distinct().join(often, ["h1", "h2"])
    sketched = materialize(asked.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("n_sites")), "sketched")
    width = ERRORS * 1.04 / 2 ** (LG_K / 2)
    near = F.col("n_sites").between(sites * (1 - width) - 1, sites * (1 + width) + 1)
    close = sketched.filter(near).select("h1", "h2")
    counted = keyed.join(broadcast_if_small(close), ["h1", "h2"]).distinct().groupBy("h1", "h2").agg(F.count("site").alias("n_sites"), F.lit(True).alias("exact"))
    far = sketched.filter(~near).withColumn("exact", F.lit(False))
    return materialize(far.unionByName(counted).filter(F.col("n_sites") >= sites), "spread")


def _removed(flat: DataFrame, text_col: str, site_col: str, sites: int) -> DataFrame:
    """flat (whose columns are c0, c1, …) with kept, n_lines and n_removed.

    Lines are hashed once, into a table beside their rows; what is looked for in it reads no text. The
    places of spread lines go back to their rows, broadcast if a count finds them few."""
    rows = materialize(flat.withColumns({"row": F.monotonically_increasing_id(), "keys": _keys(text_col)}), "rows")
    found = _spread(rows.select(F.col(site_col).cast("string").alias("site"), "keys"), sites).select("h1", "h2")
    places = rows.select("row", F.posexplode("keys").alias("at", "key")).filter("key is not null").select("row", "at", "key.*")
    gone = materialize(places.join(broadcast_if_small(found), ["h1", "h2"], "left_semi").groupBy("row").agg(F.collect_set("at").alias("gone")), "gone")
    # rows hold as many places as lines were removed, so those are what is counted
    n_places = gone.agg(F.coalesce(F.sum(F.size("gone") + 4), F.lit(0))).first()[0]
    met = rows.drop("keys").join(F.broadcast(gone) if n_places <= PLACES else gone, "row", "left")
    kept = F.filter(_lines(text_col), lambda x, i: ~F.array_contains(F.col("gone"), i))
    whole = F.col("gone").isNull()
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_lines(text_col))).cast("long")
    return met.withColumns({"kept": F.when(whole, F.col(text_col)).otherwise(F.array_join(kept, "\n")), "n_lines": n, "n_removed": F.when(whole, 0).otherwise(F.size("gone")).cast("long")}).drop("row", "gone")


def remove_boilerplate(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """docs with kept (the text without its spread lines), n_lines and n_removed.

    Lines end at a line feed; lines of white space alone stay. Null text has no lines and stays null, an
    empty one has one line; a text of boilerplate alone becomes empty. Every row counts, copies and null
    ids too. An empty table gives an empty one; other columns pass through, and a column named like a new
    one (in any case) is replaced by it; clean() keeps all.
    """
    flat, at, _ = apart(docs)
    made = _removed(flat, at[text_col], at[site_col], sites)
    new = ["kept", "n_lines", "n_removed"]
    return made.select(*[made[n].alias(c) for c, n in at.items() if c.lower() not in new], *new)


def clean(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """docs with their texts freed of spread lines, and all their own columns, whatever those are called."""
    flat, at, back = apart(docs)
    return back(_removed(flat, at[text_col], at[site_col], sites).withColumn(at[text_col], F.col("kept")))
