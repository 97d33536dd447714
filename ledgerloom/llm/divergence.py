"""How far the sources of each language lie apart in their words: an audit over smoothed term frequencies."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.batches import chunks, columns, texts
from ledgerloom.shared import broadcast_if_small, materialize

#: A term counts if it is in so many documents of its language.
LEAST_DOCUMENTS = 30
#: What is added to every count, and what a frequency of 1 amounts to.
SMOOTHING, UNIT = 5, 1_000_000_000
#: Terms listed for a group.
TOP = 50
#: A term in more than one of so many groups of its language is heavy.
HEAVY = 4
#: Terms (about) and groups of a tile.
TILE_TERMS, TILE_GROUPS = 2048, 256
#: A task holds so many counts before it passes them on, and takes a long text apart in parts of about so many bytes.
HELD, PART = 300_000, 1 << 20

#: Letters of ASCII in lower case and all bytes of other characters; the rest is a space.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    plain, at = text.translate(LETTERS), 0
    while (cut := plain.find(b" ", at + PART)) >= 0:
        yield plain[at:cut].split()
        at = cut + 1
    yield plain[at:].split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and documents of docs (lang, source, text).

    Tasks count before anything is shuffled, so a frequent term or a large source is a row for each
    task (or for each time that a task's counts are full). Every group has a row with a null term too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        documents: dict[tuple, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                named = list(own)
                rows = [pa.array([lang] * (len(named) + 1)), pa.array([source] * (len(named) + 1)), pa.array([None, *named], pa.binary()).cast(pa.string()), pa.array([0, *own.values()], pa.int64()), pa.array([0, *map(documents[lang, source].__getitem__, named)], pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, names=["lang", "source", "term", "n", "documents"])
            n.clear()
            documents.clear()

        held = 0
        for whole in batches:
            for batch in chunks(whole, "text"):
                for group, text in zip(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True), texts(batch), strict=True):
                    own, seen = n[group], set()
                    held -= len(own)
                    for words in _parts(text):
                        own.update(words)
                        seen.update(words)
                    documents[group].update(seen)
                    held += len(own)
                    if held > HELD:
                        yield from flush()
                        held = 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, documents long")


def frequency(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * terms)), exact for any long."""
    over = (F.lit(UNIT).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(20,0)")).cast("decimal(38,0)")
    below = (total + terms * SMOOTHING).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", over, below) + 1).otherwise(0).cast("long")


def partial_sums(cells: pd.DataFrame, groups: pd.DataFrame, left: int, right: int) -> pd.DataFrame:
    """a, b, value: sums over the terms of one block, for the pairs of a group of one tile with one of
    another, of what |p - q| is above its value for a term that both lack.

    cells: at (number of the group), term, p, heavy. groups: tile, at, absent (p of a term without
    occurrence). Heavy terms fill dense tiles. Of a light term, each group that has it corrects its pairs
    with all others at once, by the sums over its sorted p on both sides of each q, and pairs of groups
    that both have it are put right one by one."""
    sides = [groups[groups["tile"] == t].sort_values("at") for t in (left, right)]
    at_a, at_b = (s["at"].to_numpy() for s in sides)
    absent_a, absent_b = (s["absent"].to_numpy() for s in sides)
    sums = np.zeros((len(at_a), len(at_b)), np.int64)
    both_absent = np.abs(absent_a[:, None] - absent_b[None, :])
    heavy = cells["heavy"].to_numpy(bool)
    _add_heavy(sums, cells[heavy], at_a, at_b, absent_a, absent_b)
    light = cells[~heavy]
    if len(light):
        term = pd.factorize(light["term"])[0]
        order = np.lexsort((light["at"].to_numpy(), term))
        term, at, p = term[order], light["at"].to_numpy()[order], light["p"].to_numpy()[order]
        for i, (n, away) in enumerate(_away(at, p, at_a, absent_b)):
            sums[i] += away - n * both_absent[i]
        for j, (n, away) in enumerate(_away(at, p, at_b, absent_a)):
            sums[:, j] += away - n * both_absent[:, j]
        _add_pairs(sums, term, at, p, at_a, at_b, absent_a, absent_b)
    i, j = np.nonzero(at_a[:, None] < at_b[None, :])
    return pd.DataFrame({"a": at_a[i], "b": at_b[j], "value": sums[i, j]})


def _add_heavy(sums: np.ndarray, heavy: pd.DataFrame, at_a, at_b, absent_a, absent_b) -> None:
    if not len(heavy):
        return
    term, named = pd.factorize(heavy["term"])
    tiles = []
    for own, absent in ((at_a, absent_a), (at_b, absent_b)):
        tile = np.repeat(absent[None, :], len(named), axis=0)
        mine = np.isin(heavy["at"].to_numpy(), own)
        tile[term[mine], np.searchsorted(own, heavy["at"].to_numpy()[mine])] = heavy["p"].to_numpy()[mine]
        tiles.append(tile)
    for i in range(len(at_a)):
        sums[i] += np.abs(tiles[1] - tiles[0][:, i : i + 1]).sum(axis=0) - len(named) * np.abs(absent_b - absent_a[i])


def _away(at: np.ndarray, p: np.ndarray, own: np.ndarray, absent: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each own group the number of its postings and, for each q of absent, the sum of |p - q| over them."""
    order = np.lexsort((p, at))
    at, p = at[order], p[order]
    starts, ends = np.searchsorted(at, own), np.searchsorted(at, own, side="right")
    for lo, hi in zip(starts, ends, strict=True):
        mine = p[lo:hi]
        upto = np.concatenate([[0], np.cumsum(mine)])
        k = np.searchsorted(mine, absent)
        yield hi - lo, upto[-1] - 2 * upto[k] + (2 * k - (hi - lo)) * absent


def _add_pairs(sums: np.ndarray, term, at, p, at_a, at_b, absent_a, absent_b) -> None:
    """Corrections of the pairs of groups that share a light term; postings of a term are neighbours here, by group."""
    in_a, in_b = np.isin(at, at_a), np.isin(at, at_b)
    place_a, place_b = np.searchsorted(at_a, at).clip(max=len(at_a) - 1), np.searchsorted(at_b, at).clip(max=len(at_b) - 1)
    for step in range(1, len(term)):
        same = term[step:] == term[:-step]
        if not same.any():
            return
        x = np.flatnonzero(same & in_a[:-step] & in_b[step:])
        y = x + step
        i, j = place_a[x], place_b[y]
        q, r = absent_a[i], absent_b[j]
        np.add.at(sums, (i, j), np.abs(p[x] - p[y]) - np.abs(p[x] - r) - np.abs(p[y] - q) + np.abs(q - r))


def audit(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group.

    Part `pair`: item is another source of the language, value the summed difference of the two groups'
    smoothed frequencies (in UNIT-ths) over the language's kept terms. Part `term`: item is a term that is
    more frequent in the group than in the language, value by how much; the first `top` of them. Ranks
    start at 1 in each group and part, by falling value, then by the item's bytes.

    Null lang, source and text are empty ones; rows with the same id are documents of their own. A
    language without kept terms has pairs of value 0, a group without terms has pairs too, a single
    source has none. An empty table gives an empty one; other columns are not looked at. Texts are counted
    part by part, so that a long one takes a few times its size beside its distinct terms.

    Terms of a language meet in blocks, and groups in tiles, so that a task's work is bounded; what it
    returns is a sum for each pair of groups. No part of it grows with the documents.
    """
    named = columns(docs, **{lang_col: "lang", source_col: "source", text_col: "text"})
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counts = counted(named.select(*empty)).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    counts = materialize(counts, "terms")
    term = Window.partitionBy("lang", "term")
    met = counts.filter("term is not null").select("lang", "source", "term", "n", F.sum("documents").over(term).alias("documents"), F.count("*").over(term).alias("spread"), F.sum("n").over(term).alias("whole"), (F.row_number().over(term.orderBy("source")) == 1).cast("long").alias("first"))
    cells = materialize(met.filter(F.col("documents") >= least).drop("documents"), "cells")

    langs = cells.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    own = Window.partitionBy("lang")
    groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.withColumns({"at": F.row_number().over(own.orderBy("source")) - 1, "groups": F.count("*").over(own), "absent": frequency(F.lit(0), F.col("total"), F.col("terms"))})
    groups = groups.withColumns({"tile": F.floor(F.col("at") / TILE_GROUPS).cast("int"), "tiles": F.ceil(F.col("groups") / TILE_GROUPS).cast("int"), "blocks": F.greatest(F.ceil(F.col("terms") / TILE_TERMS), F.lit(1)).cast("int")})
    groups = materialize(groups, "groups")

    placed = cells.join(broadcast_if_small(groups), ["lang", "source"]).withColumn("p", frequency(F.col("n"), F.col("total"), F.col("terms")))
    def tiled(rows: DataFrame, *names: str | Column) -> DataFrame:
        """rows once for each pair of tiles that their group's tile is part of."""
        other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return other.select("lang", "block", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), *names)

    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    sparse = tiled(placed.withColumns({"block": block, "heavy": F.col("spread") * HEAVY > F.col("groups")}), "at", "term", "p", "heavy")
    members = tiled(groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "tile", F.col("at").alias("at"), "absent")

    def sums(key: tuple, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        made = partial_sums(cells, groups, key[2], key[3])
        made.insert(0, "lang", key[0])
        return made

    keys = ["lang", "block", "left", "right"]
    pairs = sparse.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(sums, "lang string, a int, b int, value long")
    pairs = materialize(pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    first = broadcast_if_small(groups.select("lang", "terms", F.col("at").alias("a"), "source", F.col("absent").alias("absent_a")))
    second = broadcast_if_small(groups.select("lang", F.col("at").alias("b"), F.col("source").alias("item"), F.col("absent").alias("absent_b")))
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    told = both.join(first, ["lang", "a"]).join(second, ["lang", "b"])
    pair = told.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.col("terms") * F.abs(F.col("absent_a") - F.col("absent_b"))).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    whole = frequency(F.col("whole"), F.col("lang_total"), F.col("terms"))
    over = placed.filter("n > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - whole).alias("value")).filter("value > 0")
    return pair.withColumn("rank", rank).unionByName(over.withColumn("rank", rank).filter(F.col("rank") <= top))
