"""Scans: text tables of strings, archives known by their headers, columnar JSON, link lists and caches."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import values as V

#: Columns by which the members of an archive are told apart.
SUBMISSION = {"adsh", "cik", "name", "form", "period", "accepted", "filed"}
HOLDINGS = {"adsh", "ddate"}
FORMS = ("10-Q", "10-K")


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_table(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """A delimited file with a header as strings, blank as null; a header of other columns is refused."""
    return spark.read.schema(strings(columns)).options(header=True, sep=sep, enforceSchema=False, encoding="UTF-8", multiLine=True, escape='"', nullValue="").csv(path)


def header(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """Column names of a file, from its first line alone."""
    line = spark.read.text(path).first()
    return line.value.removeprefix("﻿").rstrip("\r").split(sep) if line else []


def member_headers(content: bytes, sep: str = "\t") -> dict[str, list[str]]:
    """Header of every text member of a ZIP archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return {m: archive.open(m).readline().decode("utf-8-sig").rstrip("\r\n").split(sep) for m in archive.namelist() if m.endswith((".tsv", ".txt"))}


def identify_members(headers: dict[str, list[str]]) -> dict[str, str]:
    """Which member holds submissions and which holdings, by their columns and not their names."""
    wanted = {"submissions": lambda h: h >= SUBMISSION, "holdings": lambda h: h >= HOLDINGS and any("Identifier Axis" in c or "Fair Value" in c for c in h)}
    found = {k: [m for m, h in headers.items() if test(set(h))] for k, test in wanted.items()}
    odd = {k: v for k, v in found.items() if len(v) != 1}
    if odd:
        raise ValueError(f"members that cannot be told: {odd}")
    return {k: v[0] for k, v in found.items()}


def zip_rows(spark: SparkSession, path: str, role: str, expected: dict[str, str] | None = None) -> DataFrame:
    """archive_id, sha256, member, line_number and fields (a map) of one role's rows in many archives.

    Each archive is opened where Spark reads it and its rows are handed on in batches; line numbers count
    from the header as 1. One archive is one task's work and memory, so archives should stay below some
    hundred MB. expected has the hash that each archive must have; another one, or one that it does not
    name, is refused."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, sha, content in zip(batch["path"], batch["sha256"], batch["content"], strict=True):
                archive_id = name.rsplit("/", 1)[-1].removesuffix(".zip")
                if expected is not None and expected.get(archive_id) != sha:
                    raise ValueError(f"archive {archive_id} has hash {sha} where {expected.get(archive_id)} is expected")
                member = identify_members(member_headers(content))[role]
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as raw:
                    rows = pd.read_csv(raw, sep="\t", dtype=str, keep_default_na=False, encoding="utf-8-sig", chunksize=10_000)
                    for part in rows:
                        yield pd.DataFrame({"archive_id": archive_id, "sha256": sha, "member": member, "line_number": part.index + 2, "fields": part.to_dict("records")})

    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")
    return files.mapInPandas(unpack, "archive_id string, sha256 string, member string, line_number long, fields map<string,string>")


def widen(rows: DataFrame, columns: list[str], field: str = "fields") -> DataFrame:
    """Named columns out of a map of fields; blanks are null."""
    return rows.select(*[c for c in rows.columns if c != field], *[F.nullif(F.try_element_at(field, F.lit(c)), F.lit("")).alias(c) for c in columns])


def submissions(rows: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Quarterly and annual reports of the universe (cik, ticker), or of all filers, whose ticker is then CIK and the number."""
    number = lambda c: F.regexp_replace(c.cast("string"), "^0+", "")
    own = rows.filter(F.col("form").isin(*FORMS)).withColumn("cik", number(F.col("cik"))).filter("cik != ''")
    if universe is None:
        own = own.withColumn("ticker", F.concat(F.lit("CIK"), "cik"))
    else:
        own = own.join(universe.select(number(F.col("cik")).alias("cik"), "ticker"), "cik")
    return own.select("adsh", "cik", "ticker", F.col("name").alias("filer_name"), "form", "filed", V.iso_date(F.col("period")).alias("period_end"), V.timestamp(F.col("accepted")).alias("accepted"))


def entities(rows: DataFrame) -> DataFrame:
    """cik, name (the last seen) and archives of all filers of quarterly and annual reports (rows of zip_rows, widened)."""
    own = rows.filter(F.col("form").isin(*FORMS)).withColumn("cik", F.regexp_replace(F.col("cik").cast("string"), "^0+", "")).filter("cik != ''")
    return own.groupBy("cik").agg(F.max_by("name", F.struct("archive_id", "line_number")).alias("name"), F.array_sort(F.collect_set("archive_id")).alias("archives"))


def links(html: Column, pattern: str) -> Column:
    """Distinct targets of links that match a pattern."""
    return F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit(r'(?i)href\s*=\s*["\']([^"\']+)["\']'), F.lit(1)), lambda x: x.rlike(pattern)))


def unzip_arrays(payload: DataFrame, columns: list[str], struct: str = "recent") -> DataFrame:
    """A struct of equally long arrays as a row for each place."""
    own = [c for c in payload.columns if c != struct]
    return payload.select(*own, F.explode(F.arrays_zip(*[F.col(f"{struct}.{c}").alias(c) for c in columns])).alias("_x")).select(*own, "_x.*")


def variant_arrays(rows: DataFrame, text: str, path: str, columns: list[str]) -> DataFrame:
    """unzip_arrays() of JSON text whose shape is not known beforehand: the other columns of rows, place (from 0) and
    the named members of the object at path as texts. Arrays may be missing, shorter than others, or no
    arrays; what is not there is null, and a text without any of them has no row."""
    record = F.try_parse_json(F.col(text))
    own = [c for c in rows.columns if c != text]
    arrays = rows.select(*own, *[F.try_variant_get(record, f"{path}.{c}", "array<string>").alias(f"_a{i}") for i, c in enumerate(columns)])
    one = arrays.select(*own, F.posexplode(F.arrays_zip(*[F.coalesce(f"_a{i}", F.array().cast("array<string>")).alias(f"x{i}") for i in range(len(columns))])).alias("place", "_x"))
    return one.select(*own, "place", *[F.col(f"_x.x{i}").alias(c) for i, c in enumerate(columns)])


def event_items(payload: DataFrame, title_like: str, items: str = "items") -> DataFrame:
    """Events of index pages (an array of items with id, title, code and time), those with a title and a four-digit code."""
    flat = payload.select(F.explode(items).alias("_x")).select("_x.*")
    code = F.regexp_extract(F.col("company_code"), r"(\d{4})", 1)
    return flat.filter(F.col("title").contains(title_like) & (code != "")).withColumn("security_code", code)


def company_matches(page: DataFrame, names: list[str], text: str = "html") -> DataFrame:
    """cik and name of search results whose name is one of those looked for."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"CIK=(\d{10})[^>]*>([^<]+)<"), F.lit(0))
    one = page.select(F.explode(found).alias("_m"))
    hit = one.select(F.regexp_extract("_m", r"CIK=(\d{10})", 1).alias("cik"), F.trim(F.regexp_extract("_m", r">([^<]+)<", 1)).alias("name"))
    return hit.filter(F.lower("name").isin(*[n.lower() for n in names])).distinct()


def multi_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """All values of a key, sorted."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(value + "s"))


def index_probe(items: DataFrame, keyword: str, samples: int = 2) -> DataFrame:
    """For each period how many items its index page lists, how many titles match, and whether the first
    documents of each kind answered (period, place, title, document_alive, data_alive; null for no link)."""
    first = lambda c: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("place", c)))), lambda x: x[c]), 1, samples)
    # the first of each kind are ranked in their tasks, so that no page is held whole
    rank = lambda c: F.row_number().over(Window.partitionBy("period", F.col(c).isNull()).orderBy("place"))
    counts = items.groupBy("period").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("title").rlike(keyword)).alias("matching"))
    for c in ("document_alive", "data_alive"):
        few = items.select("period", "place", c).withColumn("_n", rank(c)).filter((F.col("_n") <= samples) & F.col(c).isNotNull())
        counts = counts.join(few.groupBy("period").agg(first(c).alias(c)), "period", "left")
    return counts


def alive(status: Column, size: Column) -> Column:
    return F.coalesce((status == 200) & (size > 500), F.lit(False))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """The table, refused unless it has just so many rows."""
    n = df.count()
    if n != rows:
        raise ValueError(f"{n} rows where {rows} are expected")
    return df
