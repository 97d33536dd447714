"""Sinks: distributed tables, single small files for people, and outputs that are never overwritten."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, replace: bool = False) -> None:
    """Parquet, in folders by columns; an output that exists is kept unless it is to be replaced."""
    df.write.mode("overwrite" if replace else "errorifexists").partitionBy(*(partition_by or [])).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Every column as text: booleans capitalised, arrays and maps as JSON, null as blank."""
    shown = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        text = F.initcap(c.cast("string")) if kind == "boolean" else F.to_json(c) if kind in ("array", "map", "struct") else c.cast("string")
        shown.append(F.coalesce(text, F.lit("")).alias(f.name))
    return df.select(*shown)


def commit(df: DataFrame, path: str, write: Callable[[DataFrameWriter, str], None], refuse: Callable[[dict], str | None], **counts: Column) -> None:
    """Write df beside path while n_rows and counts are taken of it, and give it its name only if refuse() says nothing of them.

    The table is computed once. One that is refused, or whose writing fails, leaves nothing; an output
    that exists is kept, and an error."""
    spark = df.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    own, staged = fs.Path(path), fs.Path(f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}")
    files = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(own):
        raise FileExistsError(path)
    watch = Observation("commit")
    try:
        write(df.observe(watch, F.count(F.lit(1)).alias("n_rows"), *[c.alias(n) for n, c in counts.items()]).write.mode("errorifexists"), staged.toString())
        why = refuse(watch.get)
        if why:
            raise ValueError(why)
        if not files.rename(staged, own):
            raise FileExistsError(path)
    finally:
        files.delete(staged, True)


def write_csv(df: DataFrame, path: str, fields: list[str], order: list[str] | None = None) -> None:
    """A delimited table of fixed columns, sorted with nulls last; Spark writes as many files as the rows
    need. A table without rows is refused."""
    rows = df.select(*fields)
    text = flat(rows.orderBy(*[F.col(c).asc_nulls_last() for c in order]) if order else rows)
    commit(text, path, lambda w, to: w.options(header=True, lineSep="\n", emptyValue="", escape='"').csv(to), lambda n: None if n["n_rows"] else "no rows to write")


def write_pair(public: DataFrame, private: DataFrame, path: str) -> None:
    """A public table and the key to it, in folders of their own."""
    public.write.mode("errorifexists").parquet(f"{path}/public")
    private.write.mode("errorifexists").parquet(f"{path}/private")


def write_guarded(df: DataFrame, path: str, odd: Column) -> None:
    """A table none of whose rows is odd; else nothing is written."""
    commit(df, path, lambda w, to: w.parquet(to), lambda n: f"{n['odd']} rows must not be written" if n["odd"] else None, odd=F.count_if(odd))


def write_summary(df: DataFrame, path: str, rows: int = 1000) -> None:
    """summary_json() as a text file."""
    df.sparkSession.createDataFrame([(summary_json(df, rows).rstrip("\n"),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def summary_json(df: DataFrame, rows: int = 1000) -> str:
    """A small summary as JSON with sorted keys; more rows than a summary has are refused."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows are no summary")
    return json.dumps([r.asDict(recursive=True) for r in got], ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n"
