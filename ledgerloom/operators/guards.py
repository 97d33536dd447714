"""Checks that stop a run: schemas, hashes, universes and outputs that exist."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: set[str]) -> DataFrame:
    missing = sorted(required - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def same_members(left: DataFrame, right: DataFrame) -> DataFrame:
    """What is in just one of two tables of the same columns."""
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))


def require_same(left: DataFrame, right: DataFrame) -> None:
    odd = same_members(left, right).head(5)
    if odd:
        raise ValueError(f"tables differ: {odd}")


def ids_digest(ids: DataFrame, column: str) -> DataFrame:
    """A hash of all ids whatever their order: of hashes summed up, so no task holds them all."""
    h = F.conv(F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return ids.agg(F.count(column).alias("n"), F.sum(h).alias("digest"))


#: Ids, at most, whose list is hashed as one text.
LISTED_IDS = 1_000_000


def id_list_digest(ids: DataFrame, column: str, most: int = LISTED_IDS) -> str:
    """SHA-256 of the sorted ids as one JSON list; as that is one text, more than `most` ids are refused."""
    own = [r[0] for r in ids.select(F.col(column).cast("string")).limit(most + 1).collect()]
    if len(own) > most:
        raise ValueError(f"more than {most} ids: use ids_digest")
    return hashlib.sha256(json.dumps(sorted(own), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def require_ids(ids: DataFrame, column: str, expected: str) -> DataFrame:
    """ids, refused unless they are those of a frozen hash."""
    found = id_list_digest(ids, column)
    if found != expected:
        raise RuntimeError(f"ids changed after freeze: frozen={expected} current={found}")
    return ids


def require_hash(content: bytes, expected: str) -> str:
    """The hash of a script or file that must not have changed since it was frozen."""
    found = hashlib.sha256(content).hexdigest()
    if found != expected:
        raise RuntimeError(f"changed after freeze: frozen={expected} current={found}")
    return found


def unique_key(df: DataFrame, keys: list[str]) -> None:
    again = df.groupBy(*keys).count().filter("count > 1").head(1)
    if again:
        raise ValueError(f"key {keys} repeats: {again[0]}")
