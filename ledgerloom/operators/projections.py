"""Projections that shape tables: defaults, overrides, migrations, allow-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_defaults(rows: DataFrame, template: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """The template's columns in its order and types; what rows lack is null or a default."""
    given = defaults or {}
    out = []
    for f in template.fields:
        c = F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)
        if f.name in given:
            c = F.coalesce(c, F.lit(given[f.name]))
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def preserve(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, with the values that an existing row of the same key has."""
    kept = [c for c in new.columns if c not in keys and c in existing.columns]
    old = existing.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in kept])
    met = new.join(old, keys, "left")
    return met.select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in kept else F.col(c) for c in new.columns])


def migrate(rows: DataFrame, template: T.StructType) -> DataFrame:
    """All rows and their columns, and those of the template that are new, as nulls; types that differ are refused."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    odd = [f.name for f in template.fields if f.name in types and types[f.name] != f.dataType]
    if odd:
        raise ValueError(f"columns of another type: {odd}")
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in template.fields if f.name not in types})


def supersede(rows: DataFrame, status: str, reason: str) -> DataFrame:
    """Every row marked as superseded, with the reason."""
    return rows.withColumns({"status": F.lit(status), "status_reason": F.lit(reason)})


def fan_out(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """A row for each label whose condition holds."""
    labels = F.array_compact(F.array(*[F.when(test, label) for label, test in named.items()]))
    return rows.withColumn("label", F.explode(labels))


def allow(rows: DataFrame, columns: list[str], forbidden: list[str]) -> DataFrame:
    both = sorted(set(columns) & set(forbidden))
    if both:
        raise ValueError(f"columns both allowed and forbidden: {both}")
    return rows.select(*columns)
