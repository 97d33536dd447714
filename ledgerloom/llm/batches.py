"""Arrow plumbing that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A task works on about this many bytes of text at a time (one text is never cut).
CHUNK_BYTES = 2 << 20


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in column have about CHUNK_BYTES together."""
    if not batch.num_rows:
        return
    start = size = 0
    for i, n in enumerate(_lengths(batch, column)):
        if size and size + n > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def _lengths(batch: pa.RecordBatch, column: str) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.schema.field(column).type) else pa.binary()
    return [x or b"" for x in batch.column(column).cast(kind).to_pylist()]


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """(df under the names c0, c1, …, the name that each column has there, and the way back to df's own
    columns), so that columns which an operator adds meanwhile clash with none of the caller's."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}

    def back(made: DataFrame) -> DataFrame:
        return made.select(*[made[n].alias(c) for c, n in names.items()])

    return df.toDF(*names.values()), names, back


def append_columns(df: DataFrame, fields: list[T.StructField], start: Callable[[], Callable], inputs: list[str]) -> DataFrame:
    """df with columns that Python computes batch by batch, without a shuffle.

    start() runs once in each task and returns a function from a RecordBatch with the inputs (the
    first is the text) to the new Arrow arrays. Every other column passes through untouched,
    whatever its name; a column of the same name as a new one (in any case) is replaced by it.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    new = [f"r{i}" for i in range(len(fields))]
    flat = df.toDF(*names)
    at = [df.columns.index(x) for x in inputs]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)] + [T.StructField(n, f.dataType) for n, f in zip(new, fields, strict=True)])
    first = inputs[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for whole in batches:
            for batch in chunks(whole, names[at[0]]):
                picked = pa.RecordBatch.from_arrays([batch.column(i) for i in at], names=inputs)
                yield pa.RecordBatch.from_arrays([*batch.columns, *compute(picked)], names=[*names, *new])

    assert first in df.columns
    made = flat.mapInArrow(run, schema)
    own = {f.name.lower() for f in fields}
    kept = [made[n].alias(c) for n, c in zip(names, df.columns, strict=True) if c.lower() not in own]
    return made.select(*kept, *[made[n].alias(f.name) for n, f in zip(new, fields, strict=True)])


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Just the columns named on the left, under the names on the right, so that others cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in named.items()])


def remainder(doc_id, n: int):
    """crc32 of a document's id as text, modulo n; null where the id is."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
