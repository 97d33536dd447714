"""Archives as a data source of Spark's: a task for each archive, read by ranges and inflated as a stream."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.sources.readers import identify_members

#: Rows handed on at a time, and bytes that are hashed at a time.
ROWS, BLOCK = 10_000, 1 << 20
FIXED = T.StructType([T.StructField("archive_id", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("member", T.StringType()), T.StructField("line_number", T.LongType())])


@dataclass
class Archive(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def opened(path: str):
    """A seekable file of any store that Arrow knows."""
    store, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(own)


def digest(path: str) -> str:
    """SHA-256 of a file, read block by block."""
    own = hashlib.sha256()
    with opened(path) as file:
        while block := file.read(BLOCK):
            own.update(block)
    return own.hexdigest()


def headers(archive: zipfile.ZipFile) -> dict[str, list[str]]:
    """Header of every text member, from its first line alone."""
    found = {}
    for name in archive.namelist():
        if name.endswith((".tsv", ".txt")):
            with archive.open(name) as member:
                found[name] = member.readline().decode("utf-8-sig").rstrip("\r\n").split("\t")
    return found


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.role, self.path = options["role"], options["path"]
        self.columns: list[str] | None = json.loads(options["columns"]) if "columns" in options else None
        self.expected: dict[str, str] | None = json.loads(options["expected"]) if "expected" in options else None

    def partitions(self) -> Sequence[InputPartition]:
        folder, remote = self.path.rstrip("/"), "://" in self.path or self.path.startswith("file:")
        store, own = fs.FileSystem.from_uri(folder) if remote else (fs.LocalFileSystem(), folder)
        info = store.get_file_info(own)
        if info.type == fs.FileType.File:
            return [Archive(folder)]
        if info.type != fs.FileType.Directory:
            raise FileNotFoundError(self.path)
        names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(own)) if f.is_file and f.base_name.endswith(".zip"))
        return [Archive(f"{folder}/{n}") for n in names]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        archive_id = partition.path.rsplit("/", 1)[-1].removesuffix(".zip")
        sha = digest(partition.path)
        if self.expected is not None and self.expected.get(archive_id) != sha:
            raise ValueError(f"archive {archive_id} has hash {sha} where {self.expected.get(archive_id)} is expected")
        with opened(partition.path) as file, zipfile.ZipFile(file) as archive:
            told = headers(archive)
            member = identify_members(told)[self.role]
            wanted = None if self.columns is None else [c for c in self.columns if c in told[member]]
            with archive.open(member) as raw:
                # a member none of whose columns is asked for still has its rows counted by the first one
                parts = pd.read_csv(raw, sep="\t", dtype=str, keep_default_na=False, encoding="utf-8-sig", chunksize=ROWS, usecols=None if wanted is None else wanted or told[member][:1])
                for part in parts:
                    n = len(part)
                    fixed = [pa.repeat(pa.scalar(x, pa.string()), n) for x in (archive_id, sha, member)] + [pa.array(part.index.to_numpy() + 2, pa.int64())]
                    if wanted is None:
                        rows = pa.array([[*r.items()] for r in part.to_dict("records")], pa.map_(pa.string(), pa.string()))
                        yield pa.RecordBatch.from_arrays([*fixed, rows], names=[*FIXED.names, "fields"])
                    else:
                        text = [pa.array([x or None for x in part[c]], pa.string()) if c in wanted else pa.nulls(n, pa.string()) for c in self.columns]
                        yield pa.RecordBatch.from_arrays([*fixed, *text], names=[*FIXED.names, *self.columns])


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledgerloom_archives"

    def schema(self) -> T.StructType:
        if "columns" in self.options:
            return T.StructType([*FIXED.fields, *[T.StructField(c, T.StringType()) for c in json.loads(self.options["columns"])]])
        return T.StructType([*FIXED.fields, T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArchiveReader({k: self.options[k] for k in ("role", "path", "columns", "expected") if k in self.options})


def archive_rows(spark: SparkSession, path: str, role: str, columns: list[str] | None = None, expected: dict[str, str] | None = None) -> DataFrame:
    """Rows of one role's member in every archive of a folder (or of one archive), as zip_rows() has them.

    Each archive is read by ranges and inflated as a stream, so a task holds some thousand rows and never
    an archive or a member, however large. columns are those that are read and returned, as texts (blank is
    null, a column that a member lacks is null); without them a row is a map of all its fields. expected has
    the hash that each archive must have; another one, or one that it does not name, is refused. The store
    must be one that Arrow opens by its path; for any other there is zip_rows()."""
    spark.dataSource.register(Archives)
    given = {"path": path, "role": role} | ({"columns": json.dumps(columns)} if columns is not None else {}) | ({"expected": json.dumps(expected)} if expected is not None else {})
    return spark.read.format("ledgerloom_archives").options(**given).load()
