"""Streams whose place is the last key or file that was read: a run goes on after it, whether the one before ended or was cut off.

The place is the stream's offset, so the checkpoint holds it: a batch that was not committed is read again, and one that was is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def _files(folder: str, suffix: str) -> tuple[fs.FileSystem, list[str]]:
    """The store and the paths of a folder's files, or of the one file that it is, in order of their names; hidden ones are left out."""
    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(path).type == fs.FileType.File:
        return store, [path]
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return store, sorted(f.path for f in found if f.is_file and f.path.endswith(suffix) and f.base_name[0] not in "._")


def _name(path: str) -> str:
    return path.rpartition("/")[2]


@dataclass
class SpoolFile(InputPartition):
    path: str


class SpoolReader(DataSourceStreamReader):
    """Lines of a folder's files, a task for each file; files are taken in order of their names, as a spool names them."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix = options["path"], options.get("suffix", ".json")

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        names = [_name(f) for f in _files(self.folder, self.suffix)[1]]
        return {"file": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [SpoolFile(f) for f in _files(self.folder, self.suffix)[1] if start["file"] < _name(f) <= end["file"]]

    def read(self, partition: SpoolFile) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(partition.path) as f:
            rest, place = b"", 0
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    yield _name(partition.path), place, line.decode("utf-8", "replace")
                    place += 1
            if rest:
                yield _name(partition.path), place, rest.decode("utf-8", "replace")


class Spool(DataSource):
    """Format `spool`: file, place and line of a folder's files. Options: path, suffix."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return "file string, place long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SpoolReader(self.options)


@dataclass
class Group(InputPartition):
    path: str
    group: int
    after: int
    upto: int


class KeysetReader(DataSourceStreamReader):
    """Rows of a Parquet table with keys after the last, a task for each row group that can hold some.

    Which can is told by the files' statistics; they also give the greatest key, so nothing is read to find the place.
    """

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.key, self.columns = options["path"], options["key"], schema.names

    def _groups(self) -> Iterator[tuple[str, int, int, int]]:
        """(path, row group, least key, greatest key) of the table's row groups with any key."""
        store, paths = _files(self.path, ".parquet")
        for path in paths:
            with store.open_input_file(path) as f:
                meta = pq.ParquetFile(f).metadata
                at = meta.schema.names.index(self.key)
                for g in range(meta.num_row_groups):
                    stats = meta.row_group(g).column(at).statistics
                    if stats is not None and stats.has_min_max:
                        yield path, g, stats.min, stats.max
                    elif meta.row_group(g).num_rows and not (stats is not None and stats.null_count == meta.row_group(g).num_rows):
                        raise ValueError(f"{path} has no statistics of {self.key}")

    def initialOffset(self) -> dict:
        return {"key": -(2**63)}

    def latestOffset(self) -> dict:
        return {"key": max((g[3] for g in self._groups()), default=-(2**63))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Group(p, g, start["key"], end["key"]) for p, g, least, most in self._groups() if most > start["key"] and least <= end["key"]]

    def read(self, partition: Group) -> Iterator:
        import pyarrow.compute as pc

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(row_groups=[partition.group], columns=self.columns):
                keys = batch.column(self.key)
                yield batch.filter(pc.and_(pc.greater(keys, partition.after), pc.less_equal(keys, partition.upto))).select(self.columns)


class Keyset(DataSource):
    """Format `keyset`: rows of a Parquet table in batches of growing keys. Options: path, key (a whole number that grows); a schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return KeysetReader(self.options, schema)


def spool_lines(spark: SparkSession, folder: str, suffix: str = ".json") -> DataFrame:
    """A stream of the lines of a spool's files."""
    spark.dataSource.register(Spool)
    return spark.readStream.format("spool").option("path", folder).option("suffix", suffix).load()


def keyset(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A stream of a table's rows by key. Keys that come later must be greater; rows whose key is null are never read."""
    spark.dataSource.register(Keyset)
    return spark.readStream.format("keyset").schema(schema).option("path", path).option("key", key).load()
