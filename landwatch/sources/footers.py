"""Landed columns read from the footers of the tables' own files, by the executors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from landwatch.functions.types import warehouse_type_of
from landwatch.schemas import LANDED_COLUMNS

FORMAT = "landed_footers"


class Bucket(InputPartition):
    """The tables whose place hashes to ``value``."""


class FooterReader(DataSourceReader):
    """Every task lists the folders above the tables, which are few beside the files, and reads
    the footers of its own share of the tables. Nothing but the number of tasks is planned on
    the driver, so the catalog may be as large as it likes."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.levels = [x for x in options.get("levels", "connection_id/table_schema/table_name").split("/") if x]
        self.given = {"connection_id": options.get("connection_id", ""), "table_schema": options.get("table_schema", "public")}
        self.tasks = int(options.get("tasks", "32"))
        if not self.levels or self.levels[-1] != "table_name":
            raise ValueError("levels must end with table_name")

    def partitions(self) -> list[InputPartition]:
        return [Bucket(i) for i in range(self.tasks)]

    def _walk(self, fs, folder: str, levels: list[str], names: dict[str, str]) -> Iterator[tuple[str, dict[str, str]]]:
        from pyarrow.fs import FileSelector

        for entry in sorted(fs.get_file_info(FileSelector(folder)), key=lambda e: e.path):
            name = entry.base_name
            if name.startswith(("_", ".")):
                continue
            found = names | {levels[0]: name.removesuffix(".parquet") if len(levels) == 1 else name}
            if len(levels) == 1:
                yield entry.path, found
            elif not entry.is_file:
                yield from self._walk(fs, entry.path, levels[1:], found)

    def _newest(self, fs, path: str) -> str | None:
        """The data file written last: its footer has the table's present columns."""
        from pyarrow.fs import FileSelector, FileType

        if fs.get_file_info(path).type == FileType.File:
            return path
        files = [e for e in fs.get_file_info(FileSelector(path, recursive=True)) if e.is_file and e.path.endswith(".parquet") and "/_" not in e.path[len(path):]]
        return max(files, key=lambda e: (e.mtime_ns or 0, e.path)).path if files else None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem
        from pyspark.sql.pandas.types import from_arrow_type

        remote = urlparse(self.root).scheme not in ("", "file")
        fs, base = FileSystem.from_uri(self.root if remote else "file://" + urlparse(self.root).path)
        for path, names in self._walk(fs, base, self.levels, {}):
            if zlib.crc32(path.encode()) % self.tasks != partition.value:
                continue
            file = self._newest(fs, path)
            if file is None or not file.endswith(".parquet"):
                continue
            with fs.open_input_file(file) as f:
                schema = pq.read_schema(f)
            place = [names.get(n, self.given.get(n, "")) for n in ("connection_id", "table_schema", "table_name")]
            for i, field in enumerate(schema, start=1):
                yield (*place, field.name, warehouse_type_of(from_arrow_type(field.type, prefer_timestamp_ntz=True)), i, field.nullable)


class LandedFooters(DataSource):
    """``spark.read.format("landed_footers")``: one row per column of every table under ``path``.

    ``levels`` names the folders from ``path`` down to a table's own folder or file; a level that
    is missing takes the option of its name. ``tasks`` sets how many tasks share the tables. The
    schema of a table is that of its newest file; what is not Parquet is passed over.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return LANDED_COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return FooterReader(dict(self.options))


def landed_columns_from_footers(
    spark: SparkSession, path: str, levels: str = "connection_id/table_schema/table_name", tasks: int | None = None, **given: str
) -> DataFrame:
    """Columns of every table stored under ``path``, without a catalog and without reading data.

    The store must be one that executors open by URI (a shared file system or an object store);
    ``landed_columns_from_rows`` takes metadata that only Spark can read.
    """
    spark.dataSource.register(LandedFooters)
    reader = spark.read.format(FORMAT).option("levels", levels).option("tasks", str(tasks or spark.sparkContext.defaultParallelism))
    for name, value in given.items():
        reader = reader.option(name, value)
    return reader.load(path)
