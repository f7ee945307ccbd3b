"""A sink that writes CSV files under given names.

Spark's own writers name files themselves. Here the rows carry the name of their file and
their place in it; the rows of a file are written by one task, which holds one batch of
them at a time. Every task attempt writes under names of its own, and only the commit
moves the files of the attempts that counted to their final names, so that a task that
ran twice, or died, leaves nothing behind that readers see.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FILE, PLACE = "_file", "_place"


@dataclass
class Written(WriterCommitMessage):
    #: (temporary path, final path, rows)
    files: list[tuple[str, str, int]]


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def _place(self, path: str) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, staging = self._place(self.staging)
        files, name, out, rows = [], None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                files.append((temporary, f"{self.path}/{name}", rows))

        try:
            for batch in iterator:
                names = batch.column(FILE)
                body = batch.drop_columns([FILE, PLACE])
                low = 0
                while low < batch.num_rows:
                    own = names[low].as_py()
                    high = low + 1
                    while high < batch.num_rows and names[high].as_py() == own:
                        high += 1
                    if own != name:
                        close()
                        name, rows, temporary = own, 0, f"{staging}/{uuid.uuid4().hex}"
                        store.create_dir(staging, recursive=True)
                        out = pyarrow.csv.CSVWriter(store.open_output_stream(temporary), body.schema)
                    out.write_batch(body.slice(low, high - low))
                    rows, low = rows + high - low, high
        finally:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, staging = self._place(self.staging)
        _, root = self._place(self.path)
        if self.overwrite and store.get_file_info(root).type == pyarrow.fs.FileType.Directory:
            for info in store.get_file_info(pyarrow.fs.FileSelector(root)):
                if not info.base_name.startswith("_writing-"):
                    (store.delete_dir if info.type == pyarrow.fs.FileType.Directory else store.delete_file)(info.path)
        for message in messages:
            for temporary, final, _ in message.files if message else []:
                _, target = self._place(final)
                store.create_dir(target.rpartition("/")[0], recursive=True)
                store.move(temporary, target)
        self._clear(store, staging)

    def abort(self, messages: list[Written | None]) -> None:
        store, staging = self._place(self.staging)
        self._clear(store, staging)

    @staticmethod
    def _clear(store: pyarrow.fs.FileSystem, staging: str) -> None:
        if store.get_file_info(staging).type == pyarrow.fs.FileType.Directory:
            store.delete_dir(staging)


class NamedFiles(DataSource):
    """``df.write.format("named_csv").save(path)``: rows with ``_file`` and ``_place`` as CSV files with a header."""

    @classmethod
    def name(cls) -> str:
        return "named_csv"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named(rows: DataFrame, path: str, file: Column, place: Column, overwrite: bool = True, drop: list[str] | None = None) -> None:
    """Writes ``rows`` to the files named by ``file``, each in the order of ``place``; columns in ``drop`` aren't written.

    ``path`` must be one that all executors reach. A null name goes nowhere and raises; a
    table without rows writes no file. Two runs into one folder without ``overwrite`` add
    files and replace those of the same name.
    """
    named = rows.withColumns({FILE: F.coalesce(file, F.raise_error(F.lit("a row has no file name"))), PLACE: place}).drop(*(drop or []))
    dealt = named.repartition(FILE).sortWithinPartitions(FILE, PLACE)
    register(rows.sparkSession)
    dealt.write.format("named_csv").mode("overwrite" if overwrite else "append").option("path", path).save()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)


def range_name(first: Column, last: Column, width: int = 4) -> Column:
    """``0001-0050`` for the ranks from ``first`` to ``last``."""
    digits = lambda c: F.when(F.length(c.cast("string")) >= width, c.cast("string")).otherwise(F.lpad(c.cast("string"), width, "0"))
    return F.concat(digits(first), F.lit("-"), digits(last))
