"""A sink of one file for each row, exactly named, as a Python data source.

Tasks write below a folder of the run's own; a commit moves the files into place, an abort deletes them, so that readers
see whole files only, and nothing of a run that failed. Names are settled before
anything is written: what a file name can't have is replaced, and rows of equal names are numbered by their key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_STAGE = "_staged-"


@dataclass
class _Written(WriterCommitMessage):
    folder: str


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), f"{_STAGE}{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, root = _files(self.path)
        folder = f"{root}/{self.run}/{uuid.uuid4().hex}"  # an attempt's own
        files.create_dir(folder, recursive=True)
        for row in rows:
            with files.open_output_stream(f"{folder}/{row.name}") as out:
                out.write((row.value or "").encode())
        return _Written(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, root = _files(self.path)
        for message in messages:  # of the attempts that count
            if message is not None:
                for info in files.get_file_info(fs.FileSelector(message.folder)):
                    files.move(info.path, f"{root}/{info.base_name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, root = _files(self.path)
        if files.get_file_info(f"{root}/{self.run}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.run}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "namedfiles"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def settled(rows: DataFrame) -> Column:
    """``name`` as a file's name, alone of its kind: equal ones (in any case) are told apart by their order by ``key``."""
    clean = F.regexp_replace(F.coalesce("name", F.lit("")), r"[/\\\x00-\x1f:*?\"<>|]", "_")
    clean = F.when(clean.rlike(r"^[._]*$") | clean.startswith(_STAGE), F.concat(F.lit("x"), clean)).otherwise(clean)
    stem, end = F.regexp_extract(clean, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(clean, r"(?s)^(.+?)(\.[^.]*)?$", 2)
    stem = F.substring(stem, 1, 80)
    own = F.row_number().over(Window.partitionBy(F.lower(F.concat(stem, end))).orderBy("key", "value"))
    return F.when(own == 1, F.concat(stem, end)).otherwise(F.concat(stem, F.lit("~"), own.cast("string"), end))


def write(rows: DataFrame, path: str) -> None:
    """Writes ``name, value, key``: a file each. Files of the same names there are replaced; others stay. A null value is an empty file."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select(settled(rows).alias("name"), "value").write.format("namedfiles").mode("append").option("path", path).save()
