"""A sink of named files: one file for each row, all of them or none.

Tasks write to folders of their own below a staging folder. The driver moves the files of the attempts that count once all
tasks have succeeded; what failed or repeated attempts left goes with the staging folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files moved at once when a write is committed.
MOVES = 16


def file_name(name: str) -> str:
    """The name with what parts folders, and a first character that hides a file, in percent form."""
    plain = name.replace("%", "%25").replace("/", "%2F")
    return f"%{ord(plain[0]):02X}{plain[1:]}" if plain[:1] in ("_", ".") else plain


@dataclass
class Written(WriterCommitMessage):
    """The folder of one attempt; its files are not listed in the message."""

    folder: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        url = f"{self.staging}/{uuid.uuid4().hex}"
        store, folder = fs.FileSystem.from_uri(url)
        store.create_dir(folder, recursive=True)
        for row in iterator:
            if not row["name"]:
                raise ValueError("a file needs a name")
            target = f"{folder}/{file_name(row['name'])}"
            if store.get_file_info(target).type != fs.FileType.NotFound:
                raise ValueError(f"two rows are named {row['name']}")
            with store.open_output_stream(target) as out:
                out.write((row["text"] or "").encode())
        return Written(url)

    def commit(self, messages: list[Written | None]) -> None:
        store, final = fs.FileSystem.from_uri(self.path)
        store.create_dir(final, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(final)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)

        def move(source: str, name: str) -> None:
            if not self.overwrite and store.get_file_info(f"{final}/{name}").type != fs.FileType.NotFound:
                store.delete_file(f"{final}/{name}")
            store.move(source, f"{final}/{name}")

        with ThreadPoolExecutor(MOVES) as pool:
            for message in messages:
                if message is not None:
                    _, folder = fs.FileSystem.from_uri(message.folder)
                    found = store.get_file_info(fs.FileSelector(folder))
                    list(pool.map(lambda f: move(f.path, f.base_name), found))
        self._clear(store)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(fs.FileSystem.from_uri(self.path)[0])

    def _clear(self, store: fs.FileSystem) -> None:
        _, staging = fs.FileSystem.from_uri(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class NamedFiles(DataSource):
    """Rows (name, text) as files of a folder that all executors share: ``option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def write_files(df: DataFrame, path: str, name: Column, text: Column, mode: str = "append") -> None:
    """Writes one file per row below ``path``, in UTF-8; a null text is an empty file.

    With "append" files of the same name are replaced, with "overwrite" all files of the folder. Two rows of one name, or
    a row without a name, fail the write, and no file of it stays. Rows of one name meet in one task, so that they are seen.
    """
    df.sparkSession.dataSource.register(NamedFiles)
    rows = df.select(name.cast("string").alias("name"), text.cast("string").alias("text")).repartition("name")
    rows.write.format("named_files").option("path", path).mode(mode).save()


def write_reports(df: DataFrame, path: str, kind: str, report: str = "doc_id", json: str = "json", mode: str = "append") -> None:
    """One file ``<report>_<kind>.json`` for each row."""
    write_files(df, path, F.concat(F.col(report).cast("string"), F.lit(f"_{kind}.json")), F.col(json), mode)
