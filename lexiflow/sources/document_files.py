"""Documents as text files of their own names, ``<name>_<index>.txt``: a Spark data source.

``spark.write.format("document_files")`` writes one file for each row (name, index, text).
Tasks write the files, and a list of them, straight into the folder; the names follow from
the rows, so a repeated or speculative attempt writes the same files again. Only lists that
the committed manifest names count: the driver learns one list a task, never a file, and
files of attempts or jobs that failed are not read. Reading is one task a list.

Characters of a name that a path cannot hold are percent-encoded in the file's name; names
come back as they were. A null name is empty, a null text is an empty file.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.types import StructType

from lexiflow.session import dense_index

FORMAT = "document_files"
SCHEMA = "name string, index long, text string"
MANIFEST, LISTS = "_manifest.json", "_lists"


def _store(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def _put(store, path: str, data: bytes) -> None:
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def _get(store, path: str) -> bytes:
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def file_name(name: str | None, index: int, extension: str = "txt") -> str:
    safe = "".join(f"%{ord(c):02X}" if c in "/%\0" else c for c in name or "")
    return f"{safe}_{index}.{extension}"


@dataclass
class Written(WriterCommitMessage):
    lists: list[str]


@dataclass
class ListPart(InputPartition):
    path: str


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options["path"], overwrite, self.options.get("extension", "txt"))

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileReader(self.options["path"])


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, extension: str):
        self.path, self.overwrite, self.extension = path, overwrite, extension

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = _store(self.path)
        store.create_dir(posixpath.join(base, LISTS), recursive=True)
        own, out = f"{uuid.uuid4().hex}.jsonl", None
        for batch in iterator:
            for name, index, text in zip(*(batch.column(c).to_pylist() for c in ("name", "index", "text"))):
                if out is None:
                    out = store.open_output_stream(posixpath.join(base, LISTS, own), compression=None)
                file = file_name(name, index, self.extension)
                _put(store, posixpath.join(base, file), (text or "").encode())
                out.write((json.dumps([file, name, index]) + "\n").encode())
        if out is not None:
            out.close()
        return Written([own] if out is not None else [])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        lists = [] if self.overwrite else _lists(store, base)
        lists += [x for m in messages if m is not None for x in m.lists]
        new = posixpath.join(base, f"_{uuid.uuid4().hex}")
        _put(store, new, json.dumps(lists).encode())
        store.move(new, posixpath.join(base, MANIFEST))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing to undo: what no manifest names does not count."""


def _lists(store, base: str) -> list[str]:
    try:
        return json.loads(_get(store, posixpath.join(base, MANIFEST)))
    except FileNotFoundError:
        return []


class FileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [ListPart(x) for x in _lists(*_store(self.path))]

    def read(self, partition: InputPartition):
        if partition is None:  # nothing was written
            return
        store, base = _store(self.path)
        with store.open_input_stream(posixpath.join(base, LISTS, partition.path), compression=None) as f:
            for line in f.read().splitlines():
                file, name, index = json.loads(line)
                yield name, index, _get(store, posixpath.join(base, file)).decode()


def save_documents(docs: DataFrame, path: str, name_col: str = "doc_name", text_col: str = "text", mode: str = "overwrite",
                   extension: str = "txt") -> None:
    """Write every document as ``<name>_<index>.txt`` (or another ``extension``); the index counts the documents in the
    order of their names."""
    docs.sparkSession.dataSource.register(DocumentFiles)
    named = docs.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))
    dense_index(named, "name").select("name", "index", "text").write.format(FORMAT).mode(mode) \
        .option("extension", extension).save(path)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(name, index, text)`` of the files that committed writes have listed."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format(FORMAT).load(path)
