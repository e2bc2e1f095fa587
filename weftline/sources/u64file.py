"""Binary relations: a row count, a column count, then each column's values, all as 64-bit words.

``spark.read.format("u64rel").option("rows_per_task", n).load(path)`` reads one
file or a folder of them; ``.option("columns", "0,2")`` reads these columns alone (c0
and c2), and no byte of the others. ``df.write.format("u64rel").mode("append").save(path)``
writes files of at most ``rows_per_file`` rows, which is what a task holds. Values keep their 64 bits in a LongType column
(see functions.unsigned for the unsigned meaning). Paths are anything that
pyarrow's file systems open. Reading opens each header once, many at a time, and
validates each file's length.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

WORD = 8
HEADER_WORDS = 2


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Path within the file system and length, of each relation file at path."""
    store, at = _open(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    return sorted((x.path, x.size) for x in found if x.is_file and not x.base_name.startswith((".", "_")))


def _header(store: fs.FileSystem, at: str, length: int) -> tuple[int, int]:
    with store.open_input_file(at) as f:
        head = f.read(HEADER_WORDS * WORD)
    if len(head) < HEADER_WORDS * WORD:
        raise ValueError(f"{at}: no header")
    rows, columns = (int(x) for x in np.frombuffer(head, "<u8"))
    if length != WORD * (HEADER_WORDS + rows * columns):
        raise ValueError(f"{at}: {rows} rows of {columns} columns don't fit {length} bytes")
    return rows, columns


def _headers(path: str) -> list[tuple[str, int, int]]:
    """Path, rows and columns of each relation file at path."""
    store, _ = _open(path)
    with ThreadPoolExecutor(32) as pool:
        return list(pool.map(lambda f: (f[0], *_header(store, *f)), _files(path)))


class RowRange(InputPartition):
    def __init__(self, at: str, first: int, last: int, rows: int):
        self.at, self.first, self.last, self.rows = at, first, last, rows


class U64RelReader(DataSourceReader):
    def __init__(self, path: str, rows_per_task: int, columns: list[int]):
        self.path, self.rows_per_task, self.columns = path, rows_per_task, columns

    def partitions(self):
        found = _headers(self.path)
        if len({columns for _, _, columns in found}) > 1:
            raise ValueError(f"files of {sorted({columns for _, _, columns in found})} columns in {self.path}")
        out = [RowRange(at, i, min(i + self.rows_per_task, rows), rows) for at, rows, _ in found for i in range(0, rows, self.rows_per_task)]
        return out or [RowRange("", 0, 0, 0)]

    def read(self, part: RowRange):
        if part.first == part.last:
            return
        store, _ = _open(self.path)
        step = 1 << 16
        with store.open_input_file(part.at) as f:
            for i in range(part.first, part.last, step):
                n = min(step, part.last - i)
                data = [np.frombuffer(f.read_at(n * WORD, WORD * (HEADER_WORDS + c * part.rows + i)), "<i8") for c in self.columns]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in data], [f"c{c}" for c in self.columns])


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class U64RelWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: int, rows_per_file: int):
        self.path, self.columns, self.rows_per_file = path, columns, rows_per_file

    def write(self, batches):
        """One column comes after the other in a file, so its rows are held until they are complete."""
        store, at = _open(self.path)
        store.create_dir(at, recursive=True)
        names, parts = [], []

        def emit():
            names.append(f"part-{uuid.uuid4().hex}")
            with store.open_output_stream(f"{at}/.{names[-1]}") as f:
                f.write(np.array([sum(p.num_rows for p in parts), self.columns], "<u8").tobytes())
                for c in range(self.columns):
                    for p in parts:
                        f.write(np.asarray(p.column(c).to_numpy(zero_copy_only=False), "<i8").tobytes())
            parts.clear()

        for b in batches:
            while b.num_rows:
                room = self.rows_per_file - sum(p.num_rows for p in parts)
                parts.append(b.slice(0, room))
                b = b.slice(min(room, b.num_rows))
                if sum(p.num_rows for p in parts) == self.rows_per_file:
                    emit()
        if parts or not names:
            emit()
        return Written(names)

    def commit(self, messages):
        """Only the files of tasks that succeeded get their visible name."""
        store, at = _open(self.path)
        for m in messages:
            if m is not None:
                for name in m.names:
                    store.move(f"{at}/.{name}", f"{at}/{name}")

    def abort(self, messages):
        store, at = _open(self.path)
        for m in messages:
            if m is not None:
                for name in m.names:
                    store.delete_file(f"{at}/.{name}")


class U64RelSource(DataSource):
    @classmethod
    def name(cls):
        return "u64rel"

    def schema(self):
        """Of the columns asked for, or of all that the first file has; partitions() looks at every file."""
        if asked := self.options.get("columns"):
            return ", ".join(f"c{int(c)} bigint not null" for c in asked.split(","))
        path = self.options["path"]
        if not (files := _files(path)):
            raise ValueError(f"no files in {path}")
        return ", ".join(f"c{c} bigint not null" for c in range(_header(_open(path)[0], *files[0])[1]))

    def reader(self, schema):
        return U64RelReader(self.options["path"], int(self.options.get("rows_per_task", 1 << 20)), [int(n[1:]) for n in schema.names])

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("u64rel only appends")
        return U64RelWriter(self.options["path"], len(schema.fields), int(self.options.get("rows_per_file", 1 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(U64RelSource)
