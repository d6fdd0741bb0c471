"""Embedding caches as .npz archives: arrays of one length, a row of the table for each place in them.

    spark.dataSource.register(NpzSource)
    spark.read.format("npz").load("cache.npz")          # a file, or a folder of them
    export.write.format("npz").mode("overwrite").save("folder")

An archive is read by ranges of rows, each in a task that reads its own bytes of every array: in archives that are not
compressed it goes straight to them; compressed ones have to be unpacked up to there. Paths are of a file system
that all machines mount. Text, whole numbers, fractions and truth values are read, each array of one or two dimensions.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, StructType

#: Rows that a task reads, unless the option rows says otherwise, and rows of a batch.
ROWS, BATCH = 65_536, 4_096


@dataclass(frozen=True)
class Member:
    """An array in an archive: its name, its length, the shape of one row, the type of its numbers, and where its first byte is in the member."""

    name: str
    length: int
    row: tuple[int, ...]
    dtype: np.dtype
    starts: int

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * int(np.prod(self.row, dtype=np.int64))


def members(path: str) -> list[Member]:
    """What an archive holds, from its arrays' headers alone."""
    out = []
    with zipfile.ZipFile(path) as archive:
        for name in archive.namelist():
            with archive.open(name) as f:
                version = np.lib.format.read_magic(f)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, by_column, dtype = read(f)
                if dtype.hasobject or by_column and len(shape) > 1 or len(shape) not in (1, 2):
                    raise ValueError(f"{name} of {path} is no array of rows: {shape}, {dtype}")
                out.append(Member(name.removesuffix(".npy"), shape[0], shape[1:], dtype, f.tell()))
    if len({m.length for m in out}) > 1:
        raise ValueError(f"arrays of {path} have different lengths")
    return out


def rows_of(path: str, all_members: list[Member], first: int, last: int) -> dict[str, np.ndarray]:
    """Rows first to last (excluded) of every array."""
    out = {}
    with zipfile.ZipFile(path) as archive:
        for m in all_members:
            with archive.open(f"{m.name}.npy") as f:
                f.seek(m.starts + first * m.row_bytes)
                data = f.read((last - first) * m.row_bytes)
            out[m.name] = np.frombuffer(data, m.dtype).reshape((last - first, *m.row))
    return out


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith(".npz")) if os.path.isdir(path) else [path]


def _sql_type(m: Member) -> str:
    kind = {"U": "string", "b": "boolean", "i": "bigint" if m.dtype.itemsize > 4 else "int", "u": "bigint", "f": "double" if m.dtype.itemsize > 4 else "float"}.get(m.dtype.kind)
    if kind is None:
        raise ValueError(f"arrays of {m.dtype} are not read")
    return f"array<{kind}>" if m.row else kind


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


class NpzSource(DataSource):
    """The format npz; see the module."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        first = _files(self.options["path"])[:1]
        if not first:
            raise ValueError(f"no archive in {self.options['path']}")
        return ", ".join(f"`{m.name}` {_sql_type(m)}" for m in members(first[0]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("rows", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, rows: int):
        self.path, self.schema, self.rows = path, schema, rows

    def partitions(self) -> list[Range]:
        out = []
        for path in _files(self.path):
            length = next((m.length for m in members(path)), 0)
            out += [Range(path, at, min(at + self.rows, length)) for at in range(0, length, self.rows)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, held = to_arrow_schema(self.schema), {m.name: m for m in members(part.path)}
        wanted = [held[name] for name in self.schema.names]
        for at in range(part.first, part.last, BATCH):
            found = rows_of(part.path, wanted, at, min(at + BATCH, part.last))
            columns = [pa.array(found[f.name].tolist(), f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)


@dataclass
class _Part(WriterCommitMessage):
    aside: str
    final: str


class _Writer(DataSourceWriter):
    """An archive a task, written aside; the commit of the job moves them into the folder."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path.removeprefix("file://"), schema, overwrite
        if os.path.exists(self.path) and os.listdir(self.path) and not overwrite:
            raise ValueError(f"{path} is there already")

    def write(self, rows: Iterator) -> _Part | None:
        from pyspark import TaskContext

        held: dict[str, list] = {f.name: [] for f in self.schema}
        for row in rows:
            for f in self.schema:
                value = row[f.name]
                if value is None:
                    raise ValueError(f"{f.name} has a null, which an array can't hold")
                held[f.name].append(value)
        if not any(held.values()):
            return None
        os.makedirs(self.path, exist_ok=True)
        aside = os.path.join(self.path, f".{uuid.uuid4().hex}.aside")
        kinds = {"string": np.str_, "bigint": np.int64, "int": np.int32, "float": np.float32, "double": np.float64, "boolean": np.bool_}
        with open(aside, "wb") as out:
            np.savez(out, **{f.name: np.array(held[f.name], kinds[(f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType).simpleString()]) for f in self.schema})
        return _Part(aside, os.path.join(self.path, f"part-{TaskContext.get().partitionId():05d}.npz"))

    def commit(self, parts: list[_Part | None]) -> None:
        made = [p for p in parts if p is not None]
        os.makedirs(self.path, exist_ok=True)
        for name in os.listdir(self.path) if self.overwrite else []:
            if name.endswith(".npz"):
                os.unlink(os.path.join(self.path, name))
        for p in made:
            shutil.move(p.aside, p.final)
        kept = {p.final for p in made}
        for name in os.listdir(self.path):  # what tries that were given up have left
            if name.endswith(".aside") and os.path.join(self.path, name) not in kept:
                os.unlink(os.path.join(self.path, name))

    def abort(self, parts: list[_Part | None]) -> None:
        for p in parts:
            if p is not None and os.path.exists(p.aside):
                os.unlink(p.aside)
