"""CSV files with headers of their own as a Spark data source, ``spark.read.format("record_csv")``.

Every file is read once, by the task that has a split of it: the task reads the file's first line, finds the
wanted columns by name in it and goes on with the lines of its split. Files are split at ``split_bytes`` and small
ones share a task. Quoted cells may hold commas and doubled quotes; with ``multiline`` they may hold line breaks
too, and such a file, like a compressed one, is one split. The file system is one that pyarrow opens by its
address (local, hdfs, s3, gs).

Options: ``path`` or ``paths`` (a JSON list), ``id_col``, ``mode``, ``multiline``, ``split_bytes``. Modes:

- ``records`` (needs a schema of strings): the rows of the files whose header names ``id_col``. Columns that a file
  lacks and cells that a row lacks are NULL, cells beyond the header are ignored, a column ``file`` is the
  file's path. A line whose id cell is the id's own name is a header once more, not a record.
- ``foreign``: (file, line) of all other files, header line included.
- ``headers``: (file, header) of every file that is not empty; no more than the first line is read.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = 128 << 20
OPEN_COST = 4 << 20  # what opening one more file counts as, in bytes
ROWS = 8192  # rows of a batch
PACKED = (".gz", ".bz2", ".zst", ".lz4")
FIXED = {"headers": "file string, header array<string>", "foreign": "file string, line string"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of an address with or without scheme."""
    local = re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path and local == path else (fs.LocalFileSystem(), local)


def listed(path: str) -> list[tuple[str, str, int]]:
    """(address, path in the file system, bytes) of the files below ``path``; hidden and empty ones are left out."""
    system, base = opened(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    single = info.type == fs.FileType.File
    found = [info] if single else system.get_file_info(fs.FileSelector(base, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    out = []
    for f in found:
        below = f.path[len(base) :].split("/") if not single else []
        if f.type == fs.FileType.File and f.size and not any(p.startswith(("_", ".")) for p in below):
            out.append((scheme + f.path, f.path, f.size))
    return sorted(out)


class Split(InputPartition):
    """Stretches of files, (address, path, first byte, end); the end is None for files read as a whole."""

    def __init__(self, parts: list[tuple[str, str, int, int | None]]):
        self.parts = parts


def cells_of(line: str) -> list[str]:
    return next(csv.reader([line]), []) if '"' in line else line.split(",")


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.names = names
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.mode = options.get("mode", "records")
        self.id_col = options.get("id_col", "")
        self.multiline = options.get("multiline", "false").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        stretches = []
        for address, path, size in (f for p in self.paths for f in listed(p)):
            if self.mode == "headers" or self.multiline or path.endswith(PACKED):
                stretches.append((0 if self.mode == "headers" else size, (address, path, 0, None)))
            else:
                step = self.split_bytes
                stretches += [(min(step, size - a), (address, path, a, min(a + step, size))) for a in range(0, size, step)]
        out, room = [], 0
        for size, part in stretches:
            if size + OPEN_COST > room or not out:
                out.append([])
                room = max(self.split_bytes, size + OPEN_COST)
            out[-1].append(part)
            room -= size + OPEN_COST
        return [Split(parts) for parts in out]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for part in partition.parts:
            for row in self.rows(*part):
                rows.append(row)
                if len(rows) == ROWS:
                    yield self.batch(rows)
                    rows = []
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.list_(pa.string()) if self.mode == "headers" and n == "header" else pa.string() for n in self.names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], self.names)

    def rows(self, address: str, path: str, start: int, end: int | None) -> Iterator[tuple]:
        """The rows of one stretch; it has the lines that begin in it."""
        system = opened(address)[0]

        def source():
            # a whole stream is decompressed by its suffix, a file can be entered at any byte
            raw = system.open_input_stream(path) if end is None else system.open_input_file(path)
            return io.BufferedReader(raw, 1 << 20)

        with source() as file:
            head = b""
            while not head.strip():
                head = file.readline()
                if not head:
                    return
            header = [c.strip() for c in cells_of(head.decode("utf-8-sig", "replace").rstrip("\r\n"))]
            if self.mode == "headers":
                yield address, header
                return
            own = self.id_col in header
            if own == (self.mode == "foreign"):
                return
            if start:
                file.seek(start - 1)
                file.readline()
            elif not own:
                yield address, head.decode("utf-8-sig", "replace").rstrip("\r\n")
            lines = self.lines(file, end)
            if not own:
                yield from ((address, line) for line in lines)
                return
            wanted = [header.index(n) if n in header else None for n in self.names]
            place, at_file = header.index(self.id_col), self.names.index("file") if "file" in self.names else -1
            for cells in csv.reader(lines) if self.multiline else map(cells_of, lines):
                if not cells or cells == [""] or (place < len(cells) and cells[place].strip() == self.id_col):
                    continue
                row = [cells[i] if i is not None and i < len(cells) else None for i in wanted]
                if at_file >= 0:
                    row[at_file] = address
                yield tuple(row)

    def lines(self, file: io.BufferedReader, end: int | None) -> Iterator[str]:
        at = file.tell() if end is not None else 0
        for line in file:
            if end is not None and at >= end:
                return
            at += len(line)
            text = line.decode("utf-8", "replace")
            yield text if self.multiline else text.rstrip("\r\n")


class RecordCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_csv"

    def schema(self) -> str:
        mode = self.options.get("mode", "records")
        if mode not in FIXED:
            raise ValueError("record_csv needs a schema of string columns")
        return FIXED[mode]

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), schema.fieldNames())


def record_csv(spark: SparkSession, paths: str | list[str], **options: str):
    """A reader of the format over a folder, a file or a list of files."""
    spark.dataSource.register(RecordCsv)
    return spark.read.format("record_csv").options(paths=json.dumps([paths] if isinstance(paths, str) else paths), **options)
