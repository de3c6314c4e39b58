"""Files out of rows, as a Python data source: ``df.write.format("rasterloom_files").option("path", folder)``.

A task writes its files into a folder of its own attempt.  Only when all tasks
are done are the files of those attempts that count moved to their names; what
other attempts left is deleted, and a job that fails leaves nothing.  The driver
sees a folder's name for each task, never a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class FileWriter(DataSourceArrowWriter):
    """Rows (name, content): null names or contents are errors, names may not hold a slash; the last move of a name decides."""

    def __init__(self, path: str, overwrite: bool):
        self.target = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.job = uuid.uuid4().hex
        self.overwrite = overwrite

    def _root(self):
        from pyarrow import fs

        disk, root = fs.FileSystem.from_uri(self.target)
        return disk, root.rstrip("/"), f"{root.rstrip('/')}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        disk, _, staging = self._root()
        own, n = uuid.uuid4().hex, 0
        disk.create_dir(f"{staging}/{own}", recursive=True)
        for b in iterator:
            for name, raw in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                if not name or "/" in name or raw is None:
                    raise ValueError(f"no file can be written for the name {name!r}")
                with disk.open_output_stream(f"{staging}/{own}/{name}") as f:
                    f.write(raw)
                n += 1
        return Attempt(own, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        disk, root, staging = self._root()
        if self.overwrite:
            for f in disk.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    disk.delete_file(f.path)
        disk.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.files:
                for f in disk.get_file_info(fs.FileSelector(f"{staging}/{m.folder}")):
                    disk.move(f.path, f"{root}/{f.base_name}")
        self._clear()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        disk, _, staging = self._root()
        if disk.get_file_info(staging).type != fs.FileType.NotFound:
            disk.delete_dir(staging)


class FileSink(DataSource):
    """Modes ``append`` (files of the same name are replaced) and ``overwrite`` (other files of the folder go as well)."""

    @classmethod
    def name(cls) -> str:
        return "rasterloom_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        names = [f.name for f in schema.fields]
        if sorted(names) != ["content", "name"]:
            raise ValueError(f"columns name and content are written, not {names}")
        return FileWriter(self.options["path"], overwrite)
