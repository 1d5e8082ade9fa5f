"""A sink that writes a file for each row: spark.dataSource.register(RowFiles), then
df.write.format("row_files").option("column", "content").mode("overwrite").save(folder).

df has the columns file (a name) and the one that `column` names (a text), and may have more, which go to the table of contents.
Tasks write their files side by side, each attempt into a folder of its own under a staging folder; nothing is visible before the
commit, which drops the folders of attempts that didn't count, writes the manifest (a line for each part: files, bytes, digest), and
puts the staging folder in the target's place by one renaming. An abort takes the staging folder away. Folders are those of any
store that pyarrow knows (file, hdfs, s3), so executors and the driver have to reach the same one.

A null file name is an error; a null text is an empty file. Of two rows with one name in a task the second is an error, as a file would be lost;
in two tasks both stay, in the folders of their parts. mode("append") keeps what is there and adds parts."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST, CONTENTS = "_manifest.jsonl", "_contents.jsonl"


@dataclass
class Part(WriterCommitMessage):
    folder: str
    files: int
    bytes: int
    sha256: str


def _store(path: str) -> tuple[fs.FileSystem, str]:
    found, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return found, inside.rstrip("/")


def _there(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


class _Writer(DataSourceWriter):
    def __init__(self, path: str, column: str, names: list[str], overwrite: bool):
        self.path, self.column, self.names, self.overwrite = path, column, names, overwrite
        self.run = uuid.uuid4().hex

    def _staging(self, path: str) -> str:
        """Beside the target, so that it's put there by a renaming."""
        return posixpath.join(posixpath.dirname(path), f".{posixpath.basename(path)}-{self.run}")

    def write(self, rows: Iterator) -> Part:
        store, path = _store(self.path)
        context = TaskContext.get()
        part = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        folder = posixpath.join(self._staging(path), part)
        store.create_dir(folder, recursive=True)
        names, total, whole, contents = set(), 0, sha256(), []
        for row in rows:
            values = dict(zip(self.names, row))
            name, data = values.pop("file"), (values.pop(self.column) or "").encode()
            if not name or "/" in name or name in names:
                raise ValueError(f"not a name of a file of its own: {name!r}")
            names.add(name)
            with store.open_output_stream(posixpath.join(folder, name)) as out:
                out.write(data)
            total += len(data)
            whole.update(data)
            contents.append(json.dumps({"file": f"{part}/{name}", "bytes": len(data), **values}, ensure_ascii=False, default=str))
        with store.open_output_stream(posixpath.join(folder, CONTENTS)) as out:
            out.write("\n".join(contents).encode())
        return Part(part, len(names), total, whole.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        store, path = _store(self.path)
        staging, parts = self._staging(path), [m for m in messages if m]
        store.create_dir(staging, recursive=True)
        kept = {p.folder for p in parts}
        for found in store.get_file_info(fs.FileSelector(staging)):
            if found.base_name not in kept:  # of an attempt that was given up
                store.delete_dir(found.path)
        lines = [json.dumps({"part": p.folder, "files": p.files, "bytes": p.bytes, "sha256": p.sha256}) for p in sorted(parts, key=lambda p: p.folder)]
        if _there(store, path) and not self.overwrite:
            before = posixpath.join(path, MANIFEST)
            if _there(store, before):
                with store.open_input_stream(before) as file:
                    lines = file.read().decode().splitlines() + lines
            for p in parts:
                store.move(posixpath.join(staging, p.folder), posixpath.join(path, p.folder))
            with store.open_output_stream(before) as out:
                out.write("\n".join(lines).encode())
            store.delete_dir(staging)
            return
        with store.open_output_stream(posixpath.join(staging, MANIFEST)) as out:
            out.write("\n".join(lines).encode())
        if _there(store, path):
            store.delete_dir(path)
        store.move(staging, path)

    def abort(self, messages: list[Part | None]) -> None:
        store, path = _store(self.path)
        if _there(store, self._staging(path)):
            store.delete_dir(self._staging(path))


class RowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        column = self.options.get("column", "content")
        if not {"file", column} <= set(schema.names):
            raise ValueError(f"columns file and {column} are needed")
        return _Writer(self.options["path"], column, schema.names, overwrite)
