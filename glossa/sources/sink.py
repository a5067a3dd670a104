"""A sink that writes one row as one file: executors write, the driver only moves names into place.

Register ``FileSink`` once a session, then ``rows.write.format("glossa_files").mode("append").save(path)`` with rows
(name, body). Tasks write into folders of their own below ``_temporary``; when all are done, their files go to their
places, so a failed or repeated task leaves nothing behind. Files of the same names are replaced, others stay. path is
any that pyarrow can open (a local or mounted folder, hdfs://, s3://, gs://). Two rows of one name are an error.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def opened(path: str):
    """The file system of a path, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        files, root = opened(self.path)
        folder, names = f"_temporary/{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            name = row["name"]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a name of a file: {name!r}")
            target = f"{root}/{folder}/{name}"
            files.create_dir(posixpath.dirname(target), recursive=True)
            with files.open_output_stream(target) as out:
                out.write((row["body"] or "").encode())
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list) -> None:
        files, root = opened(self.path)
        done: set[str] = set()
        for m in (m for m in messages if m is not None):
            for name in m.names:
                if name in done:
                    self.abort(messages)
                    raise ValueError(f"two rows have the name {name!r}")
                done.add(name)
        files.create_dir(root, recursive=True)
        for m in (m for m in messages if m is not None):
            for name in m.names:
                files.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                files.move(f"{root}/{m.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        files, root = opened(self.path)
        if files.get_file_info(f"{root}/_temporary/{self.job}").type == FileType.Directory:
            files.delete_dir(f"{root}/_temporary/{self.job}")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "glossa_files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])
