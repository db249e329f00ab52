"""Sink of small text files: one file a row, in one directory a split."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def _opened(path: str):
    """(file system, path in it) of a local path or any URI that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _LabelWriter(DataSourceWriter):
    """Tasks write into a folder of their own; the driver moves what they finished, so a task that ran twice leaves one copy."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = _opened(self.path)
        task, made, names = f"{root}/_temporary-{self.run}/{uuid.uuid4().hex}", set(), []
        for split, image, text in iterator:
            name = f"{split}/{posixpath.splitext(posixpath.basename(image))[0]}.txt"
            if split not in made:
                files.create_dir(f"{task}/{split}", recursive=True)
                made.add(split)
            with files.open_output_stream(f"{task}/{name}") as out:
                out.write((text or "").encode() + b"\n" * bool(text))
            names.append(f"{task}/{name}")
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, root = _opened(self.path)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not old.base_name.startswith("_temporary-"):
                    files.delete_dir(old.path) if old.type == fs.FileType.Directory else files.delete_file(old.path)
        made = set()
        for message in messages:
            for name in message.files if message else ():
                split, base = name.rsplit("/", 2)[1:]
                if split not in made:
                    files.create_dir(f"{root}/{split}", recursive=True)
                    made.add(split)
                files.move(name, f"{root}/{split}/{base}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _opened(self.path)
        try:
            files.delete_dir(f"{root}/_temporary-{self.run}")
        except FileNotFoundError:
            pass


class LabelFiles(DataSource):
    """``df.write.format("label_files").option("path", folder)`` for columns ``split, image_name, text``."""

    @classmethod
    def name(cls) -> str:
        return "label_files"

    def schema(self) -> str:
        return "split string, image_name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LabelWriter(self.options["path"], overwrite)
