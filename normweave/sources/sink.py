"""A sink that writes one file an artifact, with commit and abort."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_STAGING = "_staging"


def _opened(path: str):
    """(file system, path in it) of a path or URI that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its staging folder and the documents in it."""

    folder: str
    documents: list[str]


class ArtifactWriter(DataSourceWriter):
    """A task writes below a staging folder of its own, so a task that is tried again, or runs twice, leaves nothing of the
    lost attempt in the result. The commit moves whole document folders, each in place of the one that stood there; an
    abort removes what was staged. Rows of one document must come to one task."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _opened(self.path)
        folder, documents, made = f"{_STAGING}/{self.job}/{uuid.uuid4().hex}", set(), set()
        for row in iterator:
            parts = row["file_path"].split("/")
            if len(parts) < 2 or any(p in ("", ".", "..") for p in parts) or parts[0] == _STAGING:
                raise ValueError(f"not a document's file: {row['file_path']}")
            target = f"{root}/{folder}/{row['file_path']}"
            parent = target.rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(target) as out:
                out.write((row["content"] or "").encode())
            documents.add(parts[0])
        return Written(folder, sorted(documents))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _opened(self.path)
        for message in filter(None, messages):
            for document in message.documents:
                target = f"{root}/{document}"
                if store.get_file_info(target).type == fs.FileType.Directory:
                    store.delete_dir(target)
                store.move(f"{root}/{message.folder}/{document}", target)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        for folder in (f"{root}/{_STAGING}/{self.job}", f"{root}/{_STAGING}"):
            if store.get_file_info(folder).type == fs.FileType.Directory and (
                    folder.endswith(self.job) or not store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


class ArtifactFiles(DataSource):
    """Format `artifact_files`: rows (file_path, content) as files below the path."""

    @classmethod
    def name(cls) -> str:
        return "artifact_files"

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options["path"])


def write_files(artifacts: DataFrame, path: str) -> None:
    """One file an artifact at <path>/<file_path>. A document's folder is replaced as a whole; other documents' stay."""
    artifacts.sparkSession.dataSource.register(ArtifactFiles)
    rows = artifacts.repartition("doc_id").select("file_path", "content")
    rows.write.format("artifact_files").mode("append").save(path)
