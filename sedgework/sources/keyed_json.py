"""A folder with one JSON document for each key, as a data source: ``format("keyed_json")`` after ``register``.

A job writes its documents to a hidden folder beside the others.  Only when all tasks are done does the commit move them
into place, each one by a rename, so a reader sees a document's old text or its new one; a job that fails removes what it
wrote and leaves all documents as they were.  A text that is no JSON, a null and a key that comes twice fail the job.
The folder is reached by pyarrow's file systems, from the driver and all executors.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Documents of one reading task.
GROUP = 1000
_BEGIN, _ENDING = "d-", ".json"


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _name(key: str) -> str:
    return f"{_BEGIN}{quote(key, safe='')}{_ENDING}"


def _key(name: str) -> str:
    return unquote(name[len(_BEGIN) : -len(_ENDING)])


def _names(files, root: str) -> list[str]:
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(_ENDING) and f.base_name.startswith(_BEGIN))


@dataclass
class _Written(WriterCommitMessage):
    folder: str


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, replace: bool):
        self.folder, self.replace, self.job = folder, replace, f".pending-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Written:
        files, root = _file_system(self.folder)
        own, seen = f"{self.job}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", set()
        files.create_dir(f"{root}/{own}", recursive=True)
        for row in iterator:
            key, text = row[0], row[1]
            if key is None or text is None:
                raise ValueError("a key and a document must not be null")
            if key in seen:
                raise ValueError(f"the key {key!r} comes twice")
            json.loads(text)
            seen.add(key)
            with files.open_output_stream(f"{root}/{own}/{_name(key)}") as out:
                out.write(text.encode())
        return _Written(own)

    def commit(self, messages) -> None:
        files, root = _file_system(self.folder)
        placed = {}
        for m in messages:
            for name in _names(files, f"{root}/{m.folder}") if m else ():
                if name in placed:
                    self.abort(messages)
                    raise ValueError(f"the key {_key(name)!r} comes twice")
                placed[name] = m.folder
        old = set(_names(files, root)) - set(placed) if self.replace else ()
        for name, folder in placed.items():
            files.move(f"{root}/{folder}/{name}", f"{root}/{name}")
        for name in old:
            files.delete_file(f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        files, root = _file_system(self.folder)
        from pyarrow import fs

        if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        files, root = _file_system(self.folder)
        names = _names(files, root)
        return [InputPartition(names[i : i + GROUP]) for i in range(0, len(names), GROUP)] or [InputPartition([])]

    def read(self, partition):
        files, root = _file_system(self.folder)
        for name in partition.value:
            with files.open_input_stream(f"{root}/{name}") as f:
                yield _key(name), f.read().decode()


class KeyedJson(DataSource):
    """Columns key and document; writing appends (documents of the same keys are replaced) or overwrites all."""

    @classmethod
    def name(cls) -> str:
        return "keyed_json"

    def schema(self) -> str:
        return "key string, document string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KeyedJson)
