"""Binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from textassay.session import shared_folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which executors and driver share."""
    return f"{shared_folder(spark)}/textassay/{kind}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def own_name(folder: str, suffix: str) -> str:
    """A file name that no other attempt of this or another task uses.

    What a failed attempt wrote is never named in an index, which only holds rows of
    attempts that Spark has committed.
    """
    context = TaskContext.get()
    return f"{folder}/{context.partitionId():06d}-{uuid.uuid4().hex}{suffix}"


class Output:
    """A file that grows by appended records."""

    def __init__(self, folder: str, suffix: str):
        self.name = own_name(folder, suffix)
        system, path = opened(self.name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = system.open_output_stream(path, compression=None)
        self.size = 0

    def append(self, blob: bytes) -> int:
        """Write ``blob`` and return where it starts."""
        start = self.size
        self.stream.write(blob)
        self.size += len(blob)
        return start

    def close(self) -> None:
        self.stream.close()
