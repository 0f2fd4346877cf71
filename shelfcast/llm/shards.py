"""Binary shard files that tasks write to a shared folder, and that Spark reads back.

A task writes a shard under a temporary name and moves it when complete. Each attempt has names of its own, and only
shards in the manifest (a table that Spark commits) count, so lost executors, repeated tasks and their left-over files
do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import broadcast_if_bounded


@contextmanager
def new_file(folder: str, prefix: str, suffix: str) -> Iterator[tuple[str, object]]:
    """(name, stream) of a new file of ``folder`` (a URI or an absolute path); visible under the name once closed."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{prefix}-{uuid.uuid4().hex}{suffix}"
    hidden = f"{path}/_{name}.part"
    with system.open_output_stream(hidden) as stream:
        yield name, stream
    system.move(hidden, f"{path}/{name}")


def read_files(manifest: DataFrame, folder: str, suffix: str) -> DataFrame:
    """``manifest`` (with the column name; one row per file) joined with each file's bytes as ``content``.

    The manifest is broadcast up to the row bound of the library; larger ones are joined by a shuffle.
    """
    files = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.join(broadcast_if_bounded(manifest, manifest.count()), "name")
