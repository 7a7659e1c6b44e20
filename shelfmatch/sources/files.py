"""Digests of files of any size."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a file that a task holds at a time.
RANGE_BYTES = 8 * 1024 * 1024


def digest_of(path: str, range_bytes: int = RANGE_BYTES) -> str:
    """SHA-256 of a file in a store that Arrow reads, from ranges of the file in their order."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, authority, name = re.fullmatch(r"(?:([\w+.-]+):)?(//[^/]*)?(/.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        store = LocalFileSystem()
    else:
        # Spark's paths are not percent-encoded, addresses are.
        store, name = FileSystem.from_uri(f"{scheme}:{authority or '//'}{quote(name)}")
    digest = hashlib.sha256()
    with store.open_input_stream(name) as stream:
        while part := stream.read(range_bytes):
            digest.update(part)
    return digest.hexdigest()


def with_digests(files: DataFrame, path: str = "path", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``files`` (path, length and more) with ``sha256``; a file is read in ranges and is never one row.

    Files are dealt by path, so that a few large ones do not share a task. Files that cannot be read are
    an error, as a snapshot without them would be wrong.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest_of(p, range_bytes) for p in batch.column(batch.schema.get_field_index(path)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "sha256"])

    schema = files.select("*", F.lit("").alias("sha256")).schema
    return files.repartition(path).mapInArrow(run, schema)
