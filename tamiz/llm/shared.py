"""Shared folder, byte-level file access by URI, and small helpers used by the operators.

Every file that outlives a task goes below the folder named by ``spark.checkpoint.dir``, the one place
that the driver and all executors see.  Files are opened through ``pyarrow.fs`` so that the folder may be
a mounted path or an object store.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def workspace(spark: SparkSession, tag: str) -> str:
    """URI of a fresh folder for one run of one operator, under the session's checkpoint folder.

    Without ``spark.checkpoint.dir`` (tests, a laptop) a temporary folder is used, which is only right
    where driver and executors share one machine, so any other master is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="tamiz-"))
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def put_bytes(uri: str, data: bytes | memoryview | pa.Buffer) -> None:
    """Write a file so that readers see all of it or nothing; a repeated attempt replaces it."""
    with writing(uri) as f:
        f.write(data)


@contextmanager
def writing(uri: str):
    """A stream to a new file that appears, whole, at ``uri`` when the block ends without an error."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as f:
        yield f
    fs.move(part, path)


def get_bytes(uri: str) -> pa.Buffer:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def settle(df: DataFrame, uri: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def numbered(docs: DataFrame) -> DataFrame:
    """The table with its columns named c0, c1, ..., so that no name of the user's clashes with an operator's."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def column_of(docs: DataFrame, name: str) -> str:
    """The name of a column in ``numbered(docs)``."""
    return f"c{docs.columns.index(name)}"


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, whatever else the table carries."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
