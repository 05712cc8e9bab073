"""The shared folder and tables in it that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession


def storage_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where the setting is absent and driver and tasks are one process, as in local tests, a temporary folder is made and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="kinweave-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{storage_root(spark)}/kinweave/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, Spark (4.1 on) deletes what an action has shuffled as soon as it ends, not when the driver next collects garbage. For plans that run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage.

    The written files outlive the loss of any executor.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: How Spark names stores that Arrow knows under another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "dbfs": "file", "wasbs": "abfs", "abfss": "abfs"}


def read_folder(uri: str) -> pa.Table:
    """All rows of the Parquet files in a folder of the shared store, read by a task itself, through Arrow's file systems."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        fs, path = pa.fs.LocalFileSystem(), uri
    elif scheme in ("file", "dbfs"):
        fs, path = pa.fs.LocalFileSystem(), ("/dbfs/" if scheme == "dbfs" else "/") + rest.lstrip("/")
    else:
        fs, path = pa.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    found = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(path)) if f.is_file and f.path.endswith(".parquet"))
    tables = []
    for name in found:
        with fs.open_input_file(name) as source:
            tables.append(pa.parquet.ParquetFile(source).read(use_threads=False))
    return pa.concat_tables(tables)
