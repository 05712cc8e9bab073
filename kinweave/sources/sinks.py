"""Sinks: versioned tables with a pointer, snapshots and templates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name, then move it into place in one step: a reader sees the old file or the new one."""
    fs, _ = _fs(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, part = fs.makeQualified(hadoop.Path(path)), fs.makeQualified(hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp"))
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(part, final, over)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def commit_version(df: DataFrame, root: str, kind: str = "parquet") -> str:
    """Write a new version below root, then point `CURRENT` at it. Readers keep the old version until then; one writer at a time."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.format(kind).save(f"{root}/{version}")
    _write_text(df.sparkSession, f"{root}/CURRENT", version)
    return version


def current_path(spark: SparkSession, root: str, version: str | None = None) -> str | None:
    """The folder of the current version, or of a named one; None before the first commit. Versions without a pointer raise."""
    version = version or _read_text(spark, f"{root}/CURRENT")
    if version:
        return f"{root}/{version}"
    fs, p = _fs(spark, root)
    if fs.exists(p) and any(f.isDirectory() and f.getPath().getName().startswith("v-") and fs.exists(f.getPath().suffix("/_SUCCESS")) for f in fs.listStatus(p)):
        raise ValueError(f"{root} holds versions, but none is marked as the current one")
    return None


def read_version(spark: SparkSession, root: str, schema: str, version: str | None = None) -> DataFrame:
    """The current version, or a named one; empty before the first commit."""
    path = current_path(spark, root, version)
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], schema: str) -> str:
    """The current version with rows of the same keys replaced."""
    old = read_version(spark, root, schema)
    return commit_version(old.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*old.columns)), root)


def snapshot(spark: SparkSession, roots: dict[str, str]) -> dict[str, str | None]:
    """The current version of each table; versions are never overwritten, so their names are a backup. Missing tables give None."""
    return {name: _read_text(spark, f"{root}/CURRENT") for name, root in roots.items()}


def write_template(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file only if there is none."""
    if exists(spark, path):
        return False
    _write_text(spark, path, text)
    return True


def clear(spark: SparkSession, path: str, yes: bool = False) -> bool:
    """Delete a cache; asks for yes."""
    fs, p = _fs(spark, path)
    return bool(yes and fs.exists(p) and fs.delete(p, True))


def pending_outputs(photos: DataFrame, done: DataFrame, covers: DataFrame) -> DataFrame:
    """id, covers: photos whose derivatives are missing, and those with covers, which are always made again."""
    from pyspark.sql import functions as F

    faces = covers.groupBy(F.col("photo_id").alias("id")).agg(F.sort_array(F.collect_list("face_id")).alias("covers"))
    held = done.select("id", F.lit(True).alias("__done")).distinct()
    joined = photos.select("id").join(faces, "id", "left").join(held, "id", "left")
    return joined.where("__done is null or covers is not null").select("id", F.coalesce("covers", F.array().cast("array<string>")).alias("covers"))
