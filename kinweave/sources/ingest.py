"""Ingest: discovery of files, content hashes, the cache of results, and what is left to do."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT, EngineConfig
from ..functions.scalars import projected_seconds, sequence_of
from ..operators.gates import without
from .sinks import current_path, exists


def discover(spark: SparkSession, folder: str, ignore: Iterable[str] = (), only: Iterable[str] = (), limit: int | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """id, path, seq, bytes, modified of the photos directly in a folder, by number, then id. The content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length", "modificationTime")
    return select_files(files.withColumnRenamed("length", "bytes").withColumnRenamed("modificationTime", "modified"), ignore, only, limit, cfg)


def select_files(files: DataFrame, ignore: Iterable[str] = (), only: Iterable[str] = (), limit: int | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The rules of discovery over a listing (path, ...): name pattern, ignored ids without regard to case, `only`, then the limit."""
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.withColumn("seq", sequence_of(name, cfg)).where("seq is not null").withColumn("id", F.regexp_replace(name, r"\.[^.]*$", ""))
    ignored = [x.lower() for x in ignore]
    listed = listed.withColumn("__low", F.lower("id"))
    listed = without(listed, "__low", ignored).drop("__low")
    wanted = list(only)
    if wanted:
        listed = listed.where(F.col("id").isin(wanted))
    listed = listed.orderBy("seq", "id")
    return listed.limit(limit) if limit else listed


def content_hash(files: DataFrame, manifest: DataFrame, content_col: str = "content") -> DataFrame:
    """files (path, size, mtime_ms, content) with sha1: known where path, size and time are as in the manifest, else computed.

    Only files that the manifest misses need their content.
    """
    known = manifest.select("path", "size", "mtime_ms", F.col("sha1").alias("known"))
    joined = files.join(known, ["path", "size", "mtime_ms"], "left")
    return joined.withColumn("sha1", F.coalesce("known", F.sha1(F.col(content_col).cast("binary")))).withColumn("hashed", F.col("known").isNull()).drop("known", content_col)


def cached_results(photos: DataFrame, cache: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """photos joined with results of the same content and settings."""
    return photos.join(cache.where(F.col("fingerprint") == cfg.detection_fingerprint()).drop("fingerprint"), "sha1")


def work_state(force: bool = False, skip_failed: bool = False) -> Column:
    """todo, ok or failed for a photo left-joined with its cached status."""
    failed = F.lit("failed") if skip_failed else F.lit("todo")
    return F.when(F.lit(force), F.lit("todo")).when(F.col("status") == "ok", F.lit("ok")).when(F.col("status") == "failed", failed).otherwise(F.lit("todo"))


def classify(photos: DataFrame, cache: DataFrame, force: bool = False, skip_failed: bool = False, cfg: EngineConfig = DEFAULT, key: str = "sha1") -> DataFrame:
    """photos with state: what the cache holds, what failed and what is to do."""
    held = cache.where(F.col("fingerprint") == cfg.detection_fingerprint()).select(F.col(key).alias("__key"), "status").dropDuplicates(["__key"])
    return photos.join(held, F.col(key) == F.col("__key"), "left").withColumn("state", work_state(force, skip_failed)).drop("__key", "status")


def todo(photos: DataFrame, cache: DataFrame, cfg: EngineConfig = DEFAULT, key: str = "sha1") -> DataFrame:
    done = cache.where((F.col("fingerprint") == cfg.detection_fingerprint()) & (F.col("status") == "ok")).select(key)
    return photos.join(done, key, "left_anti")


def failures(results: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """n, failed, ratio, abort in one row."""
    return results.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed")).withColumn("ratio", F.when(F.col("n") > 0, F.col("failed") / F.col("n")).otherwise(F.lit(0.0))).withColumn("abort", F.col("ratio") >= cfg.fail_ratio_abort)


def time_left(done: DataFrame, left: Column, workers: int, ms_col: str = "ms") -> DataFrame:
    """mean_ms, seconds_left: from the mean duration of what is done."""
    mean = done.agg(F.avg(ms_col).alias("mean_ms"))
    return mean.withColumn("seconds_left", projected_seconds(left, F.col("mean_ms") / 1000, workers))


def issues(results: DataFrame, subject: str = "id") -> DataFrame:
    """level, subject, message: an error for each failure and a warning for each note, as rows; retried tasks can't count twice."""
    bad = results.where("status = 'failed'").select(F.lit("error").alias("level"), F.col(subject).cast("string").alias("subject"), F.coalesce("error", F.lit("unknown")).alias("message"))
    notes = results.select(F.lit("warning").alias("level"), F.col(subject).cast("string").alias("subject"), F.explode("warnings").alias("message"))
    return bad.unionByName(notes)


def read_table(spark: SparkSession, path: str, schema: str, optional: bool = False, multiline: bool = True) -> DataFrame:
    """A JSON table with its schema: a file, a folder, or the current version of a committed one.

    A missing optional one is empty; a corrupt one raises.
    """
    if not exists(spark, path):
        if optional:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(multiline).lower()).json(current_path(spark, path) or path)


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """People that have photos."""
    return read_table(spark, path, schemas.PERSON, optional=True, multiline=False).where(F.size("photos") > 0)


def parse_options(threshold: float | None = None, **flags: object) -> EngineConfig:
    """Settings from keyword flags; a threshold must lie in (0, 2]."""
    import dataclasses

    if threshold is not None:
        if not 0 < threshold <= 2:
            raise ValueError("threshold must be above 0 and at most 2")
        flags["similarity"] = threshold
    return dataclasses.replace(DEFAULT, **flags)


def runs_stage(name: str, stages: list[str], first: str | None = None, only: str | None = None) -> bool:
    """Whether a stage runs: the only one, or one from `first` on."""
    return name == only if only else stages.index(name) >= stages.index(first or stages[0])
