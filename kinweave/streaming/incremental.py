"""Incremental analysis: new content once, the rest from the cache; failures are recorded, never fatal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..sources.ingest import todo


def analyse_batch(rows: DataFrame, engine: Callable[[DataFrame], DataFrame], cache: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Results (sha1, fingerprint, status, error, result) of the rows that the cache doesn't hold.

    engine maps rows (sha1, ...) to (sha1, status, error, result); a bad record is a row with status failed, which the next run tries again.
    """
    return engine(todo(rows.dropDuplicates(["sha1"]), cache, cfg)).withColumn("fingerprint", F.lit(cfg.detection_fingerprint()))


def _held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches below path; empty where there are none yet."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def run_incremental(spark: SparkSession, source: str, schema: str, engine: Callable[[DataFrame], DataFrame], cache_path: str, checkpoint: str, cfg: EngineConfig = DEFAULT, content: str = "content") -> None:
    """Offer what failed in earlier runs again, then read new files of a folder as a stream until all are seen; append the results to the cache.

    A micro-batch that is run again after a failure writes its own folder again, so nothing is counted twice. The stream never
    offers a file twice, so rows whose analysis failed are kept beside the cache, in `<cache_path>-failed`.
    """
    from .. import schemas

    failed_path, kinds = f"{cache_path}-failed", f"{schema}, sha1 string"

    def analyse(rows: DataFrame, cache: DataFrame, name: str) -> None:
        found = analyse_batch(rows, engine, cache, cfg).select("sha1", "fingerprint", "status", "error", "result")
        found.write.mode("overwrite").parquet(f"{cache_path}/{name}")
        bad = spark.read.schema(schemas.ANALYSIS_CACHE).parquet(f"{cache_path}/{name}").where("status = 'failed'").select("sha1").distinct()
        rows.join(bad, "sha1", "left_semi").dropDuplicates(["sha1"]).select(*spark.createDataFrame([], kinds).columns).write.mode("overwrite").parquet(f"{failed_path}/{name}")

    def each(batch: DataFrame, number: int) -> None:
        cache = _held(spark, cache_path, schemas.ANALYSIS_CACHE).where(~F.input_file_name().contains(f"/batch-{number}/"))
        analyse(batch.withColumn("sha1", F.sha1(F.col(content).cast("binary"))), cache, f"batch-{number}")

    again = _held(spark, failed_path, kinds)
    cache = _held(spark, cache_path, schemas.ANALYSIS_CACHE)
    if not todo(again.dropDuplicates(["sha1"]), cache, cfg).isEmpty():
        analyse(again, cache, f"again-{uuid.uuid4().hex}")
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def decision_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str) -> None:
    """Append a folder of decision events to a log; the latest per pair is a query over it."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
