"""Run log: one row for each run, from its start on, and the counts of its stages."""

from __future__ import annotations

import contextlib
import datetime
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RUN_LOG


@contextlib.contextmanager
def run(spark: SparkSession, path: str, source: str) -> Iterator[dict]:
    """A RUN_LOG row below path, running while the block runs, then success, or failed with the error raised on. The block fills the counts of the dict it gets."""
    run_id, started, clock, counts = uuid.uuid4().hex, datetime.datetime.now(datetime.UTC), time.monotonic(), {}

    def tell(status: str) -> None:
        row = {"run_id": run_id, "source": source, "status": status, "started_at": started, "elapsed_seconds": time.monotonic() - clock} | counts
        spark.createDataFrame([[row.get(f.name) for f in RUN_LOG]], RUN_LOG).coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run_id}")

    tell("running")
    status = "failed"
    try:
        yield counts
        status = "success"
    finally:
        tell(status)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """All RUN_LOG rows below path."""
    return spark.read.schema(RUN_LOG).option("recursiveFileLookup", True).parquet(path)


def stage_counts(validated: DataFrame) -> DataFrame:
    """loaded, accepted, rejected, flagged of a validated table in one pass."""
    ok = F.col("reason_code").isNull()
    return validated.select(F.count("*").alias("loaded"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_if(ok & (F.col("missing_title_flag") | F.col("year_uncertain"))).alias("flagged"))
