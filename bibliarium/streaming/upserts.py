"""Versioned upserts of a stream of records: each micro-batch goes through the batch plan."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import curate
from ..sources.tables import Store


def upsert_stream(records: DataFrame, store: Store, checkpoint: str, current_year: int | None = None, **trigger) -> StreamingQuery:
    """Starts the upserts of records (flat fields, pos). A batch that is run again after a failure makes no second version, since it changes nothing, and its rejects take the place of those it left before."""

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            curate(store, df.withColumn("pos", F.col("pos").cast("bigint")), datetime.datetime.now(datetime.UTC).replace(tzinfo=None), current_year, batch=f"{checkpoint}/{number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
