"""Deterministic pieces of a table of texts, which later steps come back to by number.

A piece row holds some documents and whatever a step has made of them, as compressed bytes. Pieces are written to the
shared folder once, so that their numbers stay what they are when a task is run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Bytes of text in a piece, unless one document alone has more.
PIECE_BYTES = 4 << 20


def pieces(docs: DataFrame, make: Callable[[list[pa.RecordBatch]], dict[str, bytes | int]], schema: str, what: str, columns: list) -> DataFrame:
    """A written table of (piece, ...): make() gets batches of columns (id, text, ...) of about PIECE_BYTES of text and gives the values of schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            made = make(held)
            return pa.record_batch([pa.array([(task << 24) + seq], pa.int64()), *(pa.array([made[n]], k) for n, k in zip(names, kinds))], ["piece", *names])

        for batch in slices(batches):
            size += batch.column(1).nbytes
            held.append(batch)
            if size >= PIECE_BYTES:
                yield flush()
                seq, held, size = seq + 1, [], 0
        if held:
            yield flush()

    return written(docs.select(*columns).mapInArrow(run, f"piece bigint, {schema}"), what)


def text_columns(id_col: str, text_col: str) -> list:
    return [F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
