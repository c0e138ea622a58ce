"""Embedding whitening (operator 11): MLlib's computeSVD on centred distributed rows, singular values over the root of n.

An entry c becomes the integer x = floor(1024 * c) + 100000, so that sums and deviations are exact. Rows are centred
before anything is multiplied; the right singular vectors of the centred rows are the eigenvectors of x's covariance
(divisor n), and s^2 / n its eigenvalues e. The total variance, which explained shares are of, does not come from the
decomposition but from the rows' exact deviations. computeSVD is asked for all components where the width is at most
WIDEST, as it then solves the Gram matrix densely, to double precision; wider vectors by Lanczos iteration.

Rows whose vector is null, empty, or has a null or non-finite entry go, as do those with an entry of 2^52 or more
and those of another width than most (of widths that tie, the greatest stays). Null and repeated ids stay, and every
row counts, so one vector that a third of all rows hold is read like any other. Components with no variance (under
LEAST of the first's) are left out: equal vectors, or one row alone, give no rows, as does an empty table. A deviation
that a long can't hold is null. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, written

#: Fixed values of the contract: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100000
#: Widths up to which all components are asked for: the Gram matrix has WIDEST^2 / 2 doubles, whatever the number of rows.
WIDEST = 4096
#: Eigenvalues below this share of the first are rounding, not variance.
LEAST = 1e-10


def clean(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of the rows that are fit for use."""
    v = F.col(vector_col).cast("array<double>")
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < 2.0**52), F.lit(False)))
    kept = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(fit, v).alias("v")).where("v IS NOT NULL")
    width = kept.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()  # one row a width
    x = F.transform("v", lambda c: (F.floor(c * SCALE) + SHIFT).cast("bigint"))
    return kept.where(F.size("v") == (width["w"] if width else 0)).select("vec_id", x.alias("x"))


def _deviations(x: np.ndarray, n: int, sums: list[int], near: np.ndarray) -> list[int]:
    """The sum of (n * x - S)^2 of each row, exactly: in 64 bits where they hold it, else in whole numbers of any length."""
    if max(near.max(initial=0), float(np.abs(x).max(initial=0)) * n) < 2.0**62:
        return np.square(x * n - np.array(sums, np.int64)).sum(axis=1).tolist()
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]


def _apply(n: int, sums: list[int], axes: np.ndarray, roots: np.ndarray):
    """Of each row: its deviation (null beyond a long), the same as a double, and its whitened coordinates."""
    mean = np.array([s / n for s in sums])

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(sums))
            centred = x - mean
            told = _deviations(x, n, sums, np.square(centred * n).sum(axis=1))
            w = pa.FixedSizeListArray.from_arrays((centred @ axes / roots).reshape(-1), len(roots)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("vec_id"), pa.array([e if e < 2**63 else None for e in told], pa.int64()), pa.array([float(e) for e in told]), w], ["vec_id", "deviation", "near", "w"])

    return run


def whiten(rows: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, of each row that is fit and each of the k first components."""
    spark = rows.sparkSession
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    x = written(clean(rows, id_col, vector_col), "vectors")
    sums = [r["s"] for r in x.select(F.posexplode("x").alias("j", "c")).groupBy("j").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("j").collect()]  # a row a dimension
    n, d = x.count(), len(sums)
    if not n:
        return spark.createDataFrame([], schema)
    sums = [int(s) for s in sums]
    mean = F.lit([s / n for s in sums])
    centred = x.select(array_to_vector(F.zip_with("x", mean, lambda a, m: a - m)).alias("c"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "c"), n, d).computeSVD(d if d <= WIDEST else min(k, d), computeU=False, rCond=math.sqrt(LEAST))
    values = np.square(found.s.toArray()[:k]) / n
    if not len(values) or not values[0] > 0:
        return spark.createDataFrame([], schema)
    axes = found.V.toArray()[:, : len(values)]
    made = written(x.mapInArrow(_apply(n, sums, axes, np.sqrt(values)), "vec_id bigint, deviation bigint, near double, w array<double>"), "whitened")
    # covar_pop centres as it goes; k (k + 1) / 2 sums in one pass
    at = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    told = made.agg(F.sum(F.col("deviation").cast("decimal(38,0)")).alias("exact"), F.sum(F.when(F.col("deviation").isNull(), F.col("near"))).alias("beyond"), *(F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in at)).first()
    total = (float(told["exact"] or 0) + (told["beyond"] or 0.0)) / n**3
    error = max(abs(told[f"c{i}_{j}"] - (i == j)) for i, j in at)
    free(x)
    share = F.lit([float(e / total) for e in values])
    return made.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error")
    )
