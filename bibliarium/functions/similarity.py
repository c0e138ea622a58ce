"""Token-sort similarity: the insertion-deletion ratio of strings whose words are sorted."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _SPACES, trim


def sorted_tokens(c: Column) -> Column:
    """Lower case, words sorted and joined by a blank; null gives an empty string."""
    return F.coalesce(F.array_join(F.sort_array(F.split(trim(F.lower(c)), _SPACES)), " "), F.lit(""))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of it in the bits of one integer."""
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """common_length() of two columns; null gives null."""

    @F.arrow_udf("int")
    def measure(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else common_length(p, q) for p, q in zip(x.to_pylist(), y.to_pylist())], pa.int32())

    return measure(a, b)
