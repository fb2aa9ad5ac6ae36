"""Band joins: pairs whose times lie within a width, without a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_t: str, right_t: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """left and right rows with equal keys and |left_t - right_t| <= width (numbers). A row of right goes to its own
    bucket of that width and both neighbours, a row of left to its own, so every pair meets exactly once; the shuffle is
    three times right, and a bucket's rows are those of one key and one width of time. Column names must not clash but
    for the keys."""
    keys = keys or []
    a = left.withColumn("_bucket", F.floor(F.col(left_t) / width).cast("long"))
    b = right.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(right_t) / width).cast("long") + d)))
    return a.join(b, [*keys, "_bucket"]).where(F.abs(F.col(left_t) - F.col(right_t)) <= width).drop("_bucket")
