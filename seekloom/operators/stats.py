"""Exact order statistics without gathering values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are cut into.
RANGES = 64


def percentiles(values: DataFrame, places: dict[str, int]) -> DataFrame:
    """``name, value``: of the column ``value``, in order, the one at index ceil((n - 1) * p / 100) for each name's p.

    Equal values are counted first; ranges of values are summed up apart, and the sums of earlier ranges, one number for
    each, are added. Nulls don't count; without values there are no rows.
    """
    counts = values.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    head = counts.agg(F.percentile_approx("value", [k / RANGES for k in range(1, RANGES)], 100 * RANGES).alias("cuts"), F.sum("n").alias("total")).head()
    if not head["total"]:
        return values.select(F.lit(None).cast("string").alias("name"), "value").where(F.lit(False))
    cuts = F.array(*[F.lit(c) for c in sorted(set(head["cuts"]))])
    placed = counts.withColumn("range", F.size(F.filter(cuts, lambda c: c < F.col("value"))))
    before, offsets = 0, []
    for row in placed.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # RANGES rows
        offsets.append((row["range"], before))
        before += row["n"]
    offset = placed.sparkSession.createDataFrame(offsets, "range int, before long")
    running = placed.join(F.broadcast(offset), "range").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy("value")))
    wanted = [(name, -(-(head["total"] - 1) * p // 100) + 1) for name, p in places.items()]
    at = placed.sparkSession.createDataFrame(wanted, "name string, place long")
    return running.join(F.broadcast(at), (F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place"))).select("name", "value")
