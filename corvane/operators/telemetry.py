"""Operation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def nearest_rank(values: str, p: float) -> str:
    """The nearest-rank percentile of a sorted array: its element ceil(p * n)."""
    return f"try_element_at({values}, greatest(1, cast(ceil({p}D * size({values})) as int)))"


def operation_stats(events: DataFrame, name: str = "event_type", time: str = "ts", tie: str = "event_id", value: str = "value", failed: str = "event_type = 'error'", keep: int = 2000) -> DataFrame:
    """For each operation: total, failed, error rate over all events; p50, p95 and maximum of the durations of its last
    *keep* events. The bound is the size of the sample that the statistic is defined on."""
    by = Window.partitionBy(name).orderBy(F.desc(time), F.desc(tie))
    last = events.select(name, F.col(value).alias("v"), F.row_number().over(by).alias("n")).where(F.col("n") <= keep)
    d = last.groupBy(name).agg(F.sort_array(F.collect_list("v")).alias("a")).select(
        name, F.expr(nearest_rank("a", 0.5)).alias("p50"), F.expr(nearest_rank("a", 0.95)).alias("p95"), F.expr("try_element_at(a, -1)").alias("longest"))
    n = events.groupBy(name).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr(failed)).alias("failed"))
    return n.join(d, name, "left").withColumn("error_rate", F.round(F.col("failed") / F.col("total"), 6))


def throughput(events: DataFrame, name: str = "event_type", units: str = "1", ms: str = "value") -> DataFrame:
    """Units a second of each operation, over all its time; null if it took none. *units* and *ms* are SQL."""
    t = events.groupBy(name).agg(F.sum(F.expr(f"cast({units} as bigint)")).alias("units"), F.sum(F.expr(ms)).alias("ms"))
    return t.select(name, "units", F.round(F.expr("if(ms > 0, units * 1000 / ms, null)"), 3).alias("per_second"))
