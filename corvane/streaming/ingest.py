"""Incremental work as Structured Streaming: ingestion of files, windowed statistics, gauges.

Sources are directories that files arrive in; checkpoints and outputs lie in the shared folder, and every sink is
idempotent, so a restarted query continues where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import library
from ..session import exists, scratch


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive under *path* (a folder or a pattern)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drained(stream: DataFrame, mode: str = "append", key: str | None = None) -> DataFrame:
    """Runs *stream* over all that is there, writes it as Parquet, and returns what was written. In mode complete each batch
    is the whole result; in mode update the last row of each *key* counts."""
    out, spark = scratch(stream.sparkSession, "stream"), stream.sparkSession

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    w = stream.writeStream.option("checkpointLocation", f"{out}-checkpoint").outputMode(mode).trigger(availableNow=True)
    q = (w.format("parquet").option("path", out) if mode == "append" else w.foreachBatch(replace)).start()
    q.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    t = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return t.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_last")).select("_last.*")


def imported(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Files registered by content: each batch adds what no earlier batch has. A batch is written under its number, so
    a repeated batch replaces itself, and compares with the other batches only."""
    out, spark, schema = scratch(stream.sparkSession, "import"), stream.sparkSession, stream.schema

    def add(batch: DataFrame, number: int) -> None:
        before = batch.limit(0)
        if exists(spark, out):
            before = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", out).parquet(out).where(F.col("batch") < number)
        fresh = library.insert_absent(before, batch, key, order)
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def windowed(events: DataFrame, time: str, kind: str, value: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per tumbling window and kind, with a watermark for late events (an extension)."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Sessions of a key that end after *gap* without an event (an extension)."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def gauges(events: DataFrame, time: str, tie: str, kind: str, value: str) -> DataFrame:
    """The latest value of each kind: latest wins."""
    return events.groupBy(kind).agg(F.max_by(value, F.struct(time, tie)).alias("latest"), F.count(F.lit(1)).alias("n"))


def sse_events(chunks: DataFrame) -> DataFrame:
    """Server-sent events from ordered chunks (stream_id, seq, data), which may be cut anywhere: rows (stream_id, position,
    kind, text), kind one of delta, finish, usage, error, done."""
    whole = chunks.groupBy("stream_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(seq, data))), x -> x.data), '')").alias("body"))
    e = whole.select("stream_id", F.posexplode(F.expr(r"filter(split(replace(body, '\r\n', '\n'), '\n\n', -1), x -> trim(x) <> '')")).alias("position", "event"))
    e = e.withColumn("data", F.expr(r"array_join(transform(filter(split(event, '\n', -1), x -> startswith(x, 'data:')), x -> ltrim(substring(x, 6))), '\n')"))
    e = e.withColumn("j", F.from_json("data", "choices array<struct<delta: struct<content: string>, finish_reason: string>>, usage struct<total_tokens: int>, error struct<message: string>"))
    return e.select("stream_id", "position", F.expr(
        "case when data = '[DONE]' then 'done' when j.error is not null then 'error' when j.choices[0].finish_reason is not null then 'finish' "
        "when j.choices[0].delta.content is not null then 'delta' when j.usage is not null then 'usage' end").alias("kind"),
        F.expr("coalesce(j.choices[0].delta.content, j.choices[0].finish_reason, j.error.message, cast(j.usage.total_tokens as string))").alias("text")).where("kind is not null")


def registry(events: DataFrame, kind: str, value: str, time: str, tie: str, keep: int = 2000) -> DataFrame:
    """Running statistics of each operation: rows (operation, total, p50, p95, longest) after each batch, percentiles by nearest
    rank over the *keep* latest durations by *time* and *tie*, in whatever order they arrive; these are the state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        import math

        import pandas as pd

        total, *columns = state.get if state.exists else (0, [], [], [])
        latest = list(zip(*columns, strict=True))
        for b in batches:
            total += len(b)
            latest = sorted([*latest, *zip(b["t"].tolist(), b["i"].tolist(), b["v"].tolist(), strict=True)])[-keep:]
        state.update((total, *(list(x) for x in zip(*latest, strict=True))))
        ranked = sorted(v for *_, v in latest)
        at = lambda p: ranked[max(1, math.ceil(p * len(ranked))) - 1]
        yield pd.DataFrame({"operation": [key[0]], "total": [total], "p50": [at(0.5)], "p95": [at(0.95)], "longest": [ranked[-1]]})

    t = events.select(F.col(kind).alias("operation"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(tie).cast("long").alias("i"), F.col(value).cast("double").alias("v")).where("v is not null")
    return t.groupBy("operation").applyInPandasWithState(
        step, "operation string, total long, p50 double, p95 double, longest double", "total long, times array<long>, ties array<long>, recent array<double>", "update", GroupStateTimeout.NoTimeout)
