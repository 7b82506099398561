"""What the operators share: written intermediate tables, joins with hot keys and letters of ASCII."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that hold more than one row in so many are joined by broadcast; there are at most so many of them.
HOT = 1000
#: Paths written while :func:`finished` runs, for each call that is open.
_OPEN: list[list[str]] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the folder that driver and executors share; nothing else uses it."""
    return scratch(spark, what)


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """*df*, written as Parquet to the shared folder and read again: its lineage ends there.

    A lost executor then costs one task of reading, not a recomputation of what led to the table,
    and the size of the files lets Spark decide about broadcasts from facts.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame], what: str = "table") -> DataFrame:
    """The table that *make* describes, written; what was written on the way is deleted then."""
    _OPEN.append([])
    try:
        df = make()
        done = written(df, what)
        own = _OPEN[-1].pop()
    finally:
        for path in _OPEN.pop():
            _delete(df.sparkSession, path)
    if _OPEN:
        _OPEN[-1].append(own)
    return done


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written` that nothing will read any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], times: str, spread: Column) -> DataFrame:
    """*rows* left-joined with *facts* on *keys*, whatever share of the rows one key has.

    *facts*, a written table, has one row for each key, and *times* tells how many of *rows* have that key. Keys above one in
    HOT of that sum, at most HOT by counting, are broadcast; their rows go on under *spread*, so no task gets all of one key.
    """
    total = facts.agg(F.sum(times)).first()[0] or 0
    named = lambda side: [F.col(k).alias(f"{side}_{k}") for k in keys]
    found = [c for c in facts.columns if c not in keys]
    is_hot = F.col(times) * HOT > total
    hot = facts.where(is_hot).select(*named("hot"), F.struct(*found).alias("hot_found"))
    cold = facts.where(~is_hot).select(*named("cold"), F.struct(*found).alias("cold_found"))
    t = rows.join(F.broadcast(hot), F.expr(" and ".join(f"{k} = hot_{k}" for k in keys)), "left")
    t = t.withColumn("hot_at", F.when(F.col("hot_found").isNull(), F.col(keys[0])).otherwise(spread))
    rest = "".join(f" and {k} = cold_{k}" for k in keys[1:])
    t = t.join(cold, F.expr(f"hot_found is null and hot_at = cold_{keys[0]}{rest}"), "left")
    # field by field, so that what is not asked of a struct in *rows* is left out before the joins
    return t.select(*rows.columns, *[F.coalesce(F.col("hot_found").getField(c), F.col("cold_found").getField(c)).alias(c) for c in found])
