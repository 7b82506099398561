"""Session builder and table loader shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_STAND_IN: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that Python workers can
    import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="corvane-ship-")) / "corvane.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def build_session(app: str = "corvane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; *conf* (dots as ``__``) overrides them.

    Nothing here fixes the size of a cluster: adaptive execution coalesces and splits shuffle
    partitions at run time, and ``master`` is only set when the caller asks for it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing (tests, one machine), a temporary folder stands in; on a cluster that would be a
    folder of one machine only, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _STAND_IN:
            _STAND_IN[app] = "file://" + tempfile.mkdtemp(prefix="corvane-shared-")
        found = _STAND_IN[app]
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder, for the end of a job: results that are not yet read
    need their tables until then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """*df* dealt by *keys* into as many partitions as a shuffle has, however few bytes it is: for folds that cost far more than
    their bytes, which adaptive execution would give to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shuffles(df: DataFrame, most: int) -> int:
    """Partitions that hold at most *most* rows of *df* each, and no fewer than a shuffle has. Adaptive execution joins small partitions
    by their bytes alone and shares out what is left among the cores, so what a task holds would grow with the input; a
    stated number is kept. Rows of Parquet files are counted from their footers."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // max(1, most)))


#: Rows of a table that a task sorts, joins and groups by a key.
ROWS = 250_000


def spread(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """Rows of a table dealt by *keys* into partitions of about ROWS each, for all that follows by these keys: joins, windows and
    groups use the partitions as they are. To be joined with a larger table, it has as many partitions as that (*like*)."""
    return df.repartition(shuffles(df if like is None else like, ROWS), *keys)


def through(df: DataFrame, fold: Callable, schema: str, rows: int = 256, most: int = 1 << 20) -> DataFrame:
    """*df* through Python: *fold* takes some rows as dictionaries and gives tuples of *schema*. It sees *rows* rows or *most* bytes at a time.
    Spark's batches hold 10,000 rows or 64 MB; as Python objects these would be many times as large, and so would what the fold gives for them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            step = max(1, min(rows, b.num_rows * most // max(1, b.nbytes)))
            for a in range(0, b.num_rows, step):
                out = fold(b.slice(a, step).to_pylist())
                for o in range(0, len(out), 10_000):
                    columns = list(zip(*out[o : o + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kinds, strict=True)], kinds.names)

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table *name* of a data directory (any URI that Spark reads)."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
