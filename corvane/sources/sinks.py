"""Sinks: derived tables by document, redacted logs, files by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T


def replace_documents(df: DataFrame, path: str, key: str = "document_id") -> None:
    """Replaces all that is derived from the documents in *df* and leaves the others alone; writing the same again
    changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def redacted(df: DataFrame, mask: str = "[redacted]") -> DataFrame:
    """Log records without values of sensitive fields; user paths in other text are masked and long text is cut."""
    from pyspark.sql.types import StringType

    out = []
    for f in df.schema:
        if T.is_sensitive(f.name):
            out.append(F.when(F.col(f.name).isNotNull(), F.lit(mask)).alias(f.name))
        else:
            out.append(F.expr(T.sanitize(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name))
    return df.select(*out)


def log(df: DataFrame, path: str, rows_per_file: int = 50_000) -> None:
    """Appends redacted records as JSON lines, in files of a bounded number of records."""
    redacted(df).write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)


def by_content(files: DataFrame) -> DataFrame:
    """Files (path, content) as a store by content: rows (name, content), name the SHA-256 and the extension, once each."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    return files.select(F.concat(F.sha2("content", 256), ext).alias("name"), "content").groupBy("name").agg(F.any_value("content").alias("content"))
