"""The document library as DataFrames: imports, replacement, jobs, views, removal.

Every mutation is a function from tables to tables; whoever writes the result decides about the file layout
(for instance dynamic partition overwrite by document). Keys are joined as they are: adaptive execution
broadcasts a side when its measured size allows and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Statuses of documents whose import is not finished (fixed values).
UNFINISHED = ("queued", "extracting", "structuring", "chunking")


def insert_absent(known: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of *incoming* whose key is neither known nor used by an earlier row of the batch."""
    first = Window.partitionBy(key).orderBy(*order)
    fresh = incoming.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return fresh.join(known.select(key), key, "left_anti").select(*incoming.columns)


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """*table* with the rows of *changes* in place of those with the same key."""
    return table.join(changes.select(*key), key, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def delete(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """*table* without the rows whose key is in *gone*."""
    return table.join(gone.select(*key).distinct(), key, "left_anti").select(*table.columns)


def orphans(stored: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What is stored but no longer known."""
    return stored.join(known.select(key), key, "left_anti")


def moved(table: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Paths under *old* moved to *new*."""
    return table.withColumn(column, F.when(F.col(column).startswith(old), F.concat(F.lit(new), F.expr(f"substring({column}, {len(old) + 1})"))).otherwise(F.col(column)))


def with_latest(left: DataFrame, right: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """*left* with *columns* of the last row of *right* with the same key, null if there is none."""
    last = right.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_last"))
    return left.join(last, key, "left").select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in columns])


def with_count(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """*left* with the number of rows of *right* of each key, 0 if there is none."""
    n = right.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return left.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def parents(sections: DataFrame, document: str = "document_id", ordinal: str = "ordinal", path: str = "path") -> DataFrame:
    """*sections* with parent: the nearest earlier section of the document whose path is this one's without
    its last part; null at the top. An as-of lookup by one window: sections and questions for their parents
    are sorted together, so no pairs are formed."""
    up = F.expr(f"if(size({path}) > 1, slice({path}, 1, size({path}) - 1), null)")
    asks = sections.select("*", up.alias("_key"), F.lit(True).alias("_asks"))
    tells = sections.select("*", F.col(path).alias("_key"), F.lit(False).alias("_asks"))
    by = Window.partitionBy(document, "_key").orderBy(ordinal, "_asks").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(~F.col("_asks"), F.col(ordinal)), ignorenulls=True).over(by)
    return asks.union(tells).withColumn("parent", F.when(F.col("_key").isNotNull(), seen)).where("_asks").select(*sections.columns, "parent")


def retrieval_filter(chunks: DataFrame, documents: DataFrame | None = None, collections: DataFrame | None = None, pages: tuple[int, int] | None = None) -> DataFrame:
    """Chunks of the given documents, of the given collections, and that meet the page range (paged formats
    only), all at once. None does not restrict; an empty table lets nothing through."""
    if documents is not None:
        chunks = chunks.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    if collections is not None:
        chunks = chunks.join(collections.select("collection_id").distinct(), "collection_id", "left_semi")
    if pages is not None:
        chunks = chunks.where((F.col("format") == "pdf") & (F.col("page_start") <= pages[1]) & (F.col("page_end") >= pages[0]))
    return chunks


def removal_plan(messages: DataFrame, citations: DataFrame, conversations: DataFrame, document: int) -> DataFrame:
    """What goes with a document: rows (conversation_id, message_id, reason).

    Conversations about the document alone go whole (scoped). Elsewhere each assistant message that refers
    to it goes (answer) with the user message right before it (question), by time and id; conversations
    with nothing left are marked by a row without message (emptied).

    *messages* has conversation_id, message_id, created_at, role; *citations* has message_id, document_id;
    *conversations* has conversation_id, scope (document or null).
    """
    scoped = conversations.where(F.col("scope") == document).select("conversation_id")
    rest = messages.join(scoped, "conversation_id", "left_anti")
    hit = citations.where(F.col("document_id") == document).select("message_id").distinct().withColumn("_hit", F.lit(True))
    m = rest.join(hit, "message_id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)) & (F.col("role") == "assistant"))
    # the question before an answer, looked at from the question: an answer that follows before any other question
    after = Window.partitionBy("conversation_id").orderBy("created_at", "message_id")
    m = m.withColumn("_turn", F.count(F.when(F.col("role") == "user", 1)).over(after))
    of_turn = Window.partitionBy("conversation_id", "_turn")
    m = m.withColumn("_asked", (F.col("role") == "user") & F.max("_hit").over(of_turn))
    gone = m.where("_hit or _asked").select("conversation_id", "message_id", F.expr("if(_hit, 'answer', 'question')").alias("reason"))
    left = m.groupBy("conversation_id").agg(F.count_if(~(F.col("_hit") | F.col("_asked"))).alias("n"), F.max("_hit").alias("hit")).where("n = 0 and hit")
    whole = messages.join(scoped, "conversation_id", "left_semi").select("conversation_id", "message_id", F.lit("scoped").alias("reason"))
    return gone.union(whole).union(left.select("conversation_id", F.lit(None).cast(messages.schema["message_id"].dataType).alias("message_id"), F.lit("emptied").alias("reason")))


def import_decision(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """*incoming* (sha256, path) with decision: duplicate (content known and finished), retry (known but failed),
    updated (path known with other content), else new; later rows of a batch with equal content are duplicates."""
    by_hash = known.select("sha256", F.col("status").alias("_status"))
    by_path = known.select("path").distinct().withColumn("_path", F.lit(True))
    n = F.row_number().over(Window.partitionBy("sha256").orderBy("path"))
    t = incoming.withColumn("_n", n).join(by_hash, "sha256", "left").join(by_path, "path", "left")
    return t.select(*incoming.columns, F.expr("case when _status = 'failed' then 'retry' when _status is not null or _n > 1 then 'duplicate' when _path then 'updated' else 'new' end").alias("decision"))


def retry_action(status: str) -> Column:
    return F.expr(f"case {status} when 'failed' then 'ingest' when 'embedding' then 'embed' else 'none' end")


def snapshot(documents: DataFrame, status: str, chunks: str) -> DataFrame:
    """One row of an index: documents in each state, and chunks pending and embedded."""
    return documents.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col(status).isin(*UNFINISHED)).alias("reading"), F.count_if(F.col(status) == "failed").alias("failed"),
        F.sum(F.when(F.col(status) == "embedding", F.col(chunks)).otherwise(0)).alias("pending_chunks"), F.sum(F.when(F.col(status) == "ready", F.col(chunks)).otherwise(0)).alias("embedded_chunks"))


def removed(tables: dict[str, DataFrame], documents: str, gone: DataFrame, key: str = "document_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, refused): *tables* without the documents in *gone* and whatever refers to them by *key*. A document that is still
    being read (its status is one of UNFINISHED) is refused and stays with all that is its own."""
    asked = tables[documents].join(gone.select(key).distinct(), key, "left_semi")
    busy = F.coalesce(F.col("status").isin(*UNFINISHED), F.lit(False))
    leaving = asked.where(~busy).select(key).distinct()
    return {name: t.join(leaving, key, "left_anti").select(*t.columns) for name, t in tables.items()}, asked.where(busy).select(key)


def replaced_sources(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """*documents* (path, sha256, status and more) with the new content of known paths: the row and its id stay, the status is queued
    again. *incoming* has (path, sha256); of several contents for a path the largest hash counts. Other paths change nothing."""
    new = incoming.groupBy("path").agg(F.max("sha256").alias("_sha256"))
    t = documents.join(new, "path", "left")
    other = F.col("_sha256").isNotNull() & ~F.col("_sha256").eqNullSafe(F.col("sha256"))
    return t.withColumn("status", F.when(other, "queued").otherwise(F.col("status"))).withColumn("sha256", F.when(other, F.col("_sha256")).otherwise(F.col("sha256"))).select(*documents.columns)


def resolved_filter(documents: DataFrame, chunks: DataFrame, ids: DataFrame | None = None, collections: DataFrame | None = None, pages: tuple[int, int] | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(documents, chunks) that a search may see, as tables of ids; None where nothing restricts them. Documents are
    restricted by a list of ids or of collections only, chunks by a page range only."""
    found = None
    if ids is not None or collections is not None:
        found = documents
        if ids is not None:
            found = found.join(ids.select("document_id").distinct(), "document_id", "left_semi")
        if collections is not None:
            found = found.join(collections.select("collection_id").distinct(), "collection_id", "left_semi")
        found = found.select("document_id")
    inside = retrieval_filter(chunks, found, pages=pages).select("chunk_id") if pages is not None else None
    return found, inside


#: Share of an import that is done when embedding begins (fixed value).
EMBED_START = 0.6


def embedding_progress(chunks: DataFrame, batch: int = 32) -> DataFrame:
    """Rows (document_id, batch, fraction): what a document reports after each batch of *batch* chunks. *chunks*: document_id, n."""
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"))
    b = n.select("document_id", "total", F.explode(F.expr(f"sequence(1L, (total + {batch - 1}) div {batch})")).alias("batch"))
    return b.select("document_id", "batch", F.expr(f"round({EMBED_START}D + {1 - EMBED_START}D * least(batch * {batch}, total) / total, 6)").alias("fraction"))
