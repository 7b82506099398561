"""Registered queries: scans, filters, joins, aggregates, windows, sets and mutations of the document library.

The star schema plays the library's tables: customers are documents, orders their jobs and chunks, lineitems
citations, nations and regions sections; conversations are conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import conversations as C, library as L
from ..session import spread, table
from .relational_sql import ORACLE_SQL  # noqa: F401

S = SparkSession


def scan_ordered(spark: S, sf_dir: str) -> DataFrame:
    """The document list: latest import first, then id."""
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(by).alias("position"))


def scan_point_lookup(spark: S, sf_dir: str) -> DataFrame:
    """One document by id, with a default for a missing field."""
    return table(spark, sf_dir, "customer").where("c_custkey = 7").select("c_custkey", "c_name", F.coalesce(F.expr("nullif(c_mktsegment, 'NONE')"), F.lit("text/plain")).alias("media_type"))


def scan_chunk_view(spark: S, sf_dir: str) -> DataFrame:
    """Chunk, document (inner), provenance and section (left): titles fall back to names."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    big = o.where("o_totalprice > 150000").select("o_orderkey", F.col("o_orderpriority").alias("section"))
    t = o.join(c, o.o_custkey == c.c_custkey).join(big, "o_orderkey", "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return t.select("o_orderkey", "c_custkey", F.coalesce("section", "n_name").alias("title"), F.col("section").isNotNull().alias("has_section"))


def flt_documents_collections_pages(spark: S, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    chunks = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.col("c_mktsegment").alias("collection_id"),
        F.expr("if(o_orderstatus = 'O', 'pdf', 'text')").alias("format"), F.expr("cast(o_orderkey % 40 + 1 as int)").alias("page_start"), F.expr("cast(o_orderkey % 40 + 1 + o_orderkey % 3 as int)").alias("page_end"))
    docs = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"))
    segments = c.where("c_mktsegment < 'C'").select(F.col("c_mktsegment").alias("collection_id"))
    return L.retrieval_filter(chunks, docs, segments, (5, 20)).select("chunk_id", "document_id", "collection_id", "page_start", "page_end")


def flt_empty_list(spark: S, sf_dir: str) -> DataFrame:
    """An empty list of documents lets nothing through; no list lets everything through."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))
    none = L.retrieval_filter(c, c.where("document_id < 0"))
    return none.agg(F.count(F.lit(1)).alias("with_empty")).join(L.retrieval_filter(c).agg(F.count(F.lit(1)).alias("without")))


def flt_unfinished(spark: S, sf_dir: str) -> DataFrame:
    status = "element_at(array('queued', 'extracting', 'structuring', 'chunking', 'ready', 'failed', 'embedding'), cast(o_orderkey % 7 + 1 as int))"
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(status).alias("status"))
    return t.where(F.col("status").isin(*L.UNFINISHED))


def flt_stale_vectors(spark: S, sf_dir: str) -> DataFrame:
    """Vectors of another content than the chunk's, and chunks without a vector."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("md5(o_orderpriority)").alias("content_hash"))
    v = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select("o_orderkey", F.expr("md5(if(o_orderkey % 3 = 0, 'old', o_orderpriority))").alias("embedded_hash"))
    return o.join(v, "o_orderkey", "left").where("embedded_hash is null or embedded_hash <> content_hash").select("o_orderkey", F.expr("if(embedded_hash is null, 'missing', 'stale')").alias("state"))


def flt_needs_ocr(spark: S, sf_dir: str) -> DataFrame:
    """Documents none of whose pages has text."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.expr("l_returnflag = 'R'")).alias("has_text")).where("not has_text").select("l_orderkey")


def join_latest_job(spark: S, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return L.with_latest(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", F.col("o_orderkey"), ["o_orderkey", "o_orderstatus"])


def join_citing_conversations(spark: S, sf_dir: str) -> DataFrame:
    """How many conversations cite a document, cited sources only."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.where("l_returnflag = 'R'").join(o, li.l_orderkey == o.o_orderkey).groupBy("l_partkey").agg(F.count_distinct("o_custkey").alias("conversations"))


def join_semi_either(spark: S, sf_dir: str) -> DataFrame:
    """Messages with a citation or a page reference: a union of keys, then one semi-join."""
    li = table(spark, sf_dir, "lineitem")
    keys = li.where("l_quantity > 49").select("l_orderkey").union(li.where("l_discount = 0.1").select("l_orderkey")).distinct()
    o = table(spark, sf_dir, "orders")
    return o.join(keys, o.o_orderkey == keys.l_orderkey, "left_semi").select("o_orderkey")


def join_anti_scoped(spark: S, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o.where("o_orderpriority = '1-URGENT'"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def join_question_before_answer(spark: S, sf_dir: str) -> DataFrame:
    """As-of backward: the user message right before each answer."""
    p = C.pairs(table(spark, sf_dir, "conversations"))
    return p.select("conv_id", "question_turn", "answer_turn", F.length("question").cast("long").alias("question_chars"))


def join_collection_semi(spark: S, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    inside = n.join(r.where("r_name in ('EUROPE', 'ASIA')"), n.n_regionkey == r.r_regionkey, "left_semi")
    return c.join(inside, c.c_nationkey == inside.n_nationkey, "left_semi").select("c_custkey", "c_nationkey")


def join_composite_key(spark: S, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a = li.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")
    b = li.where("l_discount > 0.05").select("l_orderkey", "l_linenumber", "l_tax")
    return a.join(b, ["l_orderkey", "l_linenumber"])


def join_left_scope(spark: S, sf_dir: str) -> DataFrame:
    """Every conversation with its scope, if it has one."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("conv_id"), F.lit(True).alias("_s"))
    return t.join(d, "conv_id", "left").select("conv_id", "messages", F.expr("if(_s, conv_id, null)").alias("scope"))


def join_point_in_range(spark: S, sf_dir: str) -> DataFrame:
    """Page references resolved to the first source (by number) of the order whose page interval holds them.

    Sources are filed under every tenth of pages that they touch, so that the interval join is an equi-join.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("cast(l_quantity as int)").alias("lo"), F.expr("cast(l_quantity + l_linenumber * 3 as int)").alias("hi"))
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("cast(o_orderkey % 60 as int)").alias("page")).withColumn("bin", F.expr("page div 10"))
    filed = li.withColumn("bin", F.explode(F.expr("sequence(lo div 10, hi div 10)")))
    hit = refs.join(filed, ["l_orderkey", "bin"]).where("page between lo and hi").groupBy("l_orderkey", "page").agg(F.min("l_linenumber").alias("source"))
    return hit.withColumnRenamed("l_orderkey", "o_orderkey")


def join_section_parent(spark: S, sf_dir: str) -> DataFrame:
    """Parents by path: sections are lineitems, with paths of two or three parts."""
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ordinal"),
        F.expr("if(l_linenumber % 3 = 1, array(l_returnflag), if(l_linenumber % 3 = 2, array(l_returnflag, l_linestatus), array(l_returnflag, l_linestatus, 'x')))").alias("path"))
    return L.parents(t).select("document_id", "ordinal", "parent")


def join_requested_order(spark: S, sf_dir: str) -> DataFrame:
    """Chunks by a list of ids, in the order asked."""
    ids = spark.range(1).select(F.posexplode(F.expr("array(33L, 5L, 7L, 5L, 999999999L)")).alias("position", "o_orderkey"))
    return table(spark, sf_dir, "orders").join(ids, "o_orderkey").select("position", "o_orderkey", "o_orderstatus")


def join_full_outer(spark: S, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a = li.where("l_shipdate < timestamp_ntz'1995-01-01 00:00:00'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("early"))
    b = li.where("l_shipdate >= timestamp_ntz'1997-01-01 00:00:00'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("late"))
    return a.join(b, "l_partkey", "full_outer").select("l_partkey", F.coalesce("early", F.lit(0).cast("long")).alias("early"), F.coalesce("late", F.lit(0).cast("long")).alias("late"))


def agg_chunks_per_document(spark: S, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return L.with_count(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "chunks")


def agg_vectors_per_space(spark: S, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct(F.size("embedding")).alias("dimensions"))


def agg_messages(spark: S, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.expr("role = 'assistant'")).alias("answers"))


def agg_sheets(spark: S, sf_dir: str) -> DataFrame:
    """Sheets count for workbooks only."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.expr("l_linestatus = 'O'")).alias("sheets"), F.max("l_quantity").alias("largest"))


def agg_snapshot(spark: S, sf_dir: str) -> DataFrame:
    status = "element_at(array('queued', 'extracting', 'ready', 'failed', 'embedding'), cast(o_orderkey % 5 + 1 as int))"
    t = table(spark, sf_dir, "orders").select(F.expr(status).alias("status"), F.expr("o_orderkey % 11").alias("chunks"))
    return L.snapshot(t, "status", "chunks")


def agg_rollup_status(spark: S, sf_dir: str) -> DataFrame:
    """Documents by status and priority with subtotals."""
    t = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("documents"), F.grouping_id().cast("long").alias("level"))
    return t


def agg_exact_duplicates(spark: S, sf_dir: str) -> DataFrame:
    """One row per content: the document kept and how many others say the same."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return t.groupBy("content_hash").agg(F.min("doc_id").alias("kept"), (F.count(F.lit(1)) - 1).alias("others"))


def agg_document_groups(spark: S, sf_dir: str) -> DataFrame:
    """Passages of each document in page order with the best score."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"), F.expr("array_join(transform(array_sort(collect_list(struct(cast(l_quantity as int) as page, l_linenumber))), x -> concat(x.page, ':', x.l_linenumber)), ',')").alias("passages"))
    return t


def agg_cited_pages(spark: S, sf_dir: str) -> DataFrame:
    """Distinct pages that the cited intervals of each document cover."""
    t = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_partkey", F.explode(F.expr("sequence(cast(l_quantity as int), cast(l_quantity as int) + l_linenumber)")).alias("page"))
    return t.groupBy("l_partkey").agg(F.expr("array_join(sort_array(collect_set(page)), ',')").alias("pages"))


def agg_body_style(spark: S, sf_dir: str) -> DataFrame:
    """The style with most characters in each group: ties to the smaller size, then not bold."""
    t = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("size"), F.expr("p_type like '%STEEL%'").alias("bold"), F.length("p_name").alias("n"))
    s = t.groupBy("p_brand", "size", "bold").agg(F.sum("n").alias("chars"))
    return s.groupBy("p_brand").agg(F.max_by(F.struct("size", "bold", "chars"), F.struct("chars", -F.col("size"), ~F.col("bold"))).alias("b")).select("p_brand", "b.size", "b.bold", "b.chars")


def agg_repeated_margins(spark: S, sf_dir: str) -> DataFrame:
    """Lines that stand on at least max(3, half) of a document's pages: first lines of documents, by source."""
    from ..functions import text as T

    t = table(spark, sf_dir, "documents").select("source", "doc_id", F.expr(T.margin_key("split(text, '\n')[0]")).alias("line"))
    pages = t.groupBy("source").agg(F.count_distinct("doc_id").alias("pages"))
    n = t.groupBy("source", "line").agg(F.count_distinct("doc_id").alias("n"))
    return n.join(pages, "source").where("n >= greatest(3, ceil(pages / 20D))").select("source", F.md5("line").alias("line_md5"), "n")


def agg_distinct_documents(spark: S, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey").distinct()


def win_first_of_runs(spark: S, sf_dir: str) -> DataFrame:
    """The first document of each run of equal language, by source."""
    t = table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    return C.first_of_runs(t, "source", "doc_id", "lang").select("source", "doc_id", "lang", F.col("run").cast("int").alias("run"))


def win_section_runs(spark: S, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey")
    g = C.groups_of(t, "l_orderkey", "l_linenumber", "l_returnflag")
    return g.groupBy("l_orderkey", "l_returnflag", "island", "part").agg(F.min("l_linenumber").alias("first_chunk"), F.count(F.lit(1)).alias("chunks")).select("l_orderkey", "l_returnflag", "first_chunk", "chunks")


def win_latest_per_path(spark: S, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


def win_recent(spark: S, sf_dir: str) -> DataFrame:
    """The five latest finished jobs of each status."""
    by = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.row_number().over(by).alias("n")).where("n <= 5")


def win_history(spark: S, sf_dir: str) -> DataFrame:
    return C.history(table(spark, sf_dir, "conversations")).select("conv_id", "question_turn", "answer_turn", "position")


def win_last_cited(spark: S, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 4").alias("conv_id"), (F.col("l_orderkey") % 4).alias("turn"), F.col("l_linenumber").alias("ordinal"), F.expr("l_suppkey % 2").alias("document"))
    return C.last_cited(t)


def win_heading_levels(spark: S, sf_dir: str) -> DataFrame:
    """Levels by the rank of distinct sizes, at most six, largest first."""
    by = Window.partitionBy("p_brand").orderBy(F.desc("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.least(F.dense_rank().over(by), F.lit(6)).alias("level"))


def win_per_document_cap(spark: S, sf_dir: str) -> DataFrame:
    """At most four passages of a document, then the six best of each question (ship mode of the year)."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(F.expr("l_suppkey").alias("query_id"), "o_custkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "o_custkey").orderBy(*order))).where("n <= 4")
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("rank <= 6").select("query_id", "l_orderkey", "l_linenumber", "rank")


def set_prune_orphans(spark: S, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return L.orphans(s, table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("k")).distinct(), "k")


def set_union_intersect(spark: S, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    names = (("union", c.union(s).distinct()), ("intersect", c.intersect(s)), ("except", c.exceptAll(s).distinct()))
    out = None
    for name, t in names:
        one = t.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")).select(F.lit(name).alias("operation"), "n", "total")
        out = one if out is None else out.union(one)
    return out


def set_adjacent_distinct(spark: S, sf_dir: str) -> DataFrame:
    """Repeats side by side count once."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.expr("length(text) % 2").alias("odd")))).alias("a"))
    return t.select("conv_id", F.expr("array_join(transform(filter(a, (x, i) -> i = 0 or get(a, i - 1).odd <> x.odd), x -> x.odd), '')").alias("flags"))


def snk_insert_absent(spark: S, sf_dir: str) -> DataFrame:
    """Imports by content: what is known, or repeats within the batch, is not imported again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return L.insert_absent(d.where("doc_id % 4 = 0"), d.where("doc_id % 4 <> 0"), "sha256", ["doc_id"]).select("doc_id")


def snk_upsert(spark: S, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit("CHANGED").alias("c_mktsegment"))
    return L.upsert(c, new, ["c_custkey"])


def snk_delete(spark: S, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return L.delete(o, gone, ["o_custkey"])


def snk_move_paths(spark: S, sf_dir: str) -> DataFrame:
    return L.moved(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "http://", "archive://").select("page_id", "url")


def snk_job_progress(spark: S, sf_dir: str) -> DataFrame:
    """Attempts and the last state of each job, from status events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(
        F.count_if(F.expr("event_type = 'click'")).alias("attempts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"),
        F.expr("unix_micros(cast(max(ts) as timestamp)) - unix_micros(cast(min(ts) as timestamp))").alias("microseconds"))


def snk_null_missing_chunks(spark: S, sf_dir: str) -> DataFrame:
    """Citations keep their answer when a chunk is gone: its id becomes null."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    left = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("chunk_id"))
    return li.join(left, li.l_orderkey == left.chunk_id, "left").select("l_orderkey", "l_linenumber", "chunk_id")


def ret_import_decision(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.concat(F.lit("/d/"), F.expr("doc_id % 700")).alias("path"))
    known = d.where("doc_id % 3 = 0").groupBy("sha256").agg(F.min("doc_id").alias("k"), F.min("path").alias("path")).select("sha256", "path", F.expr("if(k % 2 = 0, 'ready', 'failed')").alias("status"))
    incoming = d.where("doc_id % 3 <> 0").groupBy("path").agg(F.min_by("sha256", "doc_id").alias("sha256")).select("sha256", "path")
    return L.import_decision(incoming, known).select("path", "decision")


def ret_retry_action(spark: S, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(F.expr("element_at(array('failed', 'embedding', 'ready'), cast(o_orderkey % 3 + 1 as int))").alias("status"))
    return t.select("status", L.retry_action("status").alias("action")).groupBy("status", "action").agg(F.count(F.lit(1)).alias("n"))


def chat_removal_plan(spark: S, sf_dir: str) -> DataFrame:
    """Removing document 1: conversations 0, 10, 20, ... are about it; every assistant turn of an even conversation
    whose length is a multiple of three refers to it."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.expr("conv_id * 100 + turn").alias("message_id"), F.col("turn").alias("created_at"), "role", "text")
    cites = t.where("role = 'assistant' and conversation_id % 2 = 0 and length(text) % 3 = 0").select("message_id", F.lit(1).alias("document_id"))
    scopes = t.select("conversation_id").distinct().withColumn("scope", F.expr("if(conversation_id % 10 = 0, 1, null)"))
    return L.removal_plan(t.drop("text"), cites, scopes, 1)


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k.split("_")[0] in ("scan", "flt", "join", "agg", "win", "set", "snk", "ret", "chat")}
