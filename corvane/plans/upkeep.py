"""Registered queries: vector spaces and relations, removal, sources and messages over their life, section answers with extras, headers
and whole prompts, outcomes of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import labels
from ..operators import citations, conversations as C, library as L, passages, prompts, vectors
from ..session import spread, table

S = SparkSession
_FORMATS = ("pdf", "markdown", "text", "note", "csv", "epub", "docx", "xlsx")


def vec_spaces(spark: S, sf_dir: str) -> DataFrame:
    """Spaces of the embeddings by label and parity; one of them mixes lengths."""
    v = F.expr("if(label % 3 = 0 and vec_id % 2 = 0 and vec_id % 10 = 0, slice(embedding, 1, 8), embedding)")
    return vectors.spaces(table(spark, sf_dir, "embeddings").select(F.expr("concat('m', label % 3)").alias("model"), F.expr("concat('r', vec_id % 2)").alias("revision"), v.alias("v")))


def vec_store_batches(spark: S, sf_dir: str) -> DataFrame:
    """Batches of ten vectors put in place of stored ones, which are zero; every seventh batch holds a broken vector."""
    e = table(spark, sf_dir, "embeddings")
    dims = e.select(F.size("embedding")).head()[0]
    old = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("chunk_id"), F.expr("transform(embedding, x -> cast(0 as float))").alias("v"))
    new = e.select(F.expr("vec_id div 10").alias("batch"), F.col("vec_id").alias("chunk_id"), F.expr("if(vec_id % 70 = 5, transform(embedding, x -> float('nan')), embedding)").alias("v"))
    return vectors.stored(old, new, dims).select("chunk_id", F.expr("exists(v, x -> x <> 0)").alias("fresh"))


def vec_rebuild(spark: S, sf_dir: str) -> DataFrame:
    """Vectors without a relation and relations without a vector are dropped."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    v, r = vectors.rebuilt(e.where("chunk_id % 4 <> 0"), e.where("chunk_id % 5 <> 0"))
    return v.select("chunk_id", F.lit("vector").alias("side")).union(r.select("chunk_id", F.lit("relation").alias("side")))


def vec_relations(spark: S, sf_dir: str) -> DataFrame:
    """Which documents have to be embedded again: every third has another text by now, every fifth is new."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    known = d.where("chunk_id % 5 <> 0").select("chunk_id", F.sha2(F.expr("if(chunk_id % 3 = 0, concat(text, '!'), text)"), 256).alias("content_hash"))
    return vectors.relations(known, d)


def fn_embedding_input(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("section", F.expr("if(doc_id % 3 = 0, null, concat(lang, ' > ', source))"))
    return d.select("doc_id", F.md5(F.expr(vectors.embedding_input("section", "text"))).alias("passage_md5"), F.md5(F.expr(vectors.embedding_input("section", "text", "query"))).alias("query_md5"))


def snk_remove_cascade(spark: S, sf_dir: str) -> DataFrame:
    """Customers of segment BUILDING are removed with their orders, unless one is still being read: what is left, by table."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), "c_mktsegment", F.expr("if(c_custkey % 4 = 0, 'chunking', 'ready')").alias("status"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), "o_orderkey")
    left, refused = L.removed({"documents": c, "chunks": o}, "documents", c.where("c_mktsegment = 'BUILDING'"))
    one = lambda name, t: t.groupBy(F.lit(name).alias("table"), "document_id").agg(F.count(F.lit(1)).alias("n"))
    return one("documents", left["documents"]).union(one("chunks", left["chunks"])).union(one("refused", refused))


def snk_replace_source(spark: S, sf_dir: str) -> DataFrame:
    """New files for the paths of customers: those of orders of more than 300000, by the order's number."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"), F.col("c_mktsegment").alias("sha256"), F.lit("ready").alias("status"))
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.expr("concat('Customer#', lpad(o_custkey, 9, '0'))").alias("path"), F.expr("lpad(o_orderkey, 12, '0')").alias("sha256"))
    return L.replaced_sources(c, o)


def flt_resolved(spark: S, sf_dir: str) -> DataFrame:
    """A filter by documents, collections and pages as what it lets through on either side."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("collection_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.expr("if(o_custkey % 2 = 0, 'pdf', 'text')").alias("format"), F.expr("o_orderkey % 10").alias("page_start"), F.expr("o_orderkey % 10 + 2").alias("page_end"))
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("collection_id"))
    d, k = L.resolved_filter(c, o, collections=n, pages=(4, 6))
    return d.select(F.lit("document").alias("side"), F.col("document_id").alias("id")).union(k.select(F.lit("chunk").alias("side"), "chunk_id"))


def snk_embedding_progress(spark: S, sf_dir: str) -> DataFrame:
    return L.embedding_progress(table(spark, sf_dir, "orders").select(F.expr("o_custkey div 10").alias("document_id")))


def _messages(spark: S, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as messages of their customers, lineitems as their citations of parts."""
    m = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("message_id"), F.col("o_custkey").alias("conversation_id"), F.expr("if(o_orderkey % 2 = 0, 'user', 'assistant')").alias("role"), F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    li = spread(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("chunk_id")), "message_id")
    return m, li.groupBy("message_id", "ordinal").agg(F.min("chunk_id").alias("chunk_id"))


def snk_message_finish(spark: S, sf_dir: str) -> DataFrame:
    """Every third message is answered: its citations are the later lineitems, and odd parts are gone."""
    m, li = _messages(spark, sf_dir)
    m = spread(m, "message_id", like=table(spark, sf_dir, "lineitem"))
    answers = m.where("message_id % 3 = 0").select("message_id", F.expr("concat('answer ', message_id)").alias("text"), F.lit("complete").alias("status"))
    parts = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("chunk_id"))
    m, c = C.finished(m, li.where("ordinal <= 2"), answers, li.where("ordinal > 2"), parts)
    return m.select("message_id", "text", "status").join(c.groupBy("message_id").agg(F.count(F.lit(1)).alias("citations"), F.count("chunk_id").alias("chunks"), F.min("ordinal").alias("first")), "message_id", "left")


def snk_message_reset(spark: S, sf_dir: str) -> DataFrame:
    m, li = _messages(spark, sf_dir)
    m = spread(m, "message_id", like=table(spark, sf_dir, "lineitem"))
    m, c = C.reset(m, li, m.where("message_id % 5 < 2"))
    return m.select("message_id", "role", "text", "status").join(c.groupBy("message_id").agg(F.count(F.lit(1)).alias("citations")), "message_id", "left")


def snk_touch_conversations(spark: S, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("conversation_id"), F.expr("timestamp_ntz'2000-06-15 00:00:00'").alias("updated_at"))
    m, _ = _messages(spark, sf_dir)
    return C.touched(c, m.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))).select("conversation_id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def chat_ask(spark: S, sf_dir: str) -> DataFrame:
    """Follow-up questions, every fourth of them blank, and the answers that then wait with their questions."""
    m = table(spark, sf_dir, "conversations")
    q = m.select("conv_id").distinct().withColumn("question", F.expr("if(conv_id % 4 = 0, '  ', concat('  and ', conv_id, '? '))"))
    return C.pending(C.asked(m, q))


def ret_section_extras(spark: S, sf_dir: str) -> DataFrame:
    """Orders as questions: returned lineitems are passages of the section asked for, all lineitems what the search finds."""
    li = spread(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), "l_returnflag", "l_suppkey", "l_partkey", "l_discount"), "query_id")
    li = li.groupBy("query_id", "rank").agg(
        F.max("l_returnflag").alias("flag"), F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), (F.max("l_discount") * 10).alias("score"))
    sections = li.where("flag = 'R'").select("query_id", F.col("rank").alias("ordinal"), F.expr("array(s % 10, s % 10 + 1)").alias("chunk_ids"))
    found = li.select("query_id", "rank", "score", F.expr("array(p % 10)").alias("chunk_ids"))
    t = passages.with_extras(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id")), sections, found)
    return t.select("query_id", F.col("chunk_ids")[0].alias("chunk"), F.col("rank").cast("int").alias("rank"), "kind")


def _places(spark: S, sf_dir: str) -> DataFrame:
    """Lineitems as passages of orders, in places of all formats."""
    kind = "element_at(array(" + ", ".join(f"'{f}'" for f in _FORMATS) + "), cast(l_partkey % 8 + 1 as int))"
    given = {"kind": kind, "page_start": "l_linenumber", "page_end": "cast(l_linenumber + l_suppkey % 2 as int)", "line_start": "l_linenumber", "start": "0", "stop": "l_linenumber", "row_start": "l_linenumber", "row_end": "l_linenumber + 1",
             "chapter_index": "l_linenumber", "paragraph_start": "l_linenumber", "sheet_name": "l_returnflag"}
    fields = [f.split(":") for f in labels.LOCATION[7:-1].split(", ")]
    place = "named_struct(" + ", ".join(f"'{n.strip()}', cast({given.get(n.strip(), 'null')} as {t.strip()})" for n, t in fields) + ")"
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("l_returnflag"))
    return li.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("n"), F.expr(place).alias("place"), F.expr("if(l_partkey % 3 = 0, null, concat('<', l_returnflag, '> \"s\"'))").alias("section"), F.expr("concat('doc \"', l_partkey, '\"')").alias("document"), F.expr("concat('text <', l_partkey, '>')").alias("content"))


def ctx_headers(spark: S, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("query_id", "n", F.expr(prompts.header("n", "document", "place", "section")).alias("header"))


def ctx_prompt(spark: S, sf_dir: str) -> DataFrame:
    """The whole prompt of each order, as its digest and length."""
    p = _places(spark, sf_dir).withColumn("header", F.expr(prompts.header("n", "document", "place", "section")))
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.expr("concat('what of <', o_orderkey, '>?')").alias("question"))
    return prompts.assembled(p, q).select("query_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("chars"))


def cite_outcomes(spark: S, sf_dir: str) -> DataFrame:
    """Status and warnings of answers, whose facts orders play."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderkey % 11 = 0").alias("cancelled"), F.expr("o_orderkey % 5 = 0").alias("nothing"), F.expr("o_custkey % 3").alias("cited"), F.expr("if(o_custkey % 4 = 0, array(7L, o_custkey), array())").alias("invalid"),
                                              F.expr("o_orderkey % 7 = 0").alias("dropped"), F.expr("o_orderkey % 2 = 0").alias("cut"), F.expr("o_custkey % 5 = 1").alias("lost"))
    t = t.withColumn("status", F.expr(citations.answer_status("cancelled", "nothing", "1")))
    t = t.withColumn("w", F.expr(citations.answer_warnings("dropped", "cut and dropped", "invalid", "cut", "lost", "status", "(cited > 0)")))
    return t.select("o_orderkey", "status", F.array_join("w", "; ").alias("warnings"))


def cite_stored_sources(spark: S, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("n"), "l_partkey")
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), F.explode(F.expr("array(cast(o_custkey % 7 + 1 as int), cast(o_custkey % 3 + 1 as int))")).alias("n"))
    return citations.stored_sources(s, c).groupBy("answer_id").agg(F.count(F.lit(1)).alias("sources"), F.count_if("cited").alias("cited"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k.split("_")[0] in ("vec", "fn", "snk", "flt", "chat", "ret", "ctx", "cite") and getattr(f, "__module__", "") == __name__}

_PLACES = r"""p as (select l_orderkey q, l_linenumber n, min(l_partkey) k, min(l_suppkey) s, min(l_returnflag) f from lineitem group by 1, 2),
h as (select q, n, k, '<passage n="' || n || '" document="doc ''' || k || '''"' || case k % 8
    when 0 then ' where="' || case when s % 2 = 1 then 'pages ' || n || '-' || n + 1 else 'page ' || n end || '"' || case when k % 3 = 0 then '' else ' section="‹' || f || '› ''s''"' end
    else ' type="' || ['pdf', 'markdown', 'text', 'note', 'csv', 'epub', 'docx', 'xlsx'][k % 8 + 1] || '" where="' || case k % 8 when 1 then 'line ' || n when 2 then 'characters 0–' || n when 3 then 'note, characters 0–' || n
        when 4 then 'rows ' || n || '–' || n + 1 when 5 then 'chapter ' || n when 6 then 'paragraph ' || n else f || ', rows ' || n || '–' || n + 1 end || '"' end || '>' header from p)"""
ORACLE_SQL = {
    "vec_spaces": """
with t as (select 'm' || label % 3 model, 'r' || vec_id % 2 revision, case when label % 3 = 0 and vec_id % 10 = 0 then 8 else len(embedding) end n from embeddings)
select model, revision, case when min(n) = max(n) then min(n)::int end as dims, count(*) as vectors, min(n) = max(n) as consistent from t group by 1, 2""",
    "vec_store_batches": """
with bad as (select distinct vec_id // 10 b from embeddings where vec_id % 70 = 5)
select vec_id as chunk_id, vec_id // 10 not in (select b from bad) as fresh from embeddings where vec_id % 3 = 0 or vec_id // 10 not in (select b from bad)""",
    "vec_rebuild": "select vec_id as chunk_id, unnest(['vector', 'relation']) as side from embeddings where vec_id % 4 <> 0 and vec_id % 5 <> 0",
    "vec_relations": "select doc_id as chunk_id, sha256(text) as content_hash, doc_id % 5 = 0 or doc_id % 3 = 0 as stale from documents",
    "fn_embedding_input": "select doc_id, md5('passage: ' || case when doc_id % 3 = 0 then text else lang || ' > ' || source || chr(10) || text end) as passage_md5, md5('query: ' || text) as query_md5 from documents",
    "snk_remove_cascade": """
with gone as (select c_custkey k from customer where c_mktsegment = 'BUILDING' and c_custkey % 4 <> 0)
select 'documents' as "table", c_custkey as document_id, count(*) as n from customer where c_custkey not in (select k from gone) group by 2
union all select 'chunks', o_custkey, count(*) from orders where o_custkey not in (select k from gone) group by 2
union all select 'refused', c_custkey, 1 from customer where c_mktsegment = 'BUILDING' and c_custkey % 4 = 0""",
    "snk_replace_source": """
with o as (select o_custkey k, max(lpad(o_orderkey::varchar, 12, '0')) h from orders where o_totalprice > 300000 group by 1)
select c_custkey as id, c_name as path, coalesce(h, c_mktsegment) as sha256, case when h is null then 'ready' else 'queued' end as status from customer left join o on k = c_custkey""",
    "flt_resolved": """
with d as (select c_custkey k from customer join nation on n_nationkey = c_nationkey where n_regionkey = 1)
select 'document' as side, k as id from d
union all select 'chunk', o_orderkey from orders where o_custkey in (select k from d) and o_custkey % 2 = 0 and o_orderkey % 10 <= 6 and o_orderkey % 10 + 2 >= 4""",
    "snk_embedding_progress": """
with n as (select o_custkey // 10 d, count(*) n from orders group by 1), b as (select d, n, unnest(range(1, (n + 31) // 32 + 1)) b from n)
select d as document_id, b as batch, round(0.6::double + 0.4::double * least(b * 32, n) / n, 6) as fraction from b""",
    "snk_message_finish": """
with li as (select l_orderkey m, l_linenumber n, min(l_partkey) p from lineitem group by 1, 2), a as (select o_orderkey m from orders where o_orderkey % 3 = 0),
c as (select m, n, p from li where n <= 2 and m not in (select m from a) union all select m, n, case when p in (select p_partkey from part where p_partkey % 2 = 0) then p end from li where n > 2 and m in (select m from a)),
g as (select m, count(*) citations, count(p) chunks, min(n) f from c group by 1)
select o_orderkey as message_id, case when o_orderkey % 3 = 0 then 'answer ' || o_orderkey else o_orderpriority end as text, case when o_orderkey % 3 = 0 then 'complete' else o_orderstatus end as status, citations, chunks, f as first
from orders left join g on m = o_orderkey""",
    "snk_message_reset": """
with li as (select l_orderkey m, count(distinct l_linenumber) n from lineitem group by 1), o as (select *, o_orderkey % 5 < 2 and o_orderkey % 2 = 1 again from orders)
select o_orderkey as message_id, case when o_orderkey % 2 = 0 then 'user' else 'assistant' end as role, case when again then '' else o_orderpriority end as text, case when again then 'streaming' else o_orderstatus end as status,
       case when not again then n end as citations from o left join li on m = o_orderkey""",
    "snk_touch_conversations": """
select c_custkey as conversation_id, strftime(greatest(timestamp '2000-06-15', max(o_orderdate)), '%Y-%m-%d') as updated from customer left join orders on o_custkey = c_custkey group by c_custkey""",
    "chat_ask": "select conv_id, max(turn) + 2 as turn, 'and ' || conv_id || '?' as question from conversations where conv_id % 4 <> 0 group by conv_id",
    "ret_section_extras": """
with li as (select l_orderkey q, l_linenumber n, max(l_returnflag) f, min(l_suppkey) s, min(l_partkey) p, max(l_discount) * 10 score from lineitem where l_orderkey in (select o_orderkey from orders) group by 1, 2),
sec as (select q, n, s % 10 a from li where f = 'R'),
ex as (select q, p % 10 c, row_number() over (partition by q order by n) r from li where score >= 0.28 and q in (select q from sec) and not exists (select 1 from sec where sec.q = li.q and (li.p % 10 = a or li.p % 10 = a + 1)))
select q as query_id, a as chunk, (row_number() over (partition by q order by n))::int as rank, 'section' as kind from sec
union all select q, c, r::int, 'extra' from ex where r <= 3
union all select q, p % 10, n, 'search' from li where q not in (select q from sec)""",
    "ctx_headers": f"with {_PLACES} select q as query_id, n, header from h",
    "ctx_prompt": f"""
with {_PLACES},
b as (select q, string_agg(header || chr(10) || 'text ‹' || k || '›' || chr(10) || '</passage>' || chr(10), '' order by n) t from h group by q),
r as (select o_orderkey, '{prompts.SYSTEM}' || chr(10) || chr(10) || coalesce(t, '') || chr(10) || 'Question: what of ‹' || o_orderkey || '›?' t from orders left join b on q = o_orderkey)
select o_orderkey as query_id, md5(t) as prompt_md5, length(t) as chars from r""",
    "cite_outcomes": """
with t as (select o_orderkey, o_orderkey % 7 = 0 dropped, o_orderkey % 2 = 0 cut, o_custkey, case when o_orderkey % 11 = 0 then 'cancelled' when o_orderkey % 5 = 0 then 'not_found' else 'answered' end status from orders)
select o_orderkey, status, array_to_string(list_filter([case when dropped then 'some passages did not fit' end, case when dropped and cut then 'long passages were shortened' end,
    case when o_custkey % 4 = 0 then 'citations of no passage removed: [7], [' || o_custkey || ']' end, case when cut then 'the answer was cut at the limit' end, case when o_custkey % 5 = 1 then 'page references of no document' end,
    case when status = 'answered' and o_custkey % 3 = 0 then 'the answer cites no passage' end], lambda w: w is not null), '; ') as warnings from t""",
    "cite_stored_sources": """
select l_orderkey as answer_id, count(*) as sources, count(*) filter (l_linenumber = o_custkey % 7 + 1 or l_linenumber = o_custkey % 3 + 1) as cited
from lineitem left join orders on o_orderkey = l_orderkey group by 1""",
}
