"""Registered queries: labels, prompts of conversations, outcomes, source details, text found on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import labels
from ..operators import answers as A
from ..session import table

S = SparkSession
_FIELDS = [f.split(":")[0].strip() for f in labels.LOCATION[7:-1].replace("array<string>", "a").split(", ")]
_PLACES = (
    ({"kind": "pdf", "page_start": 3, "page_end": 3}, "page 3"), ({"kind": "pdf", "page_start": 3, "page_end": 5}, "pages 3–5"), ({"kind": "markdown", "heading_path": ["A", "B"], "line_start": 1}, "A > B"),
    ({"kind": "markdown", "heading_path": [], "line_start": 4, "line_end": 9}, "lines 4–9"), ({"kind": "text", "start": 0, "stop": 10}, "characters 0–10"), ({"kind": "note", "start": 5, "stop": 9}, "note, characters 5–9"),
    ({"kind": "csv", "row_start": 2, "row_end": 2}, "row 2"), ({"kind": "epub", "chapter_index": 3, "section": "S"}, "chapter 3 > S"), ({"kind": "epub", "chapter_index": 1, "chapter_title": "T"}, "T"),
    ({"kind": "docx", "heading_path": ["H"], "table_number": 2}, "H, table 2"), ({"kind": "docx", "heading_path": [], "paragraph_start": 1, "paragraph_end": 4}, "paragraphs 1–4"), ({"kind": "xlsx", "sheet_name": "S", "row_start": 1, "row_end": 8}, "S, rows 1–8"))


def fn_location_label(spark: S, sf_dir: str) -> DataFrame:
    rows = [(k, tuple(p.get(f) for f in _FIELDS)) for k, (p, _) in enumerate(_PLACES)]
    t = spark.createDataFrame(rows, f"n long, x {labels.LOCATION}")
    return t.select("n", F.expr(labels.source_label("'doc'", "x")).alias("label"))


def chat_rewrite_prompt(spark: S, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations")
    q = m.select("conv_id").distinct().withColumn("question", F.expr("concat('and ', conv_id, '?')"))
    return A.rewrite_prompts(m, q).select("conv_id", F.md5("prompt").alias("prompt_md5"))


def chat_free_prompt(spark: S, sf_dir: str) -> DataFrame:
    return A.free_prompts(table(spark, sf_dir, "conversations"), 600)


def ret_source_details(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.expr("concat('doc', doc_id)").alias("name"), F.expr("if(doc_id % 3 = 0, null, text)").alias("title"), F.expr("if(doc_id % 5 = 0, 'xlsx', 'pdf')").alias("format"))
    o = table(spark, sf_dir, "orders")
    chunks = o.select(F.expr("o_orderkey % 200").alias("document_id"))
    cited = o.select(F.expr("o_orderkey % 150").alias("document_id"), F.col("o_custkey").alias("conversation_id"))
    sheets = table(spark, sf_dir, "part").select(F.expr("p_partkey % 90").alias("document_id"))
    return A.source_details(d, chunks, cited, sheets)


def agg_import_summary(spark: S, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(F.expr("element_at(array('new', 'updated', 'retry', 'duplicate', 'failed'), cast(o_orderkey % 5 + 1 as int))").alias("decision"))
    return A.import_summary(t)


def snk_message_status(spark: S, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(F.expr("element_at(array('answered', 'not_found', 'cancelled', 'refused'), cast(o_orderkey % 4 + 1 as int))").alias("outcome"))
    return t.select("outcome", F.expr(A.message_status("outcome")).alias("status")).groupBy("outcome", "status").agg(F.count(F.lit(1)).alias("n"))


def find_text(spark: S, sf_dir: str) -> DataFrame:
    """Where documents say a word, without regard to case and accents."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")
    return A.found(d, "the and")


QUERIES = {f.__name__: f for f in (fn_location_label, chat_rewrite_prompt, chat_free_prompt, ret_source_details, agg_import_summary, snk_message_status, find_text)}

ORACLE_SQL = {
    "fn_location_label": "select n::bigint as n, 'doc · ' || l as label from (values " + ", ".join(f"({k}, '{label}')" for k, (_, label) in enumerate(_PLACES)) + ") v(n, l)",
    "chat_rewrite_prompt": r"""
with t as (select *, lag(role) over w p_role, lag(text) over w p_text from conversations window w as (partition by conv_id order by turn, role, text)),
p as (select conv_id, turn, p_text q, text a, row_number() over (partition by conv_id order by turn desc) b from t where role = 'assistant' and p_role = 'user'),
n as (select conv_id, turn, left(regexp_replace(translate(q, '<>', '‹›'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), 300) q, left(regexp_replace(translate(a, '<>', '‹›'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), 300) a from p where b <= 3),
h as (select conv_id, string_agg('User: ' || q || chr(10) || 'Assistant: ' || a || chr(10), '' order by turn) turns from n group by conv_id)
select conv_id, md5(coalesce(turns, '') || 'Follow-up: and ' || conv_id || '?') as prompt_md5 from (select distinct conv_id from conversations) left join h using (conv_id)""",
    "chat_free_prompt": """
with t as (select conv_id, turn, role, case when length(text) > 1500 then left(text, 1500) || '…' else text end x from conversations),
u as (select *, ceil(length(x) / 3::double)::bigint tokens from t),
s as (select *, sum(tokens) over w used, row_number() over w back from u window w as (partition by conv_id order by turn desc, role desc rows unbounded preceding))
select conv_id, count(*) as turns, sum(tokens)::bigint as tokens from s where used <= 600 or back = 1 group by conv_id""",
    "ret_source_details": """
with c as (select o_orderkey % 200 d, count(*) n from orders group by 1), v as (select o_orderkey % 150 d, count(distinct o_custkey) n from orders group by 1), s as (select p_partkey % 90 d, count(*) n from part group by 1)
select doc_id as document_id, case when doc_id % 3 = 0 then 'doc' || doc_id else coalesce(text, 'doc' || doc_id) end as title, coalesce(c.n, 0) as chunks, coalesce(v.n, 0) as conversations,
       case when doc_id % 5 = 0 then coalesce(s.n, 0) end as sheets
from documents left join c on c.d = doc_id left join v on v.d = doc_id left join s on s.d = doc_id""",
    "agg_import_summary": "select count(*) filter (o_orderkey % 5 < 3) as imported, count(*) filter (o_orderkey % 5 = 3) as duplicate, count(*) filter (o_orderkey % 5 = 4) as failed from orders",
    "snk_message_status": """
with t as (select ['answered', 'not_found', 'cancelled', 'refused'][o_orderkey % 4 + 1] o from orders)
select o as outcome, case when o in ('answered', 'not_found') then 'complete' when o = 'cancelled' then 'cancelled' else 'failed' end as status, count(*) as n from t group by o""",
}
