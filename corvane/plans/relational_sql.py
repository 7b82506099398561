"""SQL equivalents of the queries in :mod:`relational`."""

from __future__ import annotations

ORACLE_SQL = {
    "scan_ordered": "select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc)::int as position from orders",
    "scan_point_lookup": "select c_custkey, c_name, coalesce(nullif(c_mktsegment, 'NONE'), 'text/plain') as media_type from customer where c_custkey = 7",
    "scan_chunk_view": """
select o.o_orderkey, c_custkey, coalesce(section, n_name) as title, section is not null as has_section
from orders o join customer c on o_custkey = c_custkey
left join (select o_orderkey, o_orderpriority section from orders where o_totalprice > 150000) b on o.o_orderkey = b.o_orderkey
left join nation on c_nationkey = n_nationkey""",
    "flt_documents_collections_pages": """
select o_orderkey as chunk_id, o_custkey as document_id, c_mktsegment as collection_id, (o_orderkey % 40 + 1)::int as page_start, (o_orderkey % 40 + 1 + o_orderkey % 3)::int as page_end
from orders join customer on o_custkey = c_custkey
where c_acctbal > 0 and c_mktsegment in (select c_mktsegment from customer where c_mktsegment < 'C')
  and o_orderstatus = 'O' and o_orderkey % 40 + 1 <= 20 and o_orderkey % 40 + 1 + o_orderkey % 3 >= 5""",
    "flt_empty_list": "select 0::bigint as with_empty, count(*) as without from customer",
    "flt_unfinished": """
with t as (select o_orderkey, ['queued', 'extracting', 'structuring', 'chunking', 'ready', 'failed', 'embedding'][o_orderkey % 7 + 1] status from orders)
select * from t where status in ('queued', 'extracting', 'structuring', 'chunking')""",
    "flt_stale_vectors": """
select o_orderkey, case when o_orderkey % 5 = 0 then 'missing' else 'stale' end as state from orders
where o_orderkey % 5 = 0 or (o_orderkey % 3 = 0 and o_orderpriority <> 'old')""",
    "flt_needs_ocr": "select l_orderkey from lineitem group by l_orderkey having not bool_or(l_returnflag = 'R')",
    "join_latest_job": """
select c_custkey, o_orderkey, o_orderstatus from customer left join (
  select * from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1) on o_custkey = c_custkey""",
    "join_citing_conversations": "select l_partkey, count(distinct o_custkey) as conversations from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R' group by l_partkey",
    "join_semi_either": "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and (l_quantity > 49 or l_discount = 0.1::double))",
    "join_anti_scoped": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')",
    "join_question_before_answer": """
with t as (select *, lag(role) over w p_role, lag(turn) over w p_turn, lag(text) over w p_text from conversations window w as (partition by conv_id order by turn, role, text))
select conv_id, p_turn as question_turn, turn as answer_turn, length(p_text)::bigint as question_chars from t where role = 'assistant' and p_role = 'user'""",
    "join_collection_semi": "select c_custkey, c_nationkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey in (select r_regionkey from region where r_name in ('EUROPE', 'ASIA')))",
    "join_composite_key": """
select l_orderkey, l_linenumber, a.l_quantity, b.l_tax from (select * from lineitem where l_returnflag = 'R') a
join (select * from lineitem where l_discount > 0.05::double) b using (l_orderkey, l_linenumber)""",
    "join_left_scope": """
select conv_id, messages, case when s then conv_id end as scope
from (select conv_id, count(*) messages from conversations group by conv_id) left join (select doc_id, true s from documents where lang = 'en') on doc_id = conv_id""",
    "join_point_in_range": """
select o_orderkey, (o_orderkey % 60)::int as page, min(l_linenumber) as source from orders join lineitem on l_orderkey = o_orderkey
where o_orderkey % 60 between floor(l_quantity)::int and floor(l_quantity + l_linenumber * 3)::int group by all""",
    "join_section_parent": """
with t as (
  select l_orderkey d, l_linenumber o, case l_linenumber % 3 when 1 then [l_returnflag] when 2 then [l_returnflag, l_linestatus] else [l_returnflag, l_linestatus, 'x'] end p, row_number() over () i
  from lineitem)
select t.d as document_id, t.o as ordinal, max(s.o) as parent from t left join t s on s.d = t.d and s.o < t.o and len(t.p) > 1 and s.p = t.p[1:len(t.p) - 1] group by t.i, t.d, t.o""",
    "join_requested_order": "select (position - 1)::int as position, o_orderkey, o_orderstatus from (select unnest([33, 5, 7, 5, 999999999]) k, unnest(range(1, 6)) position) join orders on o_orderkey = k",
    "join_full_outer": """
select l_partkey, coalesce(early, 0) as early, coalesce(late, 0) as late
from (select l_partkey, count(*) early from lineitem where l_shipdate < timestamp '1995-01-01' group by 1)
full join (select l_partkey, count(*) late from lineitem where l_shipdate >= timestamp '1997-01-01' group by 1) using (l_partkey)""",
    "agg_chunks_per_document": "select c_custkey, count(o_orderkey) as chunks from customer left join orders on o_custkey = c_custkey group by c_custkey",
    "agg_vectors_per_space": "select label, count(*) as vectors, count(distinct len(embedding)) as dimensions from embeddings group by label",
    "agg_messages": "select conv_id, count(*) as messages, count(*) filter (role = 'assistant') as answers from conversations group by conv_id",
    "agg_sheets": "select l_orderkey, count(*) filter (l_linestatus = 'O') as sheets, max(l_quantity) as largest from lineitem group by l_orderkey",
    "agg_snapshot": """
with t as (select ['queued', 'extracting', 'ready', 'failed', 'embedding'][o_orderkey % 5 + 1] status, o_orderkey % 11 chunks from orders)
select count(*) as documents, count(*) filter (status in ('queued', 'extracting')) as reading, count(*) filter (status = 'failed') as failed,
       sum(case when status = 'embedding' then chunks else 0 end)::bigint as pending_chunks, sum(case when status = 'ready' then chunks else 0 end)::bigint as embedded_chunks from t""",
    "agg_rollup_status": "select o_orderstatus, o_orderpriority, count(*) as documents, grouping_id(o_orderstatus, o_orderpriority)::bigint as level from orders group by rollup (o_orderstatus, o_orderpriority)",
    "agg_exact_duplicates": "select sha256(text) as content_hash, min(doc_id) as kept, count(*) - 1 as others from documents group by 1",
    "agg_document_groups": """
select l_orderkey, max(l_extendedprice) as best, string_agg(floor(l_quantity)::int || ':' || l_linenumber, ',' order by floor(l_quantity)::int, l_linenumber) as passages
from lineitem group by l_orderkey""",
    "agg_cited_pages": """
select l_partkey, string_agg(page, ',' order by page) as pages from (
  select distinct l_partkey, unnest(range(floor(l_quantity)::int, floor(l_quantity)::int + l_linenumber + 1)) page from lineitem where l_returnflag = 'R') group by l_partkey""",
    "agg_body_style": """
with s as (select p_brand, p_size size, p_type like '%STEEL%' bold, sum(length(p_name))::bigint chars from part group by all)
select p_brand, size, bold, chars from s qualify row_number() over (partition by p_brand order by chars desc, size, bold) = 1""",
    "agg_repeated_margins": r"""
with t as (select source, doc_id, lower(regexp_replace(string_split(text, chr(10))[1], '[0-9]', '#', 'g')) line from documents),
p as (select source, count(distinct doc_id) pages from t group by source)
select source, md5(line) as line_md5, n from (select source, line, count(distinct doc_id) n from t group by all) join p using (source) where n >= greatest(3, ceil(pages / 20::double))""",
    "agg_distinct_documents": "select distinct o_custkey from orders",
    "win_first_of_runs": """
with t as (select source, doc_id, lang, case when lag(lang) over w = lang then 0 else 1 end c from documents window w as (partition by source order by doc_id)),
r as (select *, sum(c) over (partition by source order by doc_id)::int as run from t)
select source, doc_id, lang, run from r where c = 1""",
    "win_section_runs": """
with t as (select l_orderkey, l_returnflag, l_linenumber, l_linenumber - row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber) island from lineitem),
p as (select *, (row_number() over (partition by l_orderkey, l_returnflag, island order by l_linenumber) - 1) // 3 part from t)
select l_orderkey, l_returnflag, min(l_linenumber) as first_chunk, count(*) as chunks from p group by l_orderkey, l_returnflag, island, part""",
    "win_latest_per_path": "select o_custkey, o_orderkey as latest from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "win_recent": "select o_orderstatus, o_orderkey, row_number() over (partition by o_orderstatus order by o_orderdate desc, o_orderkey desc)::int as n from orders qualify n <= 5",
    "win_history": """
with t as (select *, lag(role) over w p_role, lag(turn) over w p_turn from conversations window w as (partition by conv_id order by turn, role, text)),
p as (select conv_id, p_turn question_turn, turn answer_turn, row_number() over (partition by conv_id order by turn desc) b from t where role = 'assistant' and p_role = 'user')
select conv_id, question_turn, answer_turn, row_number() over (partition by conv_id order by answer_turn)::int as position from p where b <= 3""",
    "win_last_cited": """
with t as (select l_orderkey // 4 conv_id, l_orderkey % 4 turn, l_linenumber n, l_suppkey % 2 document from lineitem),
c as (select * from t qualify turn = max(turn) over (partition by conv_id)),
d as (select *, case when lag(document) over (partition by conv_id order by n, document) = document then 0 else 1 end change from c)
select conv_id, max(document) as document from d group by conv_id having sum(change) = 1""",
    "win_heading_levels": "select p_partkey, least(dense_rank() over (partition by p_brand order by p_size desc), 6)::int as level from part",
    "win_per_document_cap": """
with t as (select l_suppkey query_id, o_custkey, l_orderkey, l_linenumber, l_extendedprice from lineitem join orders on l_orderkey = o_orderkey),
c as (select * from t qualify row_number() over (partition by query_id, o_custkey order by l_extendedprice desc, l_orderkey, l_linenumber) <= 4)
select query_id, l_orderkey, l_linenumber, row_number() over (partition by query_id order by l_extendedprice desc, l_orderkey, l_linenumber)::int as rank from c qualify rank <= 6""",
    "set_prune_orphans": "select s_suppkey as k from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity > 49)",
    "set_union_intersect": """
with c as (select c_nationkey k from customer), s as (select s_nationkey k from supplier)
select 'union' as operation, count(*) as n, sum(k)::bigint as total from (select * from c union select * from s)
union all select 'intersect', count(*), sum(k)::bigint from (select * from c intersect select * from s)
union all select 'except', count(*), sum(k)::bigint from (select distinct k from (select * from c except all select * from s))""",
    "set_adjacent_distinct": """
select conv_id, string_agg(odd::varchar, '' order by turn) as flags from (
  select *, length(text) % 2 odd, lag(length(text) % 2) over (partition by conv_id order by turn) p from conversations) where p is null or p <> odd group by conv_id""",
    "snk_insert_absent": """
select min(doc_id) as doc_id from documents where doc_id % 4 <> 0 and sha256(text) not in (select sha256(text) from documents where doc_id % 4 = 0) group by sha256(text)""",
    "snk_upsert": """
with n as (select c_custkey * 2 c_custkey, 'CHANGED' c_mktsegment from customer where c_custkey % 3 = 0)
select c_custkey, c_mktsegment from customer where c_custkey not in (select c_custkey from n) union all select * from n""",
    "snk_delete": "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)",
    "snk_move_paths": "select page_id, case when starts_with(url, 'http://') then 'archive://' || substr(url, 8) else url end as url from pages",
    "snk_job_progress": """
select user_id, count(*) filter (event_type = 'click') as attempts, arg_max(event_type, (ts, event_id)) as stage, (epoch_us(max(ts)) - epoch_us(min(ts)))::bigint as microseconds from events group by user_id""",
    "snk_null_missing_chunks": "select l_orderkey, l_linenumber, o_orderkey as chunk_id from lineitem left join (select o_orderkey from orders where o_orderstatus <> 'F') on l_orderkey = o_orderkey",
    "ret_import_decision": """
with d as (select doc_id, sha256(text) sha, '/d/' || (doc_id % 700) path from documents),
k as (select sha, min(path) path, case when min(doc_id) % 2 = 0 then 'ready' else 'failed' end status from d where doc_id % 3 = 0 group by sha),
i as (select path, arg_min(sha, doc_id) sha from d where doc_id % 3 <> 0 group by path),
n as (select *, row_number() over (partition by sha order by path) r from i)
select n.path, case when k.status = 'failed' then 'retry' when k.status is not null or r > 1 then 'duplicate' when n.path in (select path from k) then 'updated' else 'new' end as decision
from n left join k using (sha)""",
    "ret_retry_action": """
with t as (select ['failed', 'embedding', 'ready'][o_orderkey % 3 + 1] status from orders)
select status, case status when 'failed' then 'ingest' when 'embedding' then 'embed' else 'none' end as action, count(*) as n from t group by status""",
    "chat_removal_plan": """
with t as (select conv_id c, conv_id * 100 + turn m, turn, role, (role = 'assistant' and conv_id % 2 = 0 and length(text) % 3 = 0) hit from conversations),
r as (select * from t where c % 10 <> 0),
q as (select distinct (select max(u.m) from r u where u.c = a.c and u.role = 'user' and u.turn < a.turn) m from r a where a.hit),
gone as (select c, m, 'answer' reason from r where hit union all select c, r.m, 'question' from r join q using (m))
select c as conversation_id, m as message_id, reason from gone
union all select c, m, 'scoped' from t where c % 10 = 0
union all select c, null, 'emptied' from r group by c having bool_or(hit) and count(*) = (select count(*) from gone where gone.c = r.c)""",
}
