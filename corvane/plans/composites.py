"""Registered queries: values, labels, intents, parsing, chunking, passages, prompts, citations, statistics, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import intents as I, text as T, values as V
from ..operators import chunking, citations, fusion, passages, prompts, telemetry, vectors
from ..sources import markup, tabular
from ..streaming import ingest
from ..session import table, through
from .retrieval import _BM25, _FUSED, _candidates, questions

S = SparkSession


def fn_redact(spark: S, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('/Users/', lang, '/x.txt, ', text)").alias("t"))
    return t.select("doc_id", F.expr(T.sanitize("t")).alias("safe"))


def fn_sensitive_fields(spark: S, sf_dir: str) -> DataFrame:
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, ("text", "page_text", "Title", "context", "bytes", "file_name", "my_query", "duration")))).alias("field"))
    return names.select("field", F.expr(T.sensitive("field")).alias("sensitive"))


def fn_neutralize(spark: S, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.expr(T.neutralize("html"))).alias("safe_md5"), F.md5(F.expr(T.attribute("html"))).alias("attribute_md5"))


def fn_single_line(spark: S, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.expr(T.single_line("text"))).alias("line_md5"), F.md5(F.expr(T.kept_lines("text"))).alias("lines_md5"))


def fn_titles(spark: S, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", F.expr(T.conversation_title("text")).alias("title"), F.expr("concat(source, '_', lang, '-report.final.pdf')").alias("f"))
    return p.select("doc_id", "title", F.expr(T.title_of("f")).alias("file_title"))


def fn_content_hash(spark: S, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def fn_json_fields(spark: S, sf_dir: str) -> DataFrame:
    """Fields of JSON text; what is not valid JSON of that shape gives null."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


def fn_cell_kinds(spark: S, sf_dir: str) -> DataFrame:
    cells = ("1.234,56", "R$ 10,5", "12%", "-3", "+4.5", ".5", "1.2.3", "1e5", "2024-03-15", "2024-3-5T10:20", "15/03/2024", "15.03.2024", "31-12-1999 23:59:59Z", "2024-13-01", "99/99/2024", "sim", "Não", "TRUE", "maybe", "text 1", "", "  ")
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, cells))).alias("n", "cell")).select("n", F.expr(V.cell_kind("cell")).alias("kind"))


def csv_column_kinds(spark: S, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return tabular.column_kinds(t.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])


def fn_serial_dates(spark: S, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("cast(o_orderkey % 60000 as double) + cast(o_orderkey % 4 as double) / 4").alias("x"))
    return t.select("o_orderkey", F.expr(V.serial_to_text("x")).alias("date_1900"), F.expr(V.serial_to_text("x", True)).alias("date_1904"))


_INTENTS = (
    ("Resuma o relatório", "overview", None), ("explain the document to me", "overview", None), ("Do que trata este relatório", "overview", None), ("What is this file", "overview", None),
    ("O que diz a seção 7?", "section", "7"), ("leia o capítulo 4.5 comigo", "section", "4.5"), ("tell me about section IV", "section", "4"), ("cláusula nº 21.", "section", "21"),
    ("Section XI", "section", "11"), ("uma parte boa", "regular", None), ("quem pintou o muro?", "regular", None), ("explique", "regular", None), ("arquivo", "regular", None), ("subsection 8", "regular", None))


def fn_intent(spark: S, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([(k, x[0]) for k, x in enumerate(_INTENTS)], "n long, question string")
    return q.select("n", F.expr(I.intent("question")).alias("intent"), F.expr(I.section_label("question")).alias("label"))


_HEADINGS = (("5. Rivers", "5", True), ("5.4 Lakes", "5", True), ("15. Seas", "5", False), ("50 boats", "5", False), ("1. Water > 5. Rivers", "5", True), ("5) Wells", "5", True), ("5–6", "5", True), ("5", "5", True), ("5.x", "5", False), ("5.1.2 ponds", "5.1", True), ("Book 5", "5", False))


def fn_section_matches(spark: S, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([(k, *x[:2]) for k, x in enumerate(_HEADINGS)], "n long, section string, label string")
    return t.select("n", F.expr(I.section_matches("section", "label")).alias("matches"))


def fn_sentences(spark: S, sf_dir: str) -> DataFrame:
    """Sentences of each document, counted, and their texts with one space between words."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(T.sentences("text")).alias("s"))
    return t.select("doc_id", F.size("s").cast("long").alias("sentences"), F.expr(r"md5(array_join(transform(s, x -> regexp_replace(x, '\\s+', ' ')), '|'))").alias("sentences_md5"))


def scan_xhtml_blocks(spark: S, sf_dir: str) -> DataFrame:
    """Blocks of whole pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")

    def fold(rows):
        return [(r["page_id"], n, x["kind"], " > ".join(x["path"]), x["text"]) for r in rows for n, x in enumerate(markup.xhtml(r["html"] or ""))]

    return through(pages, fold, "page_id long, n int, kind string, section string, text string")


def chunk_documents(spark: S, sf_dir: str) -> DataFrame:
    c = chunking.chunked(chunking.paragraph_blocks(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return c.select(F.col("document_id").alias("doc_id"), "ordinal", "tokens", "first", "last", "content_hash")


def chunk_records(spark: S, sf_dir: str) -> DataFrame:
    """Customers of each nation as tabular records."""
    c = table(spark, sf_dir, "customer")
    fields = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in ("c_name", "c_acctbal", "c_mktsegment")])
    from pyspark.sql import Window

    r = c.select(F.col("c_nationkey").alias("document_id"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("row"), fields.alias("fields"))
    return chunking.record_chunks(r, name="customer.csv").select(F.col("document_id").alias("nation"), "ordinal", "tokens", "row_start", "row_end", F.sha2("text", 256).alias("content_hash"))


def _hits(spark: S, sf_dir: str) -> DataFrame:
    """Fused hits over documents, as rows that passages are made from."""
    o = fusion.Options(top_k=passages.Options().search_top_k)
    f = fusion.fuse(*_candidates(spark, sf_dir, o), o)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 4").alias("document_id"), F.expr("cast(doc_id % 4 as int)").alias("ordinal"), F.col("lang").alias("section"), "text")
    t = f.join(d, "chunk_id").withColumn("page_start", F.col("ordinal") + 1).withColumn("page_end", F.col("ordinal") + 1)
    return t.select(*[x.strip().split(" ")[0] for x in passages.HITS.split(",")])


def ret_passages(spark: S, sf_dir: str) -> DataFrame:
    p = passages.passages(_hits(spark, sf_dir), passages.Options(cover_documents=True))
    return p.select("query_id", "rank", "chunk_id", "document_id", "page_start", "page_end", F.round("score", 6).alias("score"), F.size("chunk_ids").alias("chunks"), F.size("duplicates").alias("duplicates"), F.md5("content").alias("content_md5"))


def ret_groups(spark: S, sf_dir: str) -> DataFrame:
    return passages.grouped(passages.passages(_hits(spark, sf_dir))).select("query_id", "document_id", F.round("best_score", 6).alias("best_score"), "position", F.array_join(F.col("ranks").cast("array<string>"), ",").alias("ranks"))


def ret_dedup_exact(spark: S, sf_dir: str) -> DataFrame:
    """Documents of each source that say the same: the best, here by lower id, and the others."""
    d = table(spark, sf_dir, "documents").select(F.expr("cast(substring(source, 4) as bigint)").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.lit(1.0).alias("score"), "text")
    return passages.exact_duplicates(d).select("query_id", "kept", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))


def ctx_sources(spark: S, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(T.prompt_tokens("text")).alias("n"))
    budgets = q.select("query_id", prompts.passage_budget("n").alias("budget"))
    s = prompts.sources(passages.passages(_hits(spark, sf_dir)), budgets)
    return s.select("query_id", "n", "rank", "document_id", "chunk_id", "truncated", "reason", F.md5("content").alias("content_md5"))


def ctx_budget(spark: S, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select("item_id", F.expr(T.prompt_tokens("text")).alias("n"))
    return q.select("item_id", prompts.passage_budget("n", fixed=200).alias("budget"))


def ctx_answerable(spark: S, sf_dir: str) -> DataFrame:
    """Questions whose best fused hit passes the relevance gate."""
    sem, lex = _candidates(spark, sf_dir, fusion.Options())
    f = fusion.fuse(sem.where("false"), lex, fusion.Options(0.5, 0.5))
    return prompts.found(f)


def _answers(spark: S, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").alias("answer_id"), F.expr("concat(text, ' [1, 3] then [2-4]', if(doc_id % 2 = 0, ' [9]', ''), ' and [page ', doc_id % 7 + 1, '] [see].')").alias("answer"))
    s = d.select(F.col("doc_id").alias("answer_id"), F.explode(F.expr("sequence(1, 4)")).alias("n"))
    return a, s.select("answer_id", "n", F.expr("answer_id div 2 + n").alias("document_id"), F.expr("cast(n as int)").alias("page_start"), F.expr("cast(n + answer_id % 3 as int)").alias("page_end"), F.expr("n <> 4").alias("paged"))


def cite_resolve(spark: S, sf_dir: str) -> DataFrame:
    r = citations.resolved(*_answers(spark, sf_dir))
    return r.select("answer_id", F.md5("cleaned").alias("cleaned_md5"), F.array_join(F.col("cited.n").cast("array<string>"), ",").alias("cited"), F.array_join(F.col("invalid").cast("array<string>"), ",").alias("invalid"), F.size("pages").alias("page_refs"), F.size("unresolved_pages").alias("unresolved"))


def cite_documents(spark: S, sf_dir: str) -> DataFrame:
    a, s = _answers(spark, sf_dir)
    c = citations.cited_documents(citations.resolved(a, s), s)
    return c.select("answer_id", "document_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


def tele_op_stats(spark: S, sf_dir: str) -> DataFrame:
    return telemetry.operation_stats(table(spark, sf_dir, "events"))


def tele_throughput(spark: S, sf_dir: str) -> DataFrame:
    return telemetry.throughput(table(spark, sf_dir, "events"), ms="abs(value)")


def ret_lexical_fallback(spark: S, sf_dir: str) -> DataFrame:
    """Search while the vectors are missing: lexical hits, their mode, and a warning."""
    _, lex = _candidates(spark, sf_dir, fusion.Options())
    r = fusion.retrieve(lambda: table(spark, sf_dir, "no_vectors"), lambda: lex)
    return r.hits.select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank", F.lit(r.mode).alias("mode"), F.lit(len(r.warnings)).alias("warnings"))


def ret_semantic_only(spark: S, sf_dir: str) -> DataFrame:
    """Search of lexical weight zero: the nearest vectors alone."""
    sem, _ = _candidates(spark, sf_dir, fusion.Options())
    r = fusion.retrieve(lambda: sem, lambda: sem, fusion.Options(1.0, 0.0))
    return r.hits.select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank", F.lit(r.mode).alias("mode"), F.lit(len(r.warnings)).alias("warnings"))


def ctx_fitted(spark: S, sf_dir: str) -> DataFrame:
    """Orders as prompts whose exact counts must fit: lineitems are their sources, quantities their tokens."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.expr("l_linenumber * 1000000 + l_partkey").alias("n"), F.expr("cast(round(l_discount * 100) as int)").alias("score"), F.expr("cast(l_quantity as bigint)").alias("tokens"), F.lit(20).alias("base"))
    li = li.groupBy("query_id", "n").agg(F.max("score").alias("score"), F.max("tokens").alias("tokens"), F.max("base").alias("base"))
    return prompts.fitted(li, 120).select("query_id", "n", "fits", "kept")


def vec_embed_words(spark: S, sf_dir: str) -> DataFrame:
    """A stand-in for an embedding model: hashed bags of words, 32 dimensions, normalised; empty texts have none."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr(T.folded_words("text"))).alias("w"))
    n = t.groupBy("doc_id", F.expr("pmod(xxhash64(w), 32)").alias("dim")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    v = n.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "n"))).alias("m")).select("doc_id", F.expr("transform(sequence(0L, 31L), d -> coalesce(try_element_at(m, d), 0D))").alias("v"))
    return v.select("doc_id", F.round(F.expr(vectors.norm("v")), 6).alias("length"), F.round(F.expr(f"array_max({vectors.normalized('v')})"), 6).alias("largest"))


def _events(spark: S, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return ingest.arriving(spark, f"{sf_dir}/events.parque*", t.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_daily_counts(spark: S, sf_dir: str) -> DataFrame:
    """Daily counts by event type, all updates folded into the latest."""
    e = _events(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    return ingest.drained(e, "complete")


def stream_gauges(spark: S, sf_dir: str) -> DataFrame:
    return ingest.drained(ingest.gauges(_events(spark, sf_dir), "ts", "event_id", "event_type", "value"), "complete")


def stream_distinct_users(spark: S, sf_dir: str) -> DataFrame:
    """The first event of each user and type, by stateful deduplication: which users did what."""
    return ingest.drained(_events(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


def stream_import(spark: S, sf_dir: str) -> DataFrame:
    """Documents imported by content as their files arrive."""
    t = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = ingest.arriving(spark, f"{sf_dir}/documents.parque*", t.schema).withColumn("sha256", F.sha2("text", 256)).drop("text")
    return ingest.imported(d, "sha256", ["doc_id"]).select("sha256")


def stream_registry(spark: S, sf_dir: str) -> DataFrame:
    """Statistics of each operation over its latest 2000 values, kept as state while events arrive."""
    return ingest.drained(ingest.registry(_events(spark, sf_dir), "event_type", "value", "ts", "event_id"), "update", "operation")


def ret_overview(spark: S, sf_dir: str) -> DataFrame:
    """An overview of each source: documents are its chunks, languages its sections."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("ordinal"), F.col("lang").alias("section"), F.col("doc_id").alias("chunk_id"))
    return passages.overview(d).select(F.col("document_id").alias("source"), F.col("chunk_id").alias("doc_id"), "tokens")


def ret_section(spark: S, sf_dir: str) -> DataFrame:
    """Section 2 of each nation's customers, who are chunks of numbered sections."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("document_id"), F.col("c_custkey").alias("ordinal"), F.expr("concat(c_custkey div 5 % 4, '. ', c_mktsegment)").alias("section"), F.col("c_custkey").alias("chunk_id"))
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_nationkey").cast("long").alias("document_id"), F.lit("2").alias("label"))
    return passages.of_section(c, q).select("query_id", "section", "ordinal", F.size("chunk_ids").alias("chunks"))


def lex_explain_terms(spark: S, sf_dir: str) -> DataFrame:
    """How many documents hold each question term: its document frequency."""
    w = questions(spark, sf_dir).select(F.explode("terms").alias("term")).distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.expr(T.search_words("text")))).alias("term"))
    return d.join(w, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("documents"))



QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k.split("_")[0] in ("fn", "csv", "scan", "chunk", "ret", "ctx", "cite", "tele", "vec", "stream", "lex") and getattr(f, "__module__", "") == __name__}

_TERMS = r"list_filter(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: (length(w) > 1 or regexp_matches(w, '^[0-9]$')) and not list_contains([STOP], w))".replace("STOP", ", ".join(f"'{w}'" for w in T.STOPWORDS))
_FOLDED = rf"list_filter(string_split_regex(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_ROWS = lambda rows: ", ".join("(" + ", ".join("null" if x is None else str(x).lower() if isinstance(x, (bool, int)) else f"'{x}'" for x in r) + ")" for r in rows)

ORACLE_SQL = {
    "fn_redact": r"""
with t as (select doc_id, '<path>, ' || text t from documents)
select doc_id, case when length(t) > 300 then left(t, 300) || '…' else t end as safe from t""",
    "fn_sensitive_fields": "select * from (values ('text', true), ('page_text', true), ('Title', true), ('context', false), ('bytes', false), ('file_name', true), ('my_query', true), ('duration', false)) v(field, sensitive)",
    "fn_neutralize": r"""
select page_id, md5(regexp_replace(translate(html, '<>', '‹›'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g')) as safe_md5,
       md5(trim(regexp_replace(replace(regexp_replace(translate(html, '<>', '‹›'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '"', ''''), '\s+', ' ', 'g'))) as attribute_md5 from pages""",
    "fn_single_line": r"""
select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as line_md5,
       md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) as lines_md5 from documents""",
    "fn_titles": r"""
with t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) t, source, lang from documents)
select doc_id, case when length(t) > 60 then trim(left(t, 60)) || '…' else t end as title, source || ' ' || lang || ' report.final' as file_title from t""",
    "fn_content_hash": "select doc_id, sha256(text) as content_hash from documents",
    "fn_json_fields": "select event_id, (props::json ->> 'k')::bigint as k from events",
    "fn_cell_kinds": """
select (n - 1)::int as n, nullif(kind, '') as kind from (select unnest(['number', 'number', 'number', 'number', 'number', 'number', 'text', 'number', 'date', 'date', 'date', 'date', 'date', 'text', 'text', 'boolean', 'boolean', 'boolean', 'text', 'text', '', '']) kind, unnest(range(1, 23)) n)""",
    "csv_column_kinds": "select * from (values ('o_orderkey', 'number'), ('o_orderstatus', 'text'), ('o_totalprice', 'number'), ('o_orderdate', 'date'), ('o_orderpriority', 'text')) v(\"column\", kind)",
    "fn_serial_dates": """
with t as (select o_orderkey, (o_orderkey % 60000)::int d, (o_orderkey % 4)::int q from orders),
p as (select o_orderkey, case when d > 60 then date '1899-12-30' else date '1899-12-31' end + d a, date '1904-01-01' + d b, case q when 0 then '' when 1 then ' 06:00' when 2 then ' 12:00' else ' 18:00' end c from t)
select o_orderkey, strftime(a, '%Y-%m-%d') || c as date_1900, strftime(b, '%Y-%m-%d') || c as date_1904 from p""",
    "fn_intent": f"select n::bigint as n, intent, label from (values {_ROWS([(k, x[1], x[2]) for k, x in enumerate(_INTENTS)])}) v(n, intent, label)",
    "fn_section_matches": f"select n::bigint as n, matches from (values {_ROWS([(k, x[2]) for k, x in enumerate(_HEADINGS)])}) v(n, matches)",
    "fn_sentences": rf"""
with w as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') w from documents),
e as (select doc_id, list_transform(w, lambda x: regexp_matches(x, '[.!?…]$') and not regexp_matches(lower(x), '^(\pL|{"|".join(a.replace(".", "[.]") for a in T.ABBREVIATIONS)})[.]$')) e, w from w),
s as (select doc_id, w, e, list_transform(w, lambda x, i: case when i = len(w) then x when e[i] then x || '|' else x || ' ' end) p from e)
select doc_id, case when len(w) = 0 then 0 else 1 + len(list_filter(e[:-2], lambda x: x)) end::bigint as sentences, md5(array_to_string(p, '')) as sentences_md5 from s""",
    "ret_dedup_exact": rf"""
with t as (select substr(source, 4)::bigint query_id, doc_id, array_to_string({_FOLDED}, ' ') k from documents),
g as (select query_id, k, min(doc_id) kept, list_sort(list(doc_id)) l from t group by query_id, k)
select query_id, kept, array_to_string(l[2:], ',') as others from g""",
    "ctx_budget": "select item_id, least(3500, floor(greatest(0, 4096 - 900 - ceil(length(text) / 3::double)) * 0.9::double))::int as budget from benchmark",
    "tele_throughput": """
select event_type, count(*) as units, round(case when sum(abs(value)) > 0 then count(*) * 1000 / sum(abs(value)) end, 3) as per_second from events group by 1""",
    "ret_lexical_fallback": f"with {_BM25}" + r""",
lex as (
  select query_id, doc_id, case when hi - lo > 2.220446049250313e-16 then (-bm25 - lo) / (hi - lo) else 1::double end * coverage * coverage as lexical
  from (select *, max(-bm25) over (partition by query_id) hi, min(-bm25) over (partition by query_id) lo from cov where rank <= 32)),
best as (select query_id, doc_id, round(0.4::double * lexical / 0.4::double, 6) as score, row_number() over (partition by query_id order by round(0.4::double * lexical / 0.4::double, 6) desc, doc_id)::int as rank from lex)
select *, 'lexical' as mode, 1 as warnings from best where rank <= 8""",
    "ret_semantic_only": f"with {_FUSED.replace('WS', '1::double').replace('WL', '0::double')}" + """,
alone as (select query_id, doc_id, round(similarity, 6) as score from sem),
ranked_alone as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from alone)
select *, 'semantic' as mode, 0 as warnings from ranked_alone where rank <= 8""",
    "ctx_fitted": """
with s as (select l_orderkey query_id, l_linenumber * 1000000 + l_partkey n, max(round(l_discount * 100)::int) score, max(l_quantity::bigint) tokens from lineitem group by 1, 2),
k as (select *, row_number() over w - 1 k, 20 + sum(tokens) over (partition by query_id) - coalesce(sum(tokens) over (w rows between unbounded preceding and 1 preceding), 0) rest
      from s window w as (partition by query_id order by score, n)),
g as (select query_id, min(k) filter (rest <= 120 and k <= 4) gone from k group by 1)
select query_id, n, gone is not null as fits, gone is not null and k >= gone as kept from k join g using (query_id)""",
    "ctx_answerable": f"with {_BM25}" + r""",
lex as (
  select query_id, case when hi - lo > 2.220446049250313e-16 then (-bm25 - lo) / (hi - lo) else 1::double end * coverage * coverage as lexical
  from (select *, max(-bm25) over (partition by query_id) hi, min(-bm25) over (partition by query_id) lo from cov where rank <= 32))
select query_id, max(round(0.5::double * lexical, 6)) >= 0.28 as answerable from lex group by query_id""",
    "cite_resolve": r"""
with a as (select doc_id, text, doc_id % 7 + 1 p, len(list_filter([1, 2, 3], lambda n: n <= doc_id % 7 + 1 and doc_id % 7 + 1 <= n + doc_id % 3)) > 0 hit from documents)
select doc_id as answer_id, md5(regexp_replace(text || ' [1][3] then [2][3][4] and ' || case when hit then '[page ' || p || ']' else 'page ' || p end || ' [see].', '^\s+', '')) as cleaned_md5,
       '1,3,2,3,4' as cited, case when doc_id % 2 = 0 then '9' else '' end as invalid, hit::int as page_refs, (not hit)::int as unresolved from a""",
    "cite_documents": """
with c as (select doc_id a, unnest([1, 2, 3, 4]) n from documents),
s as (select a, a // 2 + n document_id, case when n <> 4 then range(n, n + (a % 3)::int + 1) else [] end pages from c)
select a as answer_id, document_id, array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') as pages from s group by a, document_id""",
    "tele_op_stats": """
with n as (select event_type, count(*) total, count(*) filter (event_type = 'error') failed from events group by 1),
l as (select event_type, list_sort(list(value)) a from (select * from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 2000) group by 1)
select event_type, total, failed, a[greatest(1, ceil(0.5::double * len(a))::int)] as p50, a[greatest(1, ceil(0.95::double * len(a))::int)] as p95, a[-1] as longest, round(failed / total, 6) as error_rate
from n join l using (event_type)""",
    "stream_daily_counts": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all",
    "stream_gauges": "select event_type, arg_max(value, (ts, event_id)) as latest, count(*) as n from events group by 1",
    "stream_distinct_users": "select distinct user_id, event_type from events",
    "stream_import": "select distinct sha256(text) as sha256 from documents",
    "stream_registry": """
with n as (select event_type, count(*) total from events where value is not null group by 1),
l as (select event_type, list_sort(list(value)) a from (select * from events where value is not null qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 2000) group by 1)
select event_type as operation, total, a[greatest(1, ceil(0.5::double * len(a))::int)] as p50, a[greatest(1, ceil(0.95::double * len(a))::int)] as p95, a[-1] as longest from l join n using (event_type)""",
    "ret_overview": """
with t as (select source, doc_id, case when lag(lang) over (partition by source order by doc_id) = lang then 0 else 1 end c from documents),
f as (select source, doc_id from t where c = 1)
select source, doc_id, least(600, greatest(120, floor(3000 / count(*) over (partition by source))))::int as tokens from f""",
    "ret_section": """
with t as (select c_nationkey::bigint query_id, c_custkey, (c_custkey // 5 % 4) || '. ' || c_mktsegment section from customer where c_custkey // 5 % 4 = 2),
i as (select *, c_custkey - row_number() over (partition by query_id, section order by c_custkey) island from t),
p as (select *, (row_number() over (partition by query_id, section, island order by c_custkey) - 1) // 3 part from i)
select query_id, section, min(c_custkey) as ordinal, count(*)::int as chunks from p group by query_id, section, island, part""",
    "lex_explain_terms": rf"""
with w as (select distinct unnest(list_transform({_TERMS}, lambda t: strip_accents(lower(t)))) term from benchmark),
d as (select doc_id, unnest(list_distinct({_FOLDED.replace(f"translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}')", "strip_accents(lower(text))")})) term from documents)
select term, count(*) as documents from d semi join w using (term) group by term""",
}
