"""Registered queries: text functions, lexical and vector search, fusion. Benchmark items are the questions,
documents the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import fusion, lexical, vectors
from ..session import table

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _fold(x: str) -> str:
    return f"translate(lower({x}), '{T.ACCENTED}', '{T.PLAIN}')"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


_TERMS = rf"list_filter({_words('lower(text)')}, lambda w: (length(w) > 1 or regexp_matches(w, '^[0-9]$')) and not list_contains({_STOP}, w))"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.question_terms(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"))


def fn_normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.expr(T.normalize_query("text")).alias("normalized"))


def fn_lexical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(T.terms("text")).alias("terms"))
    return t.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.expr("get(terms, 0)").alias("first_term"), F.expr("md5(array_join(array_sort(terms), ' '))").alias("terms_md5"))


def fn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(f"md5({T.fold('text')})").alias("folded_md5"), F.expr(f"cast(size({T.folded_words('text')}) as bigint)").alias("n_words"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside the next one of its shelf of a hundred, as (doc_id, a, b)."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "documents")
    return t.select("doc_id", F.col("text").alias("a"), F.lead("text").over(Window.partitionBy(F.expr("doc_id div 100")).orderBy("doc_id")).alias("b")).where("b is not null")


_PAIRS = "select doc_id, text a, lead(text) over (partition by doc_id // 100 order by doc_id) b from documents qualify b is not null"


def fn_search_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as the search index reads them, here with marks that stand alone and letters beyond the usual ones."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(r"concat(text, ' Łódź Ǻ ő ṩ ệ A\u030A')").alias("t"))
    return t.select("doc_id", F.md5(F.expr(f"array_join({T.search_words('t')}, ' ')")).alias("folded_md5"))


def fn_jaccard_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _neighbours(spark, sf_dir).select("doc_id", F.expr(T.folded_words("a")).alias("wa"), F.expr(T.folded_words("b")).alias("wb"))
    t = t.select("doc_id", "wa", "wb", F.expr(T.trigrams("wa")).alias("ga"), F.expr(T.trigrams("wb")).alias("gb"))
    return t.select(
        "doc_id", F.round(F.expr(T.jaccard("ga", "gb")), 6).alias("jaccard"), F.expr("wa = wb").alias("same_content"),
        F.expr(f"{T.numbers('wa')} = {T.numbers('wb')}").alias("same_numbers"))


def fn_contains_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(T.folded_words("text")).alias("w"))
    t = t.withColumn("tail", F.expr("slice(w, greatest(size(w) - 5, 1), 6)"))
    return t.select("doc_id", F.expr(T.contains_words("w", "tail")).alias("has_tail"), F.expr(T.contains_words("w", "reverse(tail)")).alias("has_reversed"))


def fn_join_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of each document joined with its second half, which begins five words earlier: the overlap stands once."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr(r"array_remove(split(text, '\\s+', -1), '')").alias("w")).withColumn("half", F.expr("size(w) div 2"))
    t = t.select("doc_id", F.expr("array_join(slice(w, 1, half), ' ')").alias("a"), F.expr("array_join(slice(w, greatest(half - 4, 1), size(w)), ' ')").alias("b"))
    return t.select("doc_id", F.md5(F.expr(T.join_adjacent("a", "b"))).alias("joined_md5"))


def fn_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[F.expr(f("text")).alias(f.__name__) for f in (T.chunk_tokens, T.prompt_tokens, T.fake_tokens)])


def lex_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, docs = questions(spark, sf_dir), table(spark, sf_dir, "documents")
    hits = lexical.top(lexical.bm25(q, docs, "doc_id"), 20)
    return hits.select("query_id", F.col("chunk_id").alias("doc_id"), "bm25", "rank", F.round("coverage", 6).alias("coverage"))


_BM25 = rf"""
q as (select item_id query_id, list_distinct(list_transform({_TERMS}, lambda t: strip_accents(lower(t)))) terms from benchmark),
wanted as (select query_id, unnest(terms) term from q),
d as (select doc_id, {_words("strip_accents(lower(coalesce(text, '')))")} w from documents),
totals as (select count(*)::double n_docs, avg(len(w)::double) avgdl from d),
tf as (select doc_id, dl, term, count(*) tf from (select doc_id, len(w) dl, unnest(w) term from d) semi join wanted using (term) group by all),
idf as (select term, avgdl, case when n_docs - n + 0.5::double <= n + 0.5::double then 1e-6::double else ln((n_docs - n + 0.5::double) / (n + 0.5::double)) end idf
        from (select term, count(*)::double n from tf group by term), totals),
scores as (
  select query_id, doc_id, round(sum(-idf * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))), 6) bm25
  from tf join idf using (term) join wanted using (term) group by query_id, doc_id),
ranked as (select *, row_number() over (partition by query_id order by bm25, doc_id)::int as rank from scores),
cov as (select query_id, doc_id, r.bm25, r.rank, case when len(terms) = 0 then 1::double else len(list_filter(terms, lambda t: list_contains(w, t)))::double / len(terms) end coverage
        from ranked r join q using (query_id) join d using (doc_id))"""


def vec_knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    q = e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    return vectors.knn(q, e, 10).select("query_id", F.col("chunk_id").alias("vec_id"), "similarity", "rank")


def vec_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As vec_knn_topk, among the vectors of two documents (labels) only."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")
    q = e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    return vectors.knn(q, e.where("label in (1, 2)"), 10).select("query_id", F.col("chunk_id").alias("vec_id"), "similarity", "rank")


def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr(vectors.valid("embedding", 64)).alias("valid"))
    values = F.expr(f"transform({vectors.normalized('embedding')}, x -> cast(round(x, 4) as decimal(9, 4)))").cast("array<string>")
    return e.select("vec_id", "valid", F.round(F.expr(vectors.norm("embedding")), 6).alias("norm"), F.array_join(values, ",").alias("normalized"))


def _knn_sql(where: str) -> str:
    return f"""
with p as (
  select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) similarity
  from embeddings q, embeddings v where q.vec_id % 100 = 0 and {where})
select * from (select *, row_number() over (partition by query_id order by similarity desc, vec_id)::int as rank from p) where rank <= 10"""


def _candidates(spark: SparkSession, sf_dir: str, options: fusion.Options) -> tuple[DataFrame, DataFrame]:
    """Both candidate lists: question n stands for the vector n, document n for the chunk n."""
    k = options.candidates
    q, docs = questions(spark, sf_dir), table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    qv = e.join(q.select(F.col("query_id").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    lex = lexical.top(lexical.bm25(q, docs, "doc_id"), k)
    return vectors.knn(qv, e, k), lex


def hyb_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(*_candidates(spark, sf_dir, fusion.Options())).withColumnRenamed("chunk_id", "doc_id")


def agg_minmax_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search alone: min-max over the candidates, times the coverage squared."""
    sem, lex = _candidates(spark, sf_dir, fusion.Options())
    return fusion.fuse(sem.where("false"), lex, fusion.Options(0.0, 1.0)).select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank")


_FUSED = _BM25 + r""",
sem as (
  select query_id, vec_id doc_id, greatest(0, least(1, similarity)) similarity from (
    select *, row_number() over (partition by query_id order by similarity desc, vec_id) r from (
      select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) similarity
      from embeddings q semi join q i on q.vec_id = i.query_id, embeddings v)) where r <= 32),
lex as (
  select query_id, doc_id, case when hi - lo > 2.220446049250313e-16 then (-bm25 - lo) / (hi - lo) else 1::double end * coverage * coverage as lexical
  from (select *, max(-bm25) over (partition by query_id) hi, min(-bm25) over (partition by query_id) lo from cov where rank <= 32)),
fused as (
  select query_id, doc_id, round(similarity, 6) as semantic, round(lexical, 6) as lexical,
         round((WS * coalesce(similarity, 0) + WL * coalesce(lexical, 0)) / (WS + WL), 6) as score
  from sem full join lex using (query_id, doc_id)),
best as (select *, row_number() over (partition by query_id order by score desc, coalesce(semantic, -1) desc, doc_id)::int as rank from fused)"""

_JOINED = r"""
with w as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') w from documents),
p as (select doc_id, w[1:len(w) // 2] a, w[greatest(len(w) // 2 - 4, 1):] b from w),
o as (select *, coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda n: a[len(a) - n + 1:] = b[1:n])), 0) n from p)
select doc_id, md5(case when len(b) <= n then array_to_string(a, ' ') when len(a) = 0 then array_to_string(b[n + 1:], ' ') else array_to_string(a, ' ') || chr(10) || chr(10) || array_to_string(b[n + 1:], ' ') end) as joined_md5 from o
"""

QUERIES = {f.__name__: f for f in (
    fn_normalize_query, fn_lexical_terms, fn_fold, fn_search_fold, fn_jaccard_trigrams, fn_contains_content, fn_token_counts, lex_bm25_topk,
    vec_knn_topk, vec_knn_filtered, vec_normalize, hyb_fuse, agg_minmax_lexical)} | {"fn_join_adjacent": fn_join_adjacent}

ORACLE_SQL = {
    "fn_normalize_query": r"select item_id, trim(regexp_replace(regexp_replace(text, '[[:cntrl:]]', ' ', 'g'), '\s+', ' ', 'g')) as normalized from benchmark",
    "fn_lexical_terms": rf"""
with t as (select doc_id, {_TERMS} l from documents)
select doc_id, len(list_distinct(l))::bigint as n_terms, l[1] as first_term, md5(array_to_string(list_sort(list_distinct(l)), ' ')) as terms_md5 from t""",
    "fn_search_fold": rf"""select doc_id, md5(array_to_string({_words("strip_accents(lower(text || ' Łódź Ǻ ő ṩ ệ A' || chr(778)))")}, ' ')) as folded_md5 from documents""",
    "fn_fold": rf"select doc_id, md5({_fold('text')}) as folded_md5, len({_words(_fold('text'))})::bigint as n_words from documents",
    "fn_jaccard_trigrams": rf"""
with p as ({_PAIRS}), w as (select doc_id, {_words(_fold('a'))} wa, {_words(_fold('b'))} wb from p),
g as (select *, list_distinct(case when len(wa) < 3 then [array_to_string(wa, ' ')] else list_transform(range(1, len(wa) - 1), lambda i: wa[i] || ' ' || wa[i + 1] || ' ' || wa[i + 2]) end) ga,
                list_distinct(case when len(wb) < 3 then [array_to_string(wb, ' ')] else list_transform(range(1, len(wb) - 1), lambda i: wb[i] || ' ' || wb[i + 1] || ' ' || wb[i + 2]) end) gb from w)
select doc_id, round(len(list_intersect(ga, gb))::double / (len(ga) + len(gb) - len(list_intersect(ga, gb))), 6) as jaccard, wa = wb as same_content,
       list_filter(wa, lambda x: regexp_matches(x, '[0-9]')) = list_filter(wb, lambda x: regexp_matches(x, '[0-9]')) as same_numbers from g""",
    "fn_contains_content": rf"""
with w as (select doc_id, {_words(_fold('text'))} w from documents), t as (select *, w[greatest(len(w) - 5, 1):] tail from w)
select doc_id, len(tail) > 0 and contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(tail, ' ') || ' ') as has_tail,
       len(tail) > 0 and contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(list_reverse(tail), ' ') || ' ') as has_reversed from t""",
    "fn_token_counts": r"""
select doc_id, greatest(ceil(4 * len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) / 3::double), ceil(length(text) / 4::double))::bigint as chunk_tokens,
       ceil(length(text) / 3::double)::bigint as prompt_tokens, ceil(length(text) / 4::double)::bigint as fake_tokens from documents""",
    "lex_bm25_topk": f"with {_BM25} select query_id, doc_id, bm25, rank, round(coverage, 6) as coverage from cov where rank <= 20",
    "vec_knn_topk": _knn_sql("true"),
    "vec_knn_filtered": _knn_sql("v.label in (1, 2)"),
    "vec_normalize": r"""
with n as (select vec_id, embedding, len(embedding) = 64 as valid, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings)
select vec_id, valid, round(n, 6) as norm, array_to_string(list_transform(embedding, lambda x: round(x::double / n, 4)::decimal(9, 4)::varchar), ',') as normalized from n""",
    "hyb_fuse": f"with {_FUSED.replace('WS', '0.6::double').replace('WL', '0.4::double')} select query_id, doc_id, semantic, lexical, score, rank from best where rank <= 8",
    "agg_minmax_lexical": f"with {_BM25}" + r""",
lex as (
  select query_id, doc_id, case when hi - lo > 2.220446049250313e-16 then (-bm25 - lo) / (hi - lo) else 1::double end * coverage * coverage as lexical
  from (select *, max(-bm25) over (partition by query_id) hi, min(-bm25) over (partition by query_id) lo from cov where rank <= 32)),
best as (select query_id, doc_id, round(lexical, 6) as score, row_number() over (partition by query_id order by round(lexical, 6) desc, doc_id)::int as rank from lex)
select * from best where rank <= 8""",
    "fn_join_adjacent": _JOINED,
}
