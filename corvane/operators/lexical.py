"""Lexical search: BM25 over an inverted index that is derived, never maintained.

Questions are rows. One pass over the texts counts only the terms that some question has, so the postings
that cross the network follow the questions' vocabulary, not the corpus's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..session import shuffles

#: BM25 constants and the least IDF (fixed values).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Terms of all questions, of about 100 bytes each, that a broadcast may hold; with more, the joins shuffle.
BROADCAST = 200_000
#: Pairs of a question and a chunk that a task may have to add up and rank, of some 400 bytes each.
PAIRS = 500_000


def question_terms(questions: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """Rows (query_id, terms): the search terms, without any diacritic, as the texts' words are."""
    return questions.select(F.col(query_id).alias("query_id"), F.expr(f"array_distinct(transform({T.terms(T.normalize_query(text))}, t -> {T.search_fold('t')}))").alias("terms"))


def bm25(questions: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """Rows (query_id, chunk_id, bm25, coverage) of all chunks that hold any term of a question; lower is better.
    coverage: the share of the question's terms that stand in the chunk.

    *questions* has (query_id, terms). Collection figures are those of all chunks, whatever is filtered later. Texts are cut into
    words once; what has a question's term travels once, dealt by chunk, and a chunk's scores are added up where its terms are. Nearly
    every chunk may hold some term of every question, so the partitions follow the number of pairs, at most PAIRS in each.
    """
    wanted = questions.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))
    # no word is empty: an empty one stands for the chunk itself in the counts
    words = F.expr(f"array_append({T.search_words(f"coalesce({text}, '')")}, '')")
    vocabulary = wanted.select("term").union(wanted.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    tf = chunks.select(F.col(chunk_id).alias("chunk_id"), words.alias("w")).select("chunk_id", F.expr("size(w) - 1").alias("dl"), F.explode("w").alias("term"))
    n_terms, n_questions = wanted.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    small, parts = n_terms <= BROADCAST, shuffles(chunks, PAIRS // max(1, n_questions))
    # never filtered by term below, so that all three uses are of one exchange
    tf = tf.join(F.broadcast(vocabulary) if small else vocabulary, "term", "left_semi").repartition(parts, "chunk_id")
    tf = tf.groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    itself = F.expr("if(term = '', cast(dl as double), null)")
    totals = tf.agg(F.count(itself).cast("double").alias("n_docs"), F.avg(itself).alias("avgdl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    idf = df.crossJoin(totals).select("term", "avgdl", F.expr(f"if(n_docs - n + 0.5D <= n + 0.5D, {LEAST_IDF}D, ln((n_docs - n + 0.5D) / (n + 0.5D)))").alias("idf"))
    weights = wanted.join(idf, "term")
    one = tf.join(F.broadcast(weights) if small else weights, "term")
    one = one.select("query_id", "chunk_id", "n_terms", F.expr(f"-idf * (tf * {K1 + 1}D) / (tf + {K1}D * ({1 - B}D + {B}D * dl / avgdl))").alias("s"))
    one = one if small else one.repartition(parts, "chunk_id")
    return one.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("bm25"), F.expr("count(1) / cast(first(n_terms) as double)").alias("coverage"))


def top(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The *k* best of each question with rank from 1; ties by chunk id. Scores are rounded first, so that
    the order of summation cannot change a rank."""
    s = scores.withColumn("bm25", F.round("bm25", digits))
    by = Window.partitionBy("query_id").orderBy("bm25", "chunk_id")
    return s.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
