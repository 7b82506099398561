"""What a task holds does not grow with the input: partitions follow the rows, and Python workers see few rows at a time."""

from __future__ import annotations

import pytest
from pyspark.sql import Window, functions as F

from corvane import session
from corvane.operators import lexical, vectors
from corvane.plans import registry, retrieval
from corvane.session import table

DATA = "/root/testdata/sf0.001"


def largest(df):
    """The most rows of *df* in a partition."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_pairs_of_questions_and_chunks_are_bounded(spark, monkeypatch):
    q, d = retrieval.questions(spark, DATA), table(spark, DATA, "documents")
    whole = sorted(map(tuple, lexical.top(lexical.bm25(q, d, "doc_id"), 20).collect()))
    monkeypatch.setattr(lexical, "PAIRS", 20 * q.count(), raising=False)
    for most in (lexical.BROADCAST, 0):
        monkeypatch.setattr(lexical, "BROADCAST", most)
        scores = lexical.bm25(q, d, "doc_id")
        assert largest(scores) <= 4 * lexical.PAIRS
        assert sorted(map(tuple, lexical.top(scores, 20).collect())) == whole


def test_nearest_without_a_row_for_each_pair(spark, monkeypatch):
    """As the pairs joined one by one: many equal vectors, nulls, NaN and other lengths among them, in one block or in several."""
    import math
    import random

    chance = random.Random(7)
    rows = [(n, [round(chance.gauss(0, 1), 2) for _ in range(4)]) for n in range(300)] + [(n, [1.0, 2.0, 3.0, 4.0]) for n in range(300, 420)]
    rows += [(500, [1.0, None, 2.0, 3.0]), (501, [math.nan, 1.0, 1.0, 1.0]), (502, [1.0, 1.0]), (503, [2.0, 3.0]), (504, None)]
    v = spark.createDataFrame(rows, "chunk_id long, v array<double>").repartition(3)
    q = v.where("chunk_id % 7 = 0 or chunk_id >= 500").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    unit = lambda a: F.expr(f"transform({a}, x -> x / {vectors.norm(a)})")
    pairs = q.select("query_id", unit("q").alias("q")).crossJoin(v.select("chunk_id", unit("v").alias("v"))).where("size(q) = size(v)")
    pairs = pairs.select("query_id", "chunk_id", F.round(F.expr(vectors.dot("q", "v")), 6).alias("similarity"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")))
    want = sorted(map(str, ranked.where("rank <= 9").collect()))
    for block, products in ((vectors.BLOCK, 2_000_000), (60, 500)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "PRODUCTS", products, raising=False)
        found = vectors.knn(q, v, 9)
        assert sorted(map(str, found.collect())) == want
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_pages_are_made_once(spark):
    plan = registry.queries()["scan_page_lines"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "InPandas" not in plan


@pytest.mark.parametrize("query", ["ret_section_extras", "snk_message_reset", "win_section_runs"])
def test_partitions_follow_the_rows_of_a_table(spark, monkeypatch, query):
    monkeypatch.setattr(session, "ROWS", 500, raising=False)
    rows, least = table(spark, DATA, "lineitem").count(), registry.queries()[query](spark, DATA).rdd.getNumPartitions()
    assert least >= rows // 500


@pytest.mark.parametrize("query", ["cite_documents", "cite_resolve", "scan_epub_files", "scan_outline", "scan_text_violations", "scan_xhtml_blocks", "scan_xlsx_files"])
def test_no_whole_batches_in_python(spark, query):
    assert "MapInPandas" not in registry.queries()[query](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_few_rows_and_bytes_at_a_time(spark):
    def fold(rows):
        return [(len(rows), sum(len(r["x"]) for r in rows), r["x"][:1]) for r in rows for _ in range(2)]

    for size, most_rows, most_bytes in ((10, 256, 1 << 20), (100_000, 16, 2 << 20)):
        t = session.through(spark.range(0, 2000, 1, 1).selectExpr(f"repeat('x', {size}) as x"), fold, "rows int, bytes long, x string")
        assert t.agg(F.count(F.lit(1)), F.max("rows") <= most_rows, F.max("bytes") <= most_bytes, F.min("x")).first() == (4000, True, True, "x")
