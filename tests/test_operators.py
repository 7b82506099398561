"""Passages, prompts, citations, chunks, library mutations and streams on small cases."""

from __future__ import annotations

import random
import sqlite3
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corvane.functions import pytext as P
from corvane.operators import chunking, citations, conversations, fusion, lexical, library, passages, prompts, vectors
from corvane.streaming import ingest


def hit(chunk, document, ordinal, text, score, section=None, semantic=None, lexical=1.0):
    return SimpleNamespace(chunk_id=chunk, document_id=document, ordinal=ordinal, section=section, page_start=ordinal, page_end=ordinal, text=text, score=score, semantic=semantic, lexical=lexical)


def fold(hits, **more):
    return passages.fold_passages(sorted(hits, key=lambda h: (-h.score, h.chunk_id)), passages.Options(**more))


def test_duplicates_and_neighbours():
    got = fold([hit(1, 1, 1, "alpha beta gamma", 0.9), hit(2, 2, 5, "Alpha, beta GAMMA!", 0.8), hit(3, 1, 2, "beta gamma delta", 0.7), hit(4, 1, 3, "delta end", 0.6)])
    assert len(got) == 1 and got[0][6] == "alpha beta gamma\n\ndelta\n\nend" and got[0][8] == [1, 3, 4] and got[0][11] == [(2, 2)]


def test_neighbours_in_order_of_score():
    words = "one two three|four five six|seven eight nine|ten eleven twelve".split("|")
    got = fold([hit(1, 1, 1, words[0], 0.9), hit(3, 1, 3, words[2], 0.8), hit(2, 1, 2, words[1], 0.7)])
    assert [r[8] for r in got] == [[1, 2], [3]]  # not one run of three: 3 came before 2
    got = fold([hit(1, 1, 1, words[0], 0.9, "a"), hit(2, 1, 2, words[1], 0.8, "b")])
    assert len(got) == 2
    assert len(fold([hit(k, 1, k, words[k - 1], 1 - k / 10) for k in range(1, 5)])[0][8]) == 3


def test_near_duplicates_need_equal_numbers():
    text = "the policy covers damage by water and fire in section {} of the contract for all"
    assert len(fold([hit(1, 1, 1, text.format(5), 0.9), hit(2, 2, 9, text.format(5) + " cases", 0.8)])) == 1
    assert len(fold([hit(1, 1, 1, text.format(5), 0.9), hit(2, 2, 9, text.format(7) + " cases", 0.8)])) == 2


def test_limits_and_cover():
    texts = [" ".join(random.Random(k).choices("abcdefghijklmnop", k=12)) for k in range(12)]
    hits = [hit(k, 1, 10 * k, texts[k], 0.9 - k / 100) for k in range(6)] + [hit(9, 2, 1, texts[9], 0.5), hit(10, 3, 1, texts[10], 0.1)]
    assert [r[1] for r in fold(hits, top_k=4)] == [0, 1, 2, 3]
    assert [r[1] for r in fold(hits, top_k=4, cover_documents=True)] == [0, 1, 2, 9]
    assert [r[1] for r in fold(hits)] == [0, 1, 2, 3, 9]
    with pytest.raises(ValueError):
        passages.Options(top_k=0).checked()


def passage(rank, document, chunk, page, content, section=None):
    return SimpleNamespace(rank=rank, document_id=document, chunk_id=chunk, page_start=page, page_end=page, content=content, section=section)


def test_sources_skip_what_does_not_fit():
    p = [passage(1, 7, 1, 9, "first " * 30), passage(2, 8, 2, 1, "long " * 400), passage(3, 7, 3, 2, "small one"), passage(4, 7, 4, 3, "FIRST " * 30), passage(5, 7, 5, 3, "first first")]
    got = prompts.fold_sources(p, 200, 1200)
    assert [(r[0], r[3], r[6]) for r in got] == [(1, 3, None), (2, 1, None), (None, 2, "budget"), (None, 4, "duplicate"), (None, 5, "contained")]


def test_citations():
    s = [(10, 1, 2, True), (11, 5, 9, True), (12, 1, 1, False)]
    text, cited, invalid, pages, left, none = citations.resolve("A [1] b [2, 9] c [7] d [see] e [1–3]. [page 6] [p. 40]", s)
    assert text == "A [1] b [2] c d [see] e [1][2][3]. [page 6] page 40"
    assert [c[0] for c in cited] == [1, 2, 1, 2, 3] and invalid == [7, 9] and left == [40] and not none
    assert [text.encode()[c[1] : c[2]].decode() for c in cited] == ["[1]", "[2]", "[1]", "[2]", "[3]"]
    assert pages == [(6, 11, 2, *pages[0][3:])] and text.encode()[pages[0][3] : pages[0][4]] == b"[page 6]"
    assert citations.group_numbers("2020-2034") is None and citations.group_numbers("3;1, 3") == [3, 1] and citations.group_numbers("4-2") is None
    assert citations.page_number("página 42") == 42 and citations.page_number("pp. 7") == 7 and citations.page_number("paper 7") is None
    assert citations.resolve("I did not find this information here", [])[5]
    assert citations.resolve("x [page 99]", [(10, 1, 2, True)])[3][0][:3] == (99, 10, None)


def test_packing():
    rng = random.Random(4)
    words = "the quick brown fox jumps over lazy dogs near river banks".split()
    blocks = [{"path": ["A"] if k < 20 else ["A", "B"], "kind": "heading" if k in (0, 20) else "paragraph", "text": " ".join(rng.choices(words, k=rng.randint(3, 160))).capitalize() + ".", "first": k, "last": k} for k in range(40)]
    blocks.append({"path": ["A", "B"], "kind": "code", "text": "\n".join(f"line {k} = value" for k in range(400)), "first": 40, "last": 40})
    got = chunking.pack(blocks)
    assert all(c[2] <= chunking.Policy().most and c[2] == P.chunk_tokens(c[1]) for c in got)
    assert {tuple(c[0]) for c in got} == {("A",), ("A", "B")}
    text = " ".join(c[1] for c in got)
    assert all(b["text"] in text for b in blocks if b["kind"] == "paragraph" and P.chunk_tokens(b["text"]) < 300)
    assert chunking.pack([{"path": [], "kind": "paragraph", "text": "x" * 9000, "first": 1, "last": 1}])[0][2] <= 512
    assert chunking.shown_columns(["a"] * 3, 99) == "a, a, a" and chunking.shown_columns([f"column {k}" for k in range(80)], 20).endswith(")")


def test_record_chunks(spark):
    rows = [(1, k, [{"name": "n", "value": f"value {k} " * 6}, {"name": "m", "value": ""}]) for k in range(1, 60)] + [(1, 60, [{"name": "n", "value": "w " * 2000}])]
    got = chunking.record_chunks(spark.createDataFrame(rows, "document_id int, row int, fields array<struct<name: string, value: string>>")).orderBy("ordinal").collect()
    assert all(r.tokens <= 512 for r in got) and [r.ordinal for r in got] == list(range(len(got)))
    assert got[0].row_start == 1 and got[-1].row_end == 60 and "(part 1/" in " ".join(r.text for r in got)


def test_bm25_like_sqlite(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choices("water fire earth wind stone river cloud".split(), weights=[9, 5, 4, 3, 2, 1, 1], k=rng.randint(3, 40)))) for k in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x)")
    db.executemany("insert into t(rowid, x) values (?, ?)", docs)
    want = dict(db.execute("select rowid, bm25(t) from t where t match 'stone OR river OR absent'"))
    q = lexical.question_terms(spark.createDataFrame([(1, "stone and RIVER absent")], "query_id long, text string"))
    got = {r.chunk_id: r.bm25 for r in lexical.bm25(q, spark.createDataFrame(docs, "chunk_id long, text string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_knn_like_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    v = rng.uniform(-1, 1, (300, 16))
    t = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "chunk_id long, v array<float>")
    got = vectors.knn(t.where("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q")), t, 10).collect()
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for k in range(5):
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == k), key=lambda r: r.rank)] == np.argsort(-(n @ n[k]), kind="stable")[:10].tolist()
    bad = spark.createDataFrame([([1.0, 2.0],), ([],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],)], "v array<double>")
    assert [r.ok for r in bad.select(F.expr(vectors.valid("v", 2)).alias("ok")).collect()] == [True, False, False, False, False]


def test_fusion_numbers(spark):
    sem = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5), (1, 12, -0.2)], "query_id long, chunk_id long, similarity double")
    lex = spark.createDataFrame([(1, 11, -8.0, 1.0), (1, 12, -6.0, 0.5), (1, 13, -4.0, 1.0)], "query_id long, chunk_id long, bm25 double, coverage double")
    got = {r.chunk_id: r for r in fusion.fuse(sem, lex).collect()}
    assert {k: r.score for k, r in got.items()} == {10: 0.54, 11: 0.7, 12: 0.05, 13: 0.0} and got[11].rank == 1
    one = fusion.fuse(sem.limit(0), lex.where("chunk_id = 12")).collect()
    assert one[0].lexical == 0.25
    with pytest.raises(ValueError):
        fusion.Options(0.0, 0.0).checked()


def test_parents_and_runs(spark):
    t = spark.createDataFrame([(1, 0, ["A"]), (1, 1, ["A", "B"]), (1, 2, ["A"]), (1, 3, ["A", "B"]), (1, 4, ["A", "B", "C"]), (1, 5, ["X", "Y"])], "document_id int, ordinal int, path array<string>")
    assert [r.parent for r in library.parents(t).orderBy("ordinal").collect()] == [None, 0, None, 2, 3, None]
    r = conversations.runs(spark.createDataFrame([(1, k, s) for k, s in enumerate(["a", "a", None, None, "a"])], "d int, o int, s string"), "d", "o", "s")
    assert [x.run for x in r.orderBy("o").collect()] == [1, 1, 2, 2, 3]


def test_import_decisions(spark):
    known = spark.createDataFrame([("h1", "/a", "ready"), ("h2", "/b", "failed")], "sha256 string, path string, status string")
    new = spark.createDataFrame([("h1", "/z"), ("h2", "/b"), ("h3", "/a"), ("h4", "/n"), ("h4", "/o")], "sha256 string, path string")
    assert {r.path: r.decision for r in library.import_decision(new, known).collect()} == {"/z": "duplicate", "/b": "retry", "/a": "updated", "/n": "new", "/o": "duplicate"}


def test_stream_import_in_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k * 10 + j, f"h{(k + j) % 4}") for j in range(3)], "id int, sha256 string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    got = ingest.imported(ingest.arriving(spark, str(tmp_path / "in"), schema, 1), "sha256", ["id"])
    assert sorted(r.sha256 for r in got.collect()) == ["h0", "h1", "h2", "h3"]


def test_windows_and_sessions(spark, tmp_path):
    rows = [(f"2024-01-0{d} {h:02}:00:00", "a", float(h)) for d in (1, 2, 9) for h in (1, 2, 20)]
    spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "e"))
    e = ingest.arriving(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema)
    assert {str(r.start)[:10]: r.n for r in ingest.drained(ingest.windowed(e, "ts", "k", "v")).collect()} == {"2024-01-01": 3, "2024-01-02": 3}
    e = ingest.arriving(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema)
    assert sorted(r.n for r in ingest.drained(ingest.sessions(e, "ts", "k")).collect()) == [1, 2, 3]


def test_sse(spark):
    parts = ['data: {"choices":[{"delta":{"content":"He', 'llo"}}]}\n', "\ndata: [DO", "NE]\n\n", 'data: {"error":{"message":"x"}}\n\n']
    t = spark.createDataFrame([(1, k, p) for k, p in enumerate(parts)], "stream_id int, seq int, data string")
    assert [(r.kind, r.text) for r in ingest.sse_events(t).orderBy("position").collect()] == [("delta", "Hello"), ("done", None), ("error", "x")]


def test_find():
    from corvane.operators.answers import find

    assert find(["A bela ação", "começa aqui"], "ACAO") == [(0, 7, 11)]
    assert find(["the inter-", "national code", "Code"], "international CODE") == [(0, 4, 9), (1, 0, 13)]
    assert find(["aaa"], "aa") == [(0, 0, 2)] and find(["x"], " ") == []


def test_locations(spark):
    from corvane.functions import labels

    fields = [f.split(":")[0].strip() for f in labels.LOCATION[7:-1].replace("array<string>", "a").split(", ")]
    row = lambda **x: tuple(x.get(f) for f in fields)
    pairs = [
        (row(kind="pdf", page_start=2, page_end=3), row(kind="pdf", page_start=1, page_end=2), ("pages 1–3", "page 3")),
        (row(kind="markdown", heading_path=["A", "B"]), row(kind="markdown", heading_path=["A", "C"]), ("A", "A > B")),
        (row(kind="epub", chapter_index=1), row(kind="epub", chapter_index=2), (None, "chapter 1")),
        (row(kind="csv", row_start=1, row_end=2), row(kind="text", start=1, stop=2), (None, "rows 1–2"))]
    t = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], f"n int, a {labels.LOCATION}, b {labels.LOCATION}")
    t = t.select("n", "a", F.expr(labels.merged("a", "b")).alias("m"), F.expr(labels.trailing("a")).alias("e"))
    got = t.select("n", F.expr(labels.location_label("m")).alias("m"), F.expr(labels.location_label("e")).alias("e")).orderBy("n").collect()
    assert [(r.m, r.e) for r in got] == [w for *_, w in pairs]


def test_free_prompt():
    from corvane.operators.answers import free_prompt

    assert free_prompt([("user", "a" * 30), ("assistant", "b" * 30), ("user", "c" * 30)], 20) == [("assistant", "b" * 30), ("user", "c" * 30)]
    assert free_prompt([("user", "a" * 9000)], 10)[0][1] == "a" * 1500 + "…"


def test_sinks(spark, tmp_path):
    from corvane.sources import sinks

    out = str(tmp_path / "t")
    sinks.replace_documents(spark.createDataFrame([(1, "a"), (2, "b")], "document_id int, x string"), out)
    for _ in range(2):
        sinks.replace_documents(spark.createDataFrame([(2, "c"), (3, "d")], "document_id int, x string"), out)
    assert sorted((r.document_id, r.x) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.log(spark.createDataFrame([("secret", "see /tmp/x y", 3)], "page_text string, note string, n int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).select("page_text", "note", "n").first() == ("[redacted]", "see <path> y", 3)
    files = spark.createDataFrame([("a.TXT", b"x"), ("b.txt", b"x"), ("c.md", b"x")], "path string, content binary")
    assert sorted(r.name[64:] for r in sinks.by_content(files).collect()) == [".md", ".txt"]


def test_span_blocks(spark):
    from corvane.sources import spans

    rows = [(1, 1, 1, "Head", 10.0, 20.0, 20.0, 1), (1, 1, 2, "first part of a hyphen-", 30.0, 40.0, 10.0, None), (1, 1, 3, "ated word.", 42.0, 52.0, 10.0, None), (1, 1, 4, "far below", 90.0, 99.0, 10.0, None), (1, 1, 5, "- item", 101.0, 111.0, 10.0, None)]
    t = spark.createDataFrame(rows, "document_id int, page int, line int, text string, top double, bottom double, size double, level int")
    got = spans.blocks(t).first().blocks
    assert [(b.kind, b.text, b.path) for b in got] == [("heading", "Head", ["Head"]), ("paragraph", "first part of a hyphenated word.", ["Head"]), ("paragraph", "far below", ["Head"]), ("list_item", "- item", ["Head"])]


def test_registry_over_batches(spark, tmp_path):
    for k in (2, 0, 1):  # the latest values, by time, arrive first
        spark.createDataFrame([("a", float(10 * k + j), 10 * k + j, j) for j in range(4)] + [("b", 1.0, 5, 5)] * (k == 0), "k string, v double, t long, i long").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    e = ingest.arriving(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema, 1)
    got = {r.operation: r for r in ingest.drained(ingest.registry(e, "k", "v", "t", "i", 5), "update", "operation").collect()}
    assert got["a"].total == 12 and got["b"].total == 1 and got["b"].p95 == 1.0 and got["a"].longest == 23.0
    assert got["a"].p50 == 21.0  # of 13, 20, 21, 22, 23
