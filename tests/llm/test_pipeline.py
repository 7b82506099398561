"""The pipeline against a brute-force version of its stages, on a small folder of tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from corvane.llm import linededup, quality

from .test_operators import brute_lines, classes_of, five, prose, similar_texts, space_words
from corvane.llm.decontaminate import shingles


def brute_quality(text):
    w = space_words(text)
    seen, places = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            places |= {i + j for i in at for j in range(3)}
    lines = [x for x in (text or "").split("\n") if space_words(x)]
    if len(w) < 50 or 100 * len(places) > 50 * len(w):
        return False
    chars, stops = sum(map(len, w)), sum(x.lower() in quality.STOP_WORDS for x in w)
    rate = lambda marks, n: sum(c in marks for c in text) / n
    return 2 <= chars / len(w) <= 12 and rate("#*$%&|<>", len(w)) <= 0.1 and rate("!?", len(w)) <= 0.5 and stops >= 0.005 * len(w) and (len(lines) - len(set(lines))) / len(lines) <= 0.5


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    where = tmp_path_factory.mktemp("tables")
    items = [prose(rng, 40), prose(rng, 30)]
    doc = lambda n=4: "\n".join(prose(rng, 45) for _ in range(n))
    texts = [doc() for _ in range(12)]
    boiler = prose(rng, 20)
    texts[1] += "\n" + boiler
    texts[2] += "\n" + boiler
    texts += [texts[0], texts[3].replace("the", "teh", 1), "\n".join(reversed(texts[4].split("\n"))), texts[5] + "\n" + items[0], doc(2) + " " + items[1], "### $$$ %%% " * 60, "short one", "", None, "a b c " * 100]
    rows = [(k, x, "en", "s", len(x or ""), "x") for k, x in enumerate(texts)] + [(6, texts[6], "en", "s", 1, "x"), (None, doc(), None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token_ids string").write.parquet(str(where / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(where / "benchmark.parquet"))
    return str(where), rows, items


def test_against_brute_force(spark, folder):
    from pyspark.sql import functions as F

    where, rows, items = folder
    docs = [(r[0], r[1]) for r in rows if brute_quality(r[1])]
    # lines: one of each component stays, the first by id, hash of the text and place
    places, root = brute_lines(docs)
    hashed = {r.t: r.x for r in spark.createDataFrame([(d[1],) for d in docs], "t string").distinct().select("t", F.xxhash64("t").alias("x")).collect()}
    order = lambda p: (p[0], p[1], hashed[p[2]], p[3])
    first = {}
    for x, at in places.items():
        for p in at:
            first[root[x]] = min(first.get(root[x], order(p)), order(p))
    kept = []
    for i, text in docs:
        lines = text.split("\n")
        left = [x for n, x in enumerate(lines) if not space_words(x) or first[root[x]] == (i is None, i or 0, hashed[text], n)]
        if any(map(space_words, left)):
            kept.append((i, "\n".join(left)))
    # near copies: the smallest id of each class of similar texts, repeated rows once
    where_of = classes_of(sorted({d[1] for d in kept}), lambda a, b: similar_texts(five(a), five(b)))
    best = {}
    for d in kept:
        c = where_of[d[1]]
        best[c] = min(best.get(c, d), d, key=lambda x: (x[0] is None, x[0] or 0))
    kept = list(best.values())
    bench = [shingles(x.encode()) for x in items]
    want = sorted((d for d in kept if not any(len(shingles(d[1].encode()) & b) >= 0.8 * len(b) for b in bench)), key=str)
    got = corpus_pipeline.run(spark, where).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    ids = {r.doc_id for r in got}
    assert {0, 1, 2, 3, 5, 6, None} <= ids and not {12, 15, 16, 17, 18, 19, 20, 21} & ids
    assert all(r.intact and r.n_tokens == len(r.token_ids_) and r.token_ids == ("x" if r.doc_id is not None else None) for r in got)


def test_stages_keep_columns(spark, folder):
    where, *_ = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).columns == docs.columns, name
        assert stage(spark, docs.limit(0), where).count() == 0, name
    assert linededup.deduplicated(docs).count() < docs.count()


def test_stages_with_hard_rows(spark, folder):
    """Null columns, empty and very long texts, repeated rows and columns with the stages' own names, stage by stage."""
    from pyspark.sql import functions as F

    where, *_ = folder
    rng = random.Random(2)
    long = "\n".join("the house of " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(150)) for _ in range(1500))
    names = ("row", "t", "k", "h1", "root", "gone", "n", "l", "id_", "kept", "ids", "n_tokens", "intact")
    rows = [(1, long, None), (2, long + "\nthe end", "x"), (3, None, None), (4, "", None), (None, None, None), (None, long, "y"), (2, long + "\nthe end", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, where)
        assert got.columns[: len(docs.columns)] == docs.columns, name
        texts = {r.text for r in got.select("text").collect()}
        assert long in texts, name
    assert stage(spark, docs, where).where("not intact_").count() == 0


def test_line_stage_runs_no_python(spark, folder, monkeypatch):
    """The line stage is DataFrame functions only, in what it writes on the way and in its result."""
    where, *_ = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, lambda *a, **k: pytest.fail("Python on the executors"))
    got = dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, where)
    assert 0 < got.count() < docs.count()
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
