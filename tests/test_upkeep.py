"""Vector spaces, background work, search words, lines of pages, rules of blocks, stages of processing, messages."""

from __future__ import annotations

import io
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import conversations, lexical, library, passages, vectors
from corvane.sources import packages, reader, spans, tabular
from corvane.sources.decode import ParseError, decode, encoding_of
from corvane.streaming.work import Busy, Work

FILE = "path string, format string, error string, blocks array<struct<text: string, first: int, last: int>>"


def test_search_words_have_no_diacritics(spark):
    t = spark.createDataFrame([("Łódź ĂN ő ệ Åb",), ("",), (None,)], "t string")
    assert [r.w for r in t.select(F.expr(T.search_words("t")).alias("w")).collect()] == [["łodz", "an", "o", "e", "ab"], [], None]
    q = lexical.question_terms(spark.createDataFrame([(1, "ődon")], "query_id long, text string"))
    d = spark.createDataFrame([(1, "Odon"), (2, "ŐDON x"), (3, "else"), (4, None)], "chunk_id long, text string")
    assert sorted(r.chunk_id for r in lexical.bm25(q, d).collect()) == [1, 2]


def test_work_is_exclusive_or_overlaps():
    w = Work()
    with w.of(), w.of():
        assert w.running == 2
        with pytest.raises(Busy), w.of(exclusive=True):
            pass
    with w.of(exclusive=True), pytest.raises(Busy), w.of():
        pass
    assert w.running == 0


def test_work_ends_when_its_body_fails():
    w = Work()
    with pytest.raises(KeyError), w.of(exclusive=True):
        raise KeyError
    with w.of():
        assert w.running == 1


def test_vector_spaces(spark):
    known = spark.createDataFrame([("m", "r", 3)], "model string, revision string, dims int")
    assert vectors.with_space(known, "m", "r", 3).count() == 1 and vectors.with_space(known, "m", "s", 4).count() == 2
    with pytest.raises(ValueError):
        vectors.with_space(known, "m", "r", 4)
    old = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "chunk_id long, v array<double>")
    new = spark.createDataFrame([(1, 1, [0.0, 2.0]), (1, 3, [float("nan"), 1.0]), (2, 2, [0.0, 5.0]), (3, 4, None), (4, 2, [0.0, 6.0])], "batch long, chunk_id long, v array<double>")
    assert {r.chunk_id: r.v for r in vectors.stored(old, new, 2).collect()} == {1: [1.0, 0.0], 2: [0.0, 6.0]}


def test_lines_look_back_three():
    Span = namedtuple("Span", "text left top right bottom font_size bold")
    at = lambda text, left, top, size=10.0: Span(text, left, top, left + 9, top + size, size, False)
    # a span of the first line comes after two others that lie between by their tops
    got = spans.fold_lines([at("a", 0.0, 10.0), at("b", 50.0, 16.0, 2.0), at("c", 80.0, 11.0), at(" ", 5.0, 10.0), at("d", 0.0, 40.0)])
    assert [[s.text for s in line] for line in got] == [["a", "c"], ["b"], ["d"]]
    assert spans.fold_lines([]) == []


def test_violations(spark):
    rows = [("a", "text", None, [("x", 0, 1), (" ", 0, 1), ("y", 2, 2), ("z", None, 3)]), ("b", "pdf", None, [("x", 1, 1), ("y", 0, 1), (None, 1, 1)]), ("c", "pdf", None, []), ("d", "pdf", None, None)]
    got = {(r.path, r.n, r.problem) for r in reader.violations(spark.createDataFrame(rows, FILE)).collect()}
    assert got == {("a", 1, "no_text"), ("a", 2, "invalid_place"), ("a", 3, "invalid_place"), ("b", 1, "invalid_place"), ("b", 2, "no_text")}


def test_processed(spark):
    rows = [("a", "pdf", None, [(" ", 1, 1)]), ("b", "text", None, [("", 0, 1)]), ("c", "pdf", None, [("x", 1, 1)]), ("d", "epub", "drm", [])]
    got = {r.path: (r.needs_ocr, r.error, len(r.blocks)) for r in reader.processed(spark.createDataFrame(rows, FILE)).collect()}
    assert got == {"a": (True, None, 0), "b": (False, "empty", 0), "c": (False, None, 1), "d": (False, "drm", 0)}


def test_media_type_goes_first_and_archives_are_stable(spark):
    t = spark.createDataFrame([("x.csv", b"Title\n\nbody", "application/x-note"), ("y.txt", b"one", None)], "path string, content binary, media_type string")
    assert {r.path: (r.format, r.title) for r in reader.parsed(t).collect()} == {"x.csv": ("note", "Title"), "y.txt": ("text", None)}
    p = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", {"y": "2", "x": "1"}), ("c", None)], "path string, parts map<string,string>")
    got = {r.path: bytes(r.content) for r in packages.zipped(p).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_section_extras(spark):
    q = spark.createDataFrame([(1,), (2,), (1,)], "query_id long")
    s = spark.createDataFrame([(1, 5, [7, 8])], "query_id long, ordinal int, chunk_ids array<int>")
    f = [(1, r, 0.9 if r != 3 else 0.1, [r]) for r in range(1, 10)] + [(2, 1, 0.1, [1]), (9, 1, 1.0, [1])]
    f = [(k, r, score, [8] if (k, r) == (1, 1) else c) for k, r, score, c in f]
    got = passages.with_extras(q, s, spark.createDataFrame(f, "query_id long, rank int, score double, chunk_ids array<int>")).collect()
    assert sorted((r.query_id, r.kind, r.rank, r.chunk_ids) for r in got) == [(1, "extra", 1, [2]), (1, "extra", 2, [4]), (1, "extra", 3, [5]), (1, "section", 1, [7, 8]), (2, "search", 1, [1])]


def test_removal_refuses_what_is_being_read(spark):
    d = spark.createDataFrame([(1, "ready"), (2, "chunking"), (3, None)], "document_id long, status string")
    c = spark.createDataFrame([(1,), (2,), (3,), (3,)], "document_id long")
    left, refused = library.removed({"d": d, "c": c}, "d", spark.createDataFrame([(1,), (2,), (3,), (4,)], "document_id long"))
    assert [r.document_id for r in left["d"].collect()] == [2] and left["c"].count() == 1 and [r.document_id for r in refused.collect()] == [2]


def test_questions_wait_for_answers(spark):
    m = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    q = spark.createDataFrame([(1, " c "), (1, "d"), (2, "new"), (3, " "), (4, None)], "conv_id long, question string")
    got = conversations.pending(conversations.asked(m, q)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, "c"), (2, 1, "new")]


@pytest.mark.parametrize("data", [b"", b"a", "é".encode(), "é".encode()[:1], b"\xef\xbb\xbfab", "aé€😀b".encode() * 9, "é".encode("cp1252") * 5, b"\xff\xfea\0", b"\xfe\xff\0a", b"ab\xc3"])
@pytest.mark.parametrize("window", [1, 2, 3, 7])
def test_encoding_by_windows(data, window):
    assert encoding_of([data[k : k + window] for k in range(0, len(data), window)]) == encoding_of([data])


def test_encoding_errors_by_windows():
    for data, kind in ((b"\xef\xbb\xbfok\xff", "encoding"), (b"abc\0", "invalid"), (b"\xef\xbb\xbfok\xc3", "encoding")):
        for window in (1, 4):
            with pytest.raises(ParseError) as e:
                encoding_of([data[k : k + window] for k in range(0, len(data), window)])
            assert e.value.kind == kind
    assert decode(b"ab\xc3") == ("abÃ", True)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "utf-16"])
def test_streamed_records_are_the_collected_ones(encoding):
    data = ("name;valor\r\n" + "".join(f'é{k};"{k}\r\n,5"\r\n' if k % 5 else ";\r\n" for k in range(3000))).encode(encoding)
    assert list(tabular.streamed(io.BytesIO(data))) == tabular.records(data)[1]
    for limits in ({"most": 10}, {"most_bytes": 10}):
        with pytest.raises(ParseError):
            list(tabular.streamed(io.BytesIO(data), **limits))


def test_head_ends_at_a_line():
    text = "a,b\n" * (tabular.HEAD // 3)
    assert tabular.head_of(text, False).endswith("\n") and len(tabular.head_of(text, False)) <= tabular.HEAD and tabular.head_of("a,b", False) == "a,b" and tabular.head_of("a\nb", True) == "a\n"


def test_parsers_can_be_registered(spark):
    mine = lambda data, name: ("T", [{"path": [], "kind": "paragraph", "text": name, "first": 1, "last": 1}], [])
    t = spark.createDataFrame([("x.pdf", b"?"), ("y.txt", b"one")], "path string, content binary")
    assert {r.path: (r.title, r.blocks[0].text) for r in reader.parsed(t, {"pdf": mine}).collect()} == {"x.pdf": ("T", "x.pdf"), "y.txt": (None, "one")}


def test_normalized_blocks(spark):
    b = [([], "code", "a\u00a0  b\n\nc", 1, 1), ([], "table", " a  b \n\n c", 1, 1), (["p"], "paragraph", "a\n b", 1, 1), ([], "paragraph", " \u200b", 1, 1)]
    t = spark.createDataFrame([("x", b)], "path string, blocks array<struct<path: array<string>, kind: string, text: string, first: int, last: int>>")
    once = reader.normalized(t)
    assert [x.text for x in once.head().blocks] == ["a\u00a0  b\n\nc", "a b\nc", "a b"] and reader.normalized(once).head() == once.head()
