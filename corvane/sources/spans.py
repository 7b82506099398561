"""Page layout: spans of text with boxes become lines, reading order, levels. Raw page bytes are not read here; spans come
as rows (document_id, page, text, left, top, right, bottom, font_size, bold)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import dealt, through

#: Share of a page's height that is margin at either end (fixed value).
BAND = 0.08
#: Lines back that a span may still join (fixed value).
REACH = 3


def rotated(x: str, y: str, width: str, height: str, degrees: str) -> tuple[Column, Column]:
    """A point of a page turned by a multiple of 90 degrees, from the top left."""
    return (
        F.expr(f"case pmod({degrees}, 360) when 90 then {height} - {y} when 180 then {width} - {x} when 270 then {y} else {x} end"),
        F.expr(f"case pmod({degrees}, 360) when 90 then {x} when 180 then {height} - {y} when 270 then {width} - {x} else {y} end"))


def fold_lines(spans: list) -> list[list]:
    """The spans of a page as lines, in order of their tops and then from the left: a span joins the latest of the last REACH
    lines whose centre is nearer than half the smaller font (one point at least). Spans without text do not count."""
    lines: list[list] = []
    for s in sorted((s for s in spans if s.text and s.text.strip()), key=lambda s: (s.top, s.left)):
        centre = (s.top + s.bottom) / 2
        for line in lines[: -REACH - 1 : -1]:
            middle = (min(x.top for x in line) + max(x.bottom for x in line)) / 2
            if abs(middle - centre) < max(min(s.font_size, max(x.font_size for x in line)), 1.0) / 2:
                line.append(s)
                break
        else:
            lines.append([s])
    return lines


class _Span(NamedTuple):
    text: str
    left: float
    top: float
    right: float
    bottom: float
    font_size: float
    bold: bool


def _line(line: list) -> tuple:
    line = sorted(line, key=lambda s: s.left)
    texts = [" ".join(s.text.split()) for s in line]
    chars, bold = sum(map(len, texts)), sum(len(t) for t, s in zip(texts, line, strict=True) if s.bold)
    edges = [f(getattr(s, k) for s in line) for f, k in ((min, "left"), (min, "top"), (max, "right"), (max, "bottom"), (max, "font_size"))]
    return " ".join(texts), *edges, bold * 2 > chars, chars


def lines(spans: DataFrame) -> DataFrame:
    """Rows (document_id, page, line, text, left, top, right, bottom, size, bold, chars): size is the largest font, bold
    whether most characters are. A page is one fold, for a line's extent decides what joins it next; pages travel as rows, so
    that a fold does not cost a group of its own in Python."""
    kind = spans.schema["document_id"].dataType.simpleString()
    fields = [c if c in ("text", "bold") else F.coalesce(c, F.lit(float("nan"))).alias(c) for c in _Span._fields]
    t = spans.select("document_id", F.col("page").cast("int").alias("page"), F.struct(*fields).alias("s"))
    t = dealt(t, "document_id", "page").groupBy("document_id", "page").agg(F.collect_list("s").alias("spans"))

    def fold(pages):
        return [(p["document_id"], p["page"], n, *_line(x)) for p in pages for n, x in enumerate(fold_lines([_Span(**s) for s in p["spans"]]), 1)]

    return through(t, fold, f"document_id {kind}, page int, line int, text string, left double, top double, right double, bottom double, size double, bold boolean, chars long")


def drafts(blocks: DataFrame) -> DataFrame:
    """*blocks* (page, text, boxes, an array of structs with page) with page_start and page_end, those of its boxes or else its
    own page, and content_hash."""
    pages = "transform(boxes, b -> b.page)"
    return blocks.select("*", F.expr(f"coalesce(array_min({pages}), page)").alias("page_start"), F.expr(f"coalesce(array_max({pages}), page)").alias("page_end"), F.sha2("text", 256).alias("content_hash"))


def body_style(page_lines: DataFrame) -> DataFrame:
    """The style of most characters of each document; ties to the smaller size, then not bold."""
    s = page_lines.groupBy("document_id", F.round("size", 0).alias("size"), "bold").agg(F.sum("chars").alias("chars"))
    return s.groupBy("document_id").agg(F.max_by(F.struct("size", "bold"), F.struct("chars", -F.col("size"), ~F.col("bold"))).alias("body")).select("document_id", "body.*")


def without_margins(page_lines: DataFrame, height: float) -> DataFrame:
    """Lines without page numbers, and without what the margins of at least max(3, half) of a document's pages repeat. Counts are taken
    beside the lines, which are therefore made once."""
    centre = (F.col("top") + F.col("bottom")) / 2
    t = page_lines.withColumn("_key", F.expr(T.margin_key("text"))).withColumn("_margin", (centre <= height * BAND) | (centre >= height * (1 - BAND)))
    t = t.withColumn("_pages", F.size(F.collect_set("page").over(Window.partitionBy("document_id"))))
    t = t.withColumn("_n", F.size(F.collect_set(F.when(F.col("_margin"), F.col("page"))).over(Window.partitionBy("document_id", "_key"))))
    again = F.expr("_key is not null and _n >= greatest(3, ceil(_pages / 2D))")
    return t.where(~(F.col("_margin") & (again | F.expr(T.page_number("text"))))).select(*page_lines.columns)


def heading_levels(page_lines: DataFrame, most: int = 6) -> DataFrame:
    """*page_lines* with level: the rank of the sizes above the body's, at most *most*; bold lines of body size come next;
    null for text."""
    t = page_lines.withColumn("_rounded", F.round("size", 0))
    t = t.withColumn("_chars", F.sum("chars").over(Window.partitionBy("document_id", "_rounded", "bold")))
    body = F.max_by(F.struct("_rounded", "bold"), F.struct("_chars", -F.col("_rounded"), ~F.col("bold"))).over(Window.partitionBy("document_id"))
    t = t.withColumn("_body", body)
    big = F.col("_rounded") > F.col("_body._rounded")
    by = Window.partitionBy("document_id").orderBy(F.desc(F.when(big, F.col("_rounded"))))
    level = F.when(big, F.least(F.dense_rank().over(by), F.lit(most))).when(F.col("bold") & ~F.col("_body.bold") & (F.col("_rounded") == F.col("_body._rounded")), F.lit(most))
    return t.withColumn("level", level).select(*page_lines.columns, "level")


def box_union(boxes: str) -> str:
    """SQL for the least box around an array of boxes (left, top, right, bottom)."""
    least = lambda f, k: f"{f}(transform({boxes}, b -> b.{k}))"
    return f"named_struct('left', {least('array_min', 'left')}, 'top', {least('array_min', 'top')}, 'right', {least('array_max', 'right')}, 'bottom', {least('array_max', 'bottom')})"


def blocks(leveled: DataFrame) -> DataFrame:
    """Blocks of each document, (document_id, blocks) with blocks as chunking takes them, from lines with levels: headings
    give paths, list items begin where a line begins one, other lines go on with the paragraph before unless a gap
    of more than a line parts them. What a line end cut is joined. The order of lines matters, so it is a fold."""
    kind = leveled.schema["document_id"].dataType.simpleString()
    t = leveled.withColumn("item", F.expr(T.starts_list("text")))

    def run(pdf):
        import re

        import pandas as pd

        out, path, before = [], [], None
        for r in pdf.sort_values(["page", "line"]).itertuples(index=False):
            level = None if pd.isna(r.level) else int(r.level)
            if level is not None:
                path = [p for p in path if p[0] < level] + [(level, r.text)]
                out.append({"path": [p[1] for p in path], "kind": "heading", "text": r.text, "first": r.page, "last": r.page})
            else:
                near = before is not None and before.page == r.page and r.top - before.bottom <= r.size or before is not None and before.page != r.page and not before.text.rstrip().endswith((".", "!", "?", ":"))
                if out and out[-1]["kind"] != "heading" and not r.item and near:
                    text = out[-1]["text"]
                    cut = re.search(r"\w-$", text) and r.text[:1].islower()
                    out[-1]["text"] = text[:-1] + r.text if cut else f"{text} {r.text}"
                    out[-1]["last"] = r.page
                else:
                    out.append({"path": [p[1] for p in path], "kind": "list_item" if r.item else "paragraph", "text": r.text, "first": r.page, "last": r.page})
            before = None if level is not None else r
        return pd.DataFrame({"document_id": [pdf["document_id"].iloc[0]], "blocks": [out]})

    return t.groupBy("document_id").applyInPandas(run, f"document_id {kind}, blocks array<struct<path: array<string>, kind: string, text: string, first: int, last: int>>")
