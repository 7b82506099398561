"""Delimited files: delimiter, column kinds, header, records."""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, functions as F

from ..functions import values as V
from .decode import ParseError, decode, encoding_of

#: Delimiters in order of preference, records looked at, share of a kind, shape of header cells, rows (fixed values).
DELIMITERS, SAMPLE, SHARE, NAME_CHARS, NAME_WORDS, MOST_ROWS = ",;\t|", 50, 80, 40, 4, 250_000
#: Characters that a file is judged by, bytes of a window, and rows and bytes of a file that is streamed (fixed values).
HEAD, WINDOW, STREAM_ROWS, STREAM_BYTES = 256 << 10, 64 << 10, 5_000_000, 1 << 30


def _rows(text: str, delimiter: str):
    return csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)


def sample(text: str, delimiter: str) -> list[list[str]]:
    out = []
    for r in _rows(text, delimiter):
        if r:
            out.append([c.strip() for c in r])
        if len(out) == SAMPLE:
            break
    return out


def delimiter_of(text: str, extension: str = "csv") -> str:
    """The delimiter by which most of the first records have the same width, of two at least; then by which they are
    wider; then the first."""
    if extension.lower() == "tsv":
        return "\t"
    best, chosen = (0, 0), ","
    for d in DELIMITERS:
        widths = [len(r) for r in sample(text, d)]
        if widths:
            width, n = max(Counter(widths).items(), key=lambda x: (x[1], x[0]))
            if width > 1 and (key := (n * 10_000 // len(widths), width)) > best:
                best, chosen = key, d
    return chosen


def _number(c: str) -> bool:
    x = re.sub("[% \u00a0]", "", c.replace("R$", ""))
    x = x.replace(".", "").replace(",", ".") if "." in x and "," in x else x.replace(",", ".")
    return bool(re.fullmatch(r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?", x))


_TIME = r"([T ][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}([.][^:]*)?)?Z*)?"
_DATE = re.compile(rf"[0-9]{{4}}([-/.])(0?[1-9]|1[0-2])\1(0?[1-9]|[12][0-9]|3[01]){_TIME}|(0?[1-9]|[12][0-9]|3[01])([-/.])(0?[1-9]|1[0-2])\8[0-9]{{4}}{_TIME}")


def kind_of(c: str) -> str:
    return "number" if _number(c) else "date" if _DATE.fullmatch(c) else "boolean" if c.lower() in V.BOOLEANS else "text"


def kinds_of(rows: list[list[str]], width: int) -> list[str]:
    """The kind that at least SHARE percent of a column's filled cells have, else text."""
    out = []
    for k in range(width):
        cells = [r[k] for r in rows if k < len(r) and r[k]]
        n = Counter(kind_of(c) for c in cells)
        best = max(("number", "date", "boolean"), key=lambda x: n[x])
        out.append(best if cells and n[best] * 100 >= len(cells) * SHARE else "text")
    return out


def header_of(rows: list[list[str]]) -> str:
    """confident, uncertain or absent: whether the first record names the columns."""
    if len(rows) < 2 or not any(rows[0]):
        return "absent"
    names, rest = rows[0], rows[1:]
    kinds = kinds_of(rest, len(names))
    filled = [n.lower() for n in names if n]
    if any(kind != "number" for n, kind in zip(names, kinds, strict=True) if not n) or any(kind_of(n) != "text" for n in names if n) or len(set(filled)) < len(filled):
        return "absent"
    if any(n and kind != "text" for n, kind in zip(names, kinds, strict=True)):
        return "confident"
    below = lambda k: {r[k].lower() for r in rest if k < len(r)}
    fits = all(n and len(n) <= NAME_CHARS and len(n.split()) <= NAME_WORDS and n.lower() not in below(k) for k, n in enumerate(names))
    return "uncertain" if len(names) > 1 and fits else "absent"


def head_of(text: str, more: bool) -> str:
    """What a file is judged by: its first HEAD characters, up to the last whole line if there is *more*."""
    if len(text) <= HEAD and not more:
        return text
    cut = text[:HEAD]
    return cut[: cut.rfind("\n") + 1] or cut


def dataset_of(head: str, extension: str = "csv") -> dict:
    """Columns, kinds, delimiter and header of a file by its head."""
    d = delimiter_of(head, extension)
    rows = sample(head, d)
    if not rows:
        raise ParseError("empty")
    header = header_of(rows)
    names = [(rows[0][k] if header != "absent" and k < len(rows[0]) else "") or f"Column {k + 1}" for k in range(max(map(len, rows)))]
    return {"columns": names, "kinds": kinds_of(rows[1:] if header != "absent" else rows, len(names)), "delimiter": d, "header": header}


def _blocks(rows: Iterable[list[str]], dataset: dict, most: int) -> Iterator[tuple[int, dict | None]]:
    """(row, block) of each record behind the header; blank ones have no block."""
    names, first = dataset["columns"], dataset["header"] != "absent"
    for row, r in enumerate((r for r in rows if r), 1 - first):
        if row == 0:
            continue
        if row > most:
            raise ParseError("too_large")
        fields = [{"name": names[k] if k < len(names) else f"Column {k + 1}", "value": c.strip()} for k, c in enumerate(r)]
        readable = "\n".join([f"Record {row}", *(f"{f['name']}: {f['value']}" for f in fields if f["value"])])
        yield row, {"path": [], "kind": "record", "text": readable, "first": row, "last": row, "fields": fields} if any(f["value"] for f in fields) else None


def records(data: bytes, extension: str = "csv", most: int = MOST_ROWS) -> tuple[dict, list[dict]]:
    """(dataset, blocks): a block per record with its fields, numbered without the header; blank records are numbered
    but skipped, further cells are named by their place."""
    text, fallback = decode(data)
    dataset = dataset_of(head_of(text, False), extension)
    found = list(_blocks(_rows(text, dataset["delimiter"]), dataset, most))
    return dataset | {"fallback": fallback, "rows": found[-1][0] if found else 0}, [b for _, b in found if b]


def streamed(file: BinaryIO, extension: str = "csv", most: int = STREAM_ROWS, most_bytes: int = STREAM_BYTES) -> Iterator[dict]:
    """The blocks of ``records``, one at a time, from a file that can be read twice: once in windows for its encoding, once for its
    records. Only a window and the head are held in memory."""
    size = file.seek(0, 2)
    if size > most_bytes:
        raise ParseError("too_large")
    file.seek(0)
    encoding, mark = encoding_of(iter(lambda: file.read(WINDOW), b""))
    errors = "strict" if encoding == "utf-8" else "replace"
    file.seek(mark)
    # the head may end within a letter, which an incremental decoder leaves out
    head = codecs.getincrementaldecoder(encoding)(errors).decode(file.read(4 * HEAD)).replace("\r\n", "\n").replace("\r", "\n")
    dataset = dataset_of(head_of(head, size > 4 * HEAD), extension)
    file.seek(mark)
    lines = io.TextIOWrapper(file, encoding=encoding, errors=errors, newline=None)
    try:
        yield from (b for _, b in _blocks(csv.reader(lines, delimiter=dataset["delimiter"]), dataset, most) if b)
    finally:
        lines.detach()


def column_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, kind) of string columns, over all rows: one pass, one row per column and task shuffled."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("cell")) for c in columns])).alias("x")).select("x.*")
    n = cells.withColumn("kind", F.expr(V.cell_kind("cell"))).groupBy("column").agg(
        F.count("kind").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("number", "date", "boolean")])
    most = F.greatest("number", "date", "boolean")
    kind = F.when((F.col("n") == 0) | (most * 100 < F.col("n") * SHARE), "text").when(F.col("number") == most, "number").when(F.col("date") == most, "date").otherwise("boolean")
    return n.select("column", kind.alias("kind"))
