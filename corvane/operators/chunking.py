"""Chunking: blocks of a document become chunks of a target size, with overlap.

Packing depends on the order of the blocks of one document, so it is one fold per document; documents are
independent and their blocks travel as one array, which a document's size bounds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import pytext as P, text as T

BLOCK = "struct<path: array<string>, kind: string, text: string, first: int, last: int>"
CHUNK = "struct<ordinal: int, path: array<string>, text: string, tokens: int, first: int, last: int>"


class Policy(NamedTuple):
    """Tokens of a chunk (fixed values)."""

    target: int = 350
    most: int = 512
    overlap: int = 50
    least: int = 40


class _Unit(NamedTuple):
    block: int
    text: str
    item: bool
    by_lines: bool
    first: int
    last: int

    @property
    def tokens(self) -> int:
        return P.chunk_tokens(self.text)


def _units(k: int, b, policy: Policy, paged: bool) -> list[_Unit]:
    unit = lambda text, by_lines=False: _Unit(k, text, not paged and b["kind"] == "list_item", by_lines, b["first"], b["last"])
    if P.chunk_tokens(b["text"]) <= policy.most:
        return [unit(b["text"])]
    if not paged and b["kind"] in ("code", "table"):
        return [unit(x, True) for x in P.split_lines(b["text"], policy.target)]
    out = []
    for s in P.sentences(b["text"]):
        out += [unit(x) for x in ([s] if P.chunk_tokens(s) <= policy.most else P.split_words(s, policy.target))]
    return out


def _assembled(units: list[_Unit]) -> str:
    text = ""
    for k, u in enumerate(units):
        if k:
            p = units[k - 1]
            text += ("\n" if u.by_lines else " ") if p.block == u.block else "\n" if p.item and u.item else "\n\n"
        text += u.text
    return text


def _overlap(text: str, last: _Unit, policy: Policy) -> list[_Unit]:
    """What the next chunk repeats: the last sentences of the last paragraph that fit, else the last words."""
    if not policy.overlap or last.by_lines:
        return []
    tail, used = [], 0
    for s in reversed(P.sentences(text.rsplit("\n\n", 1)[-1])):
        used += P.chunk_tokens(s)
        if used > policy.overlap:
            break
        tail.insert(0, s)
    repeated = " ".join(tail) or P.last_words(text, policy.overlap)
    return [_Unit(last.block, repeated, False, False, last.last, last.last)] if repeated else []


def pack(blocks: list, policy: Policy = Policy(), paged: bool = False) -> list[tuple]:  # noqa: B008
    """(path, text, tokens, first, last) of each chunk. Headings only carry the path; blank blocks do not count."""
    groups: list[tuple] = []
    for k, b in enumerate(blocks):
        if b["kind"] == "heading" or not (b["text"] or "").strip():
            continue
        path = list(b["path"]) if b["path"] is not None else []
        if not groups or groups[-1][0] != path:
            groups.append((path, []))
        groups[-1][1].extend(_units(k, b, policy, paged))
    out = []
    for path, units in groups:
        chunks: list[list[_Unit]] = []
        now: list[_Unit] = []
        fresh = 0
        for u in units:
            if fresh and sum(x.tokens for x in now) + u.tokens > policy.target:
                chunks.append(now)
                now, fresh = _overlap(_assembled(now), now[-1], policy), 0
            now, fresh = [*now, u], fresh + 1
        new = now[len(now) - fresh :]
        small = sum(u.tokens for u in new)
        if chunks and small < policy.least and P.chunk_tokens(_assembled(chunks[-1])) + small <= policy.most:
            before = chunks[-1]
            chunks[-1] = [_Unit(-1, _assembled(before), False, False, min(u.first for u in before), max(u.last for u in before)), *new]
        elif new:
            chunks.append(now)
        for c in chunks:
            text = _assembled(c)
            out.append((path, text, P.chunk_tokens(text), min(u.first for u in c), max(u.last for u in c)))
    return out


def chunked(documents: DataFrame, policy: Policy = Policy(), paged: bool = False) -> DataFrame:  # noqa: B008
    """Rows (document_id, ordinal, path, text, tokens, first, last, content_hash) from *documents* (document_id, blocks),
    blocks an array of BLOCK in reading order."""
    kind = documents.schema["document_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"document_id": b["document_id"], "chunks": [
                [dict(zip(("ordinal", "path", "text", "tokens", "first", "last"), (n, *c), strict=True)) for n, c in enumerate(pack(list(x if x is not None else []), policy, paged))] for x in b["blocks"]]})

    t = documents.select("document_id", F.expr(f"cast(blocks as array<{BLOCK}>)").alias("blocks"))
    t = t.mapInPandas(run, f"document_id {kind}, chunks array<{CHUNK}>").select("document_id", F.explode("chunks").alias("c"))
    return t.select("document_id", "c.*", F.sha2("c.text", 256).alias("content_hash"))


def record_chunks(records: DataFrame, policy: Policy = Policy(), name: str = "data") -> DataFrame:  # noqa: B008
    """Chunks of tabular records: a preamble (file, columns, rows) and records, blank lines between, packed to what the
    preamble leaves of the target, without overlap. *records*: document_id, row (from 1), fields array<struct<name, value>>.

    Packing in order is a running sum that restarts, which windows cannot express, so it is a fold per document.
    """
    kind = records.schema["document_id"].dataType.simpleString()
    out = f"document_id {kind}, ordinal int, text string, tokens int, row_start int, row_end int"

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("row")
        columns = list(dict.fromkeys(f["name"] for fields in pdf["fields"] for f in fields))
        head = lambda lo, hi: f"File: {name}\nColumns: {shown_columns(columns, policy.most // 4)}\nRows: {lo}-{hi}"
        room = max(1, policy.target - P.chunk_tokens(head(10**6, 10**6)))
        groups: list[list[tuple[int, str]]] = []
        size = 0
        for row, fields in zip(pdf["row"], pdf["fields"], strict=True):
            for part in record_parts(int(row), fields, room):
                n = P.chunk_tokens(part)
                if not groups or size + n > room:
                    groups.append([])
                    size = 0
                groups[-1].append((int(row), part))
                size += n
        if len(groups) > 1 and sum(P.chunk_tokens(p) for _, p in groups[-1]) < policy.least:
            both = groups[-2] + groups[-1]
            if P.chunk_tokens("\n\n".join([head(both[0][0], both[-1][0]), *(p for _, p in both)])) <= policy.most:
                groups[-2:] = [both]
        rows = []
        for n, g in enumerate(groups):
            text = "\n\n".join([head(g[0][0], g[-1][0]), *(p for _, p in g)])
            rows.append((pdf["document_id"].iloc[0], n, text, P.chunk_tokens(text), g[0][0], g[-1][0]))
        return pd.DataFrame(rows, columns=["document_id", "ordinal", "text", "tokens", "row_start", "row_end"])

    return records.select("document_id", "row", "fields").groupBy("document_id").applyInPandas(run, out)


def shown_columns(columns: list[str], most: int) -> str:
    n = P.longest_fit(len(columns), lambda k: P.chunk_tokens(", ".join(columns[:k])) <= most)
    return ", ".join(columns[: max(1, n)]) + (f", … (+{len(columns) - max(1, n)})" if max(1, n) < len(columns) else "")


def record_parts(row: int, fields, most: int) -> list[str]:
    """A record as text, in titled parts if it is too long."""
    lines = [f"{f['name']}: {f['value']}" for f in fields if (f["value"] or "").strip()]
    whole = "\n".join([f"Record {row}", *lines])
    if P.chunk_tokens(whole) <= most:
        return [whole]
    cut = [x for line in lines for x in (P.split_words(line, max(1, most - 12)) if P.chunk_tokens(line) > most - 12 else [line])]
    parts = P.pieces(cut, "\n", max(1, most - 12))
    return [f"Record {row} (part {k}/{len(parts)})\n{p}" for k, p in enumerate(parts, 1)]


def paragraph_blocks(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """Plain text as BLOCK arrays: paragraphs between blank lines, located by their numbers."""
    p = rf"filter(transform(split({text}, '\n[ \t]*\n', -1), x -> regexp_replace(x, '^\\s+|\\s+$', '')), x -> x <> '')"
    return documents.select(F.col(id_col).alias("document_id"), F.expr(
        f"transform({p}, (x, i) -> named_struct('path', cast(array() as array<string>), 'kind', 'paragraph', 'text', x, 'first', cast(i + 1 as int), 'last', cast(i + 1 as int)))").alias("blocks"))


def offset_ordinals(chunks: DataFrame, by: str, part: str) -> DataFrame:
    """Ordinals that run on over the parts (sheets) of a document."""
    n = chunks.groupBy(by, part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.join(n.withColumn("_before", before), [by, part]).withColumn("ordinal", (F.col("ordinal") + F.col("_before")).cast("int")).drop("_n", "_before")


def sentence_rows(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    return documents.select(id_col, F.posexplode(F.expr(T.sentences(text))).alias("n", "sentence"))
