"""Readable places: where in a document something stands, for each of its eight formats, as SQL expressions."""

from __future__ import annotations

#: Fields of a location; those of other formats are null.
LOCATION = (
    "struct<kind: string, page_start: int, page_end: int, heading_path: array<string>, line_start: int, line_end: int, start: int, stop: int, row_start: int, row_end: int, "
    "chapter_index: int, chapter_title: string, section: string, paragraph_start: int, paragraph_end: int, table_number: int, sheet_name: string>")


def _range(one: str, many: str, a: str, b: str) -> str:
    return f"case when {a} is null then null when {b} is null or {b} = {a} then concat('{one} ', {a}) else concat('{many} ', {a}, '–', {b}) end"


def location_label(x: str) -> str:
    """The label of a LOCATION; null without one."""
    path = f"nullif(array_join({x}.heading_path, ' > '), '')"
    cases = {
        "pdf": _range("page", "pages", f"{x}.page_start", f"{x}.page_end"),
        "markdown": f"coalesce({path}, {_range('line', 'lines', f'{x}.line_start', f'{x}.line_end')}, 'start')",
        "text": f"concat('characters ', {x}.start, '–', {x}.stop)",
        "note": f"concat('note, characters ', {x}.start, '–', {x}.stop)",
        "csv": _range("row", "rows", f"{x}.row_start", f"{x}.row_end"),
        "epub": f"concat_ws(' > ', coalesce({x}.chapter_title, concat('chapter ', {x}.chapter_index)), {x}.section)",
        "docx": f"concat_ws(', ', {path}, if({x}.table_number is null, null, concat('table ', {x}.table_number)), if({path} is null, {_range('paragraph', 'paragraphs', f'{x}.paragraph_start', f'{x}.paragraph_end')}, null))",
        "xlsx": f"concat_ws(', ', {x}.sheet_name, {_range('row', 'rows', f'{x}.row_start', f'{x}.row_end')})",
    }
    return "case " + " ".join(f"when {x}.kind = '{k}' then {v}" for k, v in cases.items()) + " end"


def source_label(name: str, x: str) -> str:
    return f"concat_ws(' · ', {name}, {location_label(x)})"


def merged(a: str, b: str) -> str:
    """The location of two neighbouring parts, or null if they cannot be one: kinds, chapters and sheets must agree. Ranges
    grow, heading paths keep their common beginning."""
    both = lambda f, k: f"if({a}.{k} is null or {b}.{k} is null, null, {f}({a}.{k}, {b}.{k}))"
    common = f"if({a}.heading_path is null or {b}.heading_path is null, null, filter({a}.heading_path, (h, i) -> slice({a}.heading_path, 1, i + 1) = slice({b}.heading_path, 1, i + 1)))"
    same = f"{a}.kind = {b}.kind and {a}.chapter_index <=> {b}.chapter_index and {a}.sheet_name <=> {b}.sheet_name"
    fields = {
        "kind": f"{a}.kind", "page_start": both("least", "page_start"), "page_end": both("greatest", "page_end"), "heading_path": common, "line_start": both("least", "line_start"),
        "line_end": both("greatest", "line_end"), "start": both("least", "start"), "stop": both("greatest", "stop"), "row_start": both("least", "row_start"), "row_end": both("greatest", "row_end"),
        "chapter_index": f"{a}.chapter_index", "chapter_title": f"coalesce({a}.chapter_title, {b}.chapter_title)", "section": f"if({a}.section <=> {b}.section, {a}.section, null)",
        "paragraph_start": both("least", "paragraph_start"), "paragraph_end": both("greatest", "paragraph_end"),
        "table_number": f"case when {a}.table_number is null then {b}.table_number when {b}.table_number is null or {a}.table_number = {b}.table_number then {a}.table_number end", "sheet_name": f"{a}.sheet_name"}
    body = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return f"if({same}, named_struct({body}), null)"


def trailing(x: str) -> str:
    """The end of a location: its last page if it has pages, else all of it."""
    keep = [f.split(":")[0].strip() for f in LOCATION[7:-1].replace("array<string>", "a").split(", ")]
    body = ", ".join(f"'{k}', {x}.page_end" if k == "page_start" else f"'{k}', {x}.{k}" for k in keep)
    return f"if({x}.kind = 'pdf', named_struct({body}), {x})"
