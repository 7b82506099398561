"""DOCX documents and XLSX workbooks, read with the standard library."""

from __future__ import annotations

import re
from datetime import date, timedelta

from ..functions.values import DATE_FORMATS
from .decode import ParseError
from .markup import _part, opened, resolved, xml_root
from .plain import block
from .tabular import MOST_ROWS, header_of

#: Bytes of one entry of an office package at most.
ENTRY = 96 << 20


def _relations(z, part: str) -> dict:
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    return {x.get("Id"): (x.get("Type", "").rpartition("/")[2], resolved(part, x.get("Target", "").lstrip("/")) if not x.get("Target", "").startswith("/") else x.get("Target", "").lstrip("/")) for x in xml_root(_part(z, path)).iter("Relationship")}


def _main(z) -> str:
    found = next((t for kind, t in _relations(z, "").values() if kind == "officeDocument"), None)
    if found is None:
        raise ParseError("invalid", "no main part")
    return found


def _core(z) -> dict:
    if "docProps/core.xml" not in z.namelist():
        return {}
    names = {"title": "title", "creator": "author", "language": "language", "subject": "subject", "created": "created", "modified": "modified"}
    return {names[x.tag]: x.text.strip() for x in xml_root(_part(z, "docProps/core.xml")) if x.tag in names and (x.text or "").strip()}


def _paragraph(p) -> str:
    """Readable text: tabs and breaks are spaces, no-break hyphens are hyphens; fallback content does not count."""
    out: list[str] = []

    def walk(x) -> None:
        for c in x:
            if c.tag == "t":
                out.append(c.text or "")
            elif c.tag in ("tab", "br", "cr"):
                out.append(" ")
            elif c.tag == "noBreakHyphen":
                out.append("-")
            elif c.tag not in ("Fallback", "instrText", "del", "pPr", "rPr"):
                walk(c)

    walk(p)
    return " ".join("".join(out).split())


class _Styles:
    def __init__(self, root) -> None:
        self.styles = {s.get("styleId"): s for s in root.iter("style")} if root is not None else {}

    def level(self, p) -> int | None:
        """The heading level of a paragraph: from itself, or a style's outline or name, through six bases."""
        props = p.find("pPr")
        if props is None:
            return None
        own = props.find("outlineLvl")
        if own is not None:
            return int(own.get("val", "9")) + 1 if int(own.get("val", "9")) < 9 else None
        style = props.find("pStyle")
        name = style.get("val") if style is not None else None
        for _ in range(6):
            s = self.styles.get(name)
            if s is None:
                m = re.fullmatch(r"(?i)(?:heading|t[ií]tulo)\s*([1-9])", name or "")
                return int(m[1]) if m else None
            outline = s.find("pPr/outlineLvl")
            if outline is not None:
                return int(outline.get("val", "9")) + 1 if int(outline.get("val", "9")) < 9 else None
            title = s.find("name")
            if title is not None and (m := re.fullmatch(r"(?i)(?:heading|t[ií]tulo)\s*([1-9])", title.get("val", ""))):
                return int(m[1])
            base = s.find("basedOn")
            name = base.get("val") if base is not None else None
        return None

    def caption(self, p) -> bool:
        style = p.find("pPr/pStyle")
        return style is not None and bool(re.search("(?i)caption|legenda", style.get("val", "")))


def _cell(c) -> str:
    return " ".join(x for x in (_paragraph(p) for p in c.iter("p")) if x)


def docx(data: bytes) -> tuple[dict, list[dict]]:
    """(metadata, blocks) located by paragraphs from 1, empty ones not counted. A table with a declared or reliable
    header gives one record per row, another table one block."""
    z = opened(data, entry=ENTRY)
    main = _main(z)
    body = xml_root(_part(z, main)).find("body")
    if body is None:
        raise ParseError("invalid", "no body")
    parts = {kind: t for kind, t in _relations(z, main).values()}
    load = lambda kind: xml_root(_part(z, parts[kind])) if parts.get(kind) in z.namelist() else None
    styles, numbering = _Styles(load("styles")), load("numbering")
    ordered = {}
    if numbering is not None:
        abstract = {a.get("abstractNumId"): {lv.get("ilvl"): (lv.find("numFmt").get("val") if lv.find("numFmt") is not None else "decimal") for lv in a.iter("lvl")} for a in numbering.iter("abstractNum")}
        for n in numbering.iter("num"):
            a = n.find("abstractNumId")
            ordered[n.get("numId")] = abstract.get(a.get("val") if a is not None else None, {})
    out, path, n, tables, before = [], [], 0, 0, None

    def elements(x):
        for c in x:
            if c.tag in ("p", "tbl"):
                yield c
            elif c.tag in ("sdt", "sdtContent", "customXml", "ins", "smartTag"):
                yield from elements(c)

    for x in elements(body):
        if x.tag == "p":
            text = _paragraph(x)
            if not text:
                continue
            n += 1
            before = text if styles.caption(x) else None
            if (level := styles.level(x)) is not None:
                path = [p for p in path if p[0] < level] + [(level, text)]
                out.append(block("heading", text, n, n, [p[1] for p in path], level=level))
            elif (num := x.find("pPr/numPr/numId")) is not None and num.get("val") != "0":
                depth = x.find("pPr/numPr/ilvl")
                depth = depth.get("val", "0") if depth is not None else "0"
                bullet = ordered.get(num.get("val"), {}).get(depth) == "bullet"
                out.append(block("list_item", text, n, n, [p[1] for p in path], ordered=not bullet, depth=int(depth)))
            else:
                out.append(block("paragraph", text, n, n, [p[1] for p in path]))
            continue
        tables += 1
        rows = []
        for tr in x.findall("tr"):
            row = []
            for tc in tr.findall("tc"):
                span = tc.find("tcPr/gridSpan")
                row += [_cell(tc), *[""] * (int(span.get("val", "1")) - 1 if span is not None else 0)]
            rows.append(row)
        look = x.find("tblPr/tblLook")
        declared = bool(x.findall("tr")) and x.find("tr/trPr/tblHeader") is not None or look is not None and (look.get("firstRow") == "1" or int(look.get("val", "0"), 16) & 0x20 != 0)
        rows = [r for r in rows if any(r)]
        if not rows:
            continue
        names = rows[0]
        reliable = len(rows) > 1 and len(names) > 1 and all(c and len(c) <= 60 for c in names) and len(set(names)) == len(names)
        where = [p[1] for p in path]
        if len(rows) > 1 and (declared or reliable):
            title = f"Table {tables}" + (f" — {before}" if before else "") + f" ({', '.join(names)})"
            for k, r in enumerate(rows[1:], 1):
                fields = [{"name": names[j] if j < len(names) and names[j] else f"Column {j + 1}", "value": c} for j, c in enumerate(r)]
                out.append(block("record", "\n".join(f"{f['name']}: {f['value']}" for f in fields if f["value"]), k, k, [*where, title], fields=fields, table=tables))
        else:
            out.append(block("table", "\n".join(" | ".join(r) for r in rows), n, n, where, table=tables))
        before = None
    if not out:
        raise ParseError("empty")
    return _core(z), out


def serial_text(x: float, since_1904: bool = False) -> str | None:
    """A serial as a date, with hour and minute if it is not a whole day."""
    if not 0 <= x < 2_958_466:
        return None
    days, seconds = int(x), round((x - int(x)) * 86_400)
    try:
        day = (date(1904, 1, 1) if since_1904 else date(1899, 12, 30) if days > 60 else date(1899, 12, 31)) + timedelta(days)
    except OverflowError:  # the 1904 system ends after the year 9999
        return None
    return day.isoformat() + (f" {seconds // 3600 % 24:02}:{seconds // 60 % 60:02}" if seconds else "")


def _shows_date(code: str) -> bool:
    return bool(re.search("[dmyhs]", re.sub(r'\\.|_.|\*.|"[^"]*"|\[[^\]]*\]', "", code.lower())))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(data: bytes, most: int = MOST_ROWS) -> tuple[dict, list[dict], list[str]]:
    """(metadata, blocks, hidden sheets): a record per row of the visible sheets; header rows do not count."""
    z = opened(data, entry=ENTRY)
    main = _main(z)
    book, links = xml_root(_part(z, main)), _relations(z, main)
    by_kind = {kind: t for kind, t in links.values()}
    since_1904 = any(x.get("date1904") in ("1", "true") for x in book.iter("workbookPr"))
    shared = []
    if by_kind.get("sharedStrings") in z.namelist():
        for si in xml_root(_part(z, by_kind["sharedStrings"])).iter("si"):
            shared.append("".join(t.text or "" for run in [si, *si.findall("r")] for t in run.findall("t")))
    dates = set()
    if by_kind.get("styles") in z.namelist():
        s = xml_root(_part(z, by_kind["styles"]))
        custom = {f.get("numFmtId") for f in s.iter("numFmt") if _shows_date(f.get("formatCode", ""))}
        for x in s.iter("cellXfs"):
            dates = {str(k) for k, xf in enumerate(x.findall("xf")) if xf.get("numFmtId") in custom or int(xf.get("numFmtId", "0")) in DATE_FORMATS}
    out, hidden = [], []
    for index, sheet in enumerate(book.iter("sheet")):
        if sheet.get("state") in ("hidden", "veryHidden"):
            hidden.append(sheet.get("name", ""))
            continue
        target = links.get(sheet.get("id"), (None, None))[1]
        rows = []
        for r in xml_root(_part(z, target)).iter("row"):
            row: list[str] = []
            for c in r.findall("c"):
                k = _column(c.get("r", "")) if c.get("r") else len(row)
                row += [""] * (k + 1 - len(row))
                row[k] = _value(c, shared, dates, since_1904)
            rows.append((int(r.get("r", len(rows) + 1)), row))
        rows = [(n, r) for n, r in rows if any(r)]
        if not rows:
            continue
        header = header_of([r for _, r in rows[:50]])
        tables = [t for kind, t in _relations(z, target).values() if kind == "table" and t in z.namelist()]
        if tables:
            names, header = [c.get("name", "") for c in xml_root(_part(z, tables[0])).iter("tableColumn")], "confident"
        else:
            names = rows[0][1] if header != "absent" else []
        seen: dict[str, int] = {}
        unique = []
        for k, name in enumerate(names):
            name = name or f"Column {k + 1}"
            seen[name] = seen.get(name, 0) + 1
            unique.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
        for row, (_, r) in enumerate(rows[header != "absent" :], 1):
            if row > most:
                raise ParseError("too_large")
            fields = [{"name": unique[k] if k < len(unique) else f"Column {k + 1}", "value": c} for k, c in enumerate(r)]
            out.append(block("record", "\n".join([f"Record {row}", *(f"{f['name']}: {f['value']}" for f in fields if f["value"])]), row, row, [sheet.get("name", "")], fields=fields, sheet=index))
    if not out:
        raise ParseError("empty")
    return _core(z), out, hidden


def _value(c, shared: list[str], dates: set, since_1904: bool) -> str:
    kind, v = c.get("t", "n"), c.find("v")
    if kind == "inlineStr":
        return " ".join("".join(t.text or "" for t in c.iter("t")).split())
    raw = (v.text or "").strip() if v is not None else ""
    if not raw or kind == "e":
        return ""
    if kind == "s":
        return " ".join(shared[int(raw)].split()) if int(raw) < len(shared) else ""
    if kind == "b":
        return "yes" if raw == "1" else "no"
    if kind == "n":
        try:
            x = float(raw)
        except ValueError:
            return raw
        if c.get("s") in dates and (t := serial_text(x, since_1904)):
            return t
        return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)
    return raw
