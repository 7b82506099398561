"""XHTML chapters and EPUB books."""

from __future__ import annotations

import io
import posixpath
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

from .decode import ParseError
from .plain import block

#: Elements that are skipped with their content, that begin a block, and that never close (fixed values).
SKIPPED = {"script", "style", "head", "nav", "svg", "math"}
BLOCKS = {"p", "div", "section", "article", "aside", "header", "footer", "main", "figure", "figcaption", "blockquote", "address", "dl", "dt", "dd", "hr", "body", "form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: Entries of an archive, bytes of one and of all of them.
ENTRIES, ENTRY, ALL = 10_000, 32 << 20, 256 << 20


class _Chapter(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.kind, self.skip, self.lists = [], [], None, 0, []
        self.pre, self.language, self.tables, self.rows, self.head, self.cell = 0, None, 0, [], False, None

    def _flush(self) -> None:
        raw = "".join(self.text)
        self.text = []
        if self.pre:
            lines = [x.rstrip() for x in raw.split("\n")]
            body = "\n".join(lines).strip("\n")
        else:
            body = " ".join(raw.split())
        if body:
            kind = self.kind or (("code", {"language": self.language}) if self.pre else ("paragraph", {}))
            self.out.append((kind[0], body, kind[1]))
        self.kind = None

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in SKIPPED:
            self.skip += tag not in VOID
            return
        a = dict(attrs)
        if self.tables:
            if tag == "table":
                self.tables += 1
            elif self.tables == 1 and tag == "tr":
                self.rows.append([])
            elif self.tables == 1 and tag in ("td", "th"):
                self._cell()
                self.rows = self.rows or [[]]
                self.cell = []
                self.head |= tag == "th" and len(self.rows) == 1
            elif self.tables == 1 and tag == "thead":
                self.head = True
            elif tag == "br" and self.cell is not None:
                self.cell.append(" ")
        elif tag == "table":
            self._flush()
            self.tables, self.rows, self.head, self.cell = 1, [], False, None
        elif tag in HEADINGS:
            self._flush()
            self.kind = ("heading", {"level": HEADINGS[tag]})
        elif tag in ("ul", "ol"):
            self._flush()
            self.lists.append(tag == "ol")
        elif tag == "li":
            self._flush()
            self.kind = ("list_item", {"ordered": bool(self.lists and self.lists[-1]), "depth": max(0, len(self.lists) - 1)})
        elif tag == "pre":
            self._flush()
            self.pre, self.language = self.pre + 1, None
        elif tag == "code" and self.pre:
            self.language = next((c.split("-", 1)[1] for c in (a.get("class") or "").split() if c.startswith(("language-", "lang-"))), None)
        elif tag == "br":
            self.text.append("\n" if self.pre else " ")
        elif tag in BLOCKS:
            held = self.kind if self.kind and self.kind[0] == "list_item" and not "".join(self.text).strip() else None
            self._flush()
            self.kind = held

    def handle_startendtag(self, tag, attrs):
        if not self.skip and tag not in SKIPPED:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def _cell(self) -> None:
        if self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_endtag(self, tag):
        if self.skip:
            self.skip -= tag not in VOID
            return
        if self.tables:
            if tag == "table":
                self.tables -= 1
                if not self.tables:
                    self._table()
            elif self.tables == 1 and tag in ("td", "th"):
                self._cell()
        elif tag == "pre":
            self._flush()
            self.pre = max(0, self.pre - 1)
        elif tag in ("ul", "ol"):
            self._flush()
            if self.lists:
                self.lists.pop()
        elif tag in HEADINGS or tag == "li" or tag in BLOCKS:
            self._flush()

    def _table(self) -> None:
        self._cell()
        rows = [r for r in self.rows if any(r)]
        if rows:
            self.out.append(("table", "\n".join(" | ".join(r) for r in rows), {"header": rows[0] if self.head else None}))
        self.rows = []

    def handle_data(self, data):
        if not self.skip:
            (self.cell if self.tables and self.cell is not None else self.text if not self.tables else []).append(data)


def xhtml(text: str) -> list[dict]:
    """Typed blocks of a page or chapter, numbered from 1; headings give the paths of what follows."""
    p = _Chapter()
    p.feed(text)
    p.close()
    if p.tables:
        p._table()
    p._flush()
    out, path = [], []
    for n, (kind, body, more) in enumerate(p.out, 1):
        if kind == "heading":
            path = [x for x in path if x[0] < more["level"]] + [(more["level"], body)]
        out.append(block(kind, body, n, n, [x[1] for x in path], **more))
    return out


def opened(data: bytes, entries: int = ENTRIES, entry: int = ENTRY, whole: int = ALL) -> zipfile.ZipFile:
    """A zip archive within the limits; a compound file, as encrypted documents are, is refused."""
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ParseError("encrypted")
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise ParseError("invalid", "not an archive") from None
    sizes = [x.file_size for x in z.infolist()]
    if len(sizes) > entries or max(sizes, default=0) > entry or sum(sizes) > whole:
        raise ParseError("too_large")
    return z


def xml_root(data: bytes):
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise ParseError("invalid", str(e)) from None
    for x in root.iter():
        if isinstance(x.tag, str):
            x.tag = x.tag.rpartition("}")[2]
        x.attrib = {k.rpartition("}")[2]: v for k, v in x.attrib.items()}
    return root


def _part(z: zipfile.ZipFile, name: str) -> bytes:
    try:
        return z.read(name)
    except KeyError:
        raise ParseError("invalid", f"{name} is missing") from None


def resolved(base: str, href: str) -> str:
    """A link inside a package as the name of an entry."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.split("#")[0]))).lstrip("/")


def epub(data: bytes) -> tuple[dict, list[dict], list[int]]:
    """(metadata, blocks, skipped chapters). Chapters follow the spine without its navigation; chapter n's title is its
    root section: from the navigation, else its first heading, else its number. Blocks are located by chapter."""
    z = opened(data)
    names = set(z.namelist())
    if "META-INF/encryption.xml" in names:
        methods = {x.get("Algorithm", "") for x in xml_root(_part(z, "META-INF/encryption.xml")).iter("EncryptionMethod")}
        if any("font" not in m and "embedding" not in m for m in methods):
            raise ParseError("drm")
    root = next(iter(xml_root(_part(z, "META-INF/container.xml")).iter("rootfile")), None)
    if root is None:
        raise ParseError("invalid", "no package")
    opf = root.get("full-path", "")
    package = xml_root(_part(z, opf))
    first = lambda tag: next((" ".join("".join(x.itertext()).split()) for x in package.iter(tag) if "".join(x.itertext()).strip()), None)
    meta = {"title": first("title"), "author": first("creator"), "language": first("language"), "publisher": first("publisher")}
    items = {x.get("id"): x for x in package.iter("item")}
    titles = {}
    for x in items.values():
        if "nav" in (x.get("properties") or "").split() or x.get("media-type") == "application/x-dtbncx+xml":
            at = resolved(opf, x.get("href", ""))
            try:
                links = xml_root(_part(z, at))
            except ParseError:
                continue
            for a in links.iter("a"):
                titles.setdefault(resolved(at, a.get("href", "")), " ".join("".join(a.itertext()).split()))
            for point in links.iter("navPoint"):
                label, target = point.find("navLabel"), point.find("content")
                if label is not None and target is not None:
                    titles.setdefault(resolved(at, target.get("src", "")), " ".join("".join(label.itertext()).split()))
    out, skipped, n = [], [], 0
    for ref in package.iter("itemref"):
        x = items.get(ref.get("idref"))
        if x is None or "nav" in (x.get("properties") or "").split():
            continue
        n += 1
        name = resolved(opf, x.get("href", ""))
        try:
            raw = _part(z, name)
            xml_root(raw.replace(b"&nbsp;", b"&#160;"))
        except ParseError:
            skipped.append(n)
            continue
        blocks = xhtml(raw.decode("utf-8", "replace"))
        title = titles.get(name) or next((b["text"] for b in blocks if b["kind"] == "heading"), None) or f"Chapter {n}"
        for b in blocks:
            inner = [p for p in b["path"] if p != title]
            out.append({**b, "path": [title, *inner], "first": n, "last": n})
    if not out:
        raise ParseError("invalid" if skipped else "empty")
    return meta, out, skipped
