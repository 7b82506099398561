"""Formats by name and bytes to text."""

from __future__ import annotations

import codecs
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

#: Extensions and media types of each format, the first media type being its own (fixed values).
FORMATS = {
    "pdf": (("pdf",), ("application/pdf",)),
    "markdown": (("md", "markdown"), ("text/markdown", "text/x-markdown")),
    "text": (("txt", "text"), ("text/plain",)),
    "csv": (("csv", "tsv"), ("text/csv", "text/tab-separated-values")),
    "epub": (("epub",), ("application/epub+zip",)),
    "docx": (("docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)),
    "xlsx": (("xlsx",), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",)),
    "note": ((), ("application/x-note",)),
}
#: Bytes of a text file at most.
MOST = 64 << 20


class ParseError(ValueError):
    """A file that cannot be read; ``kind`` is one of invalid, encoding, too_large, encrypted, drm, empty, unsupported."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


def format_of(path: Column, media_type: Column | None = None) -> Column:
    """The format of a file: by its declared media type (parameters ignored), else by its extension, in any case."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    media = F.lower(F.trim(F.split(media_type, ";")[0])) if media_type is not None else F.lit(None).cast("string")
    known = [F.when(media.isin(*types), F.lit(name)) for name, (_, types) in FORMATS.items()]
    known += [F.when(ext.isin(*exts), F.lit(name)) for name, (exts, _) in FORMATS.items() if exts]
    return F.coalesce(*known, F.lit("unsupported"))


def encoding_of(windows: Iterable[bytes]) -> tuple[str, int]:
    """(encoding, bytes of its mark) of a file that comes in windows of any size; a letter may lie on their border. Without a mark
    it is UTF-8 or, from the first byte on that is not, Windows-1252; with the mark of UTF-8 such a byte is an error."""
    head, mark, valid = b"", None, True
    check = codecs.getincrementaldecoder("utf-8")()
    for w in windows:
        if mark is None:
            head += w
            if len(head) < 3:
                continue
            w, mark = head, _mark(head)
        if mark.startswith("utf-16"):
            return mark, 2
        if mark == "" and b"\0" in w:
            raise ParseError("invalid", "binary data")
        if valid:
            try:
                check.decode(w)
            except UnicodeDecodeError:
                valid = False
                if mark:
                    raise ParseError("encoding") from None
    if mark is None:
        mark = _mark(head)
        if mark.startswith("utf-16"):
            return mark, 2
        if b"\0" in head:
            raise ParseError("invalid", "binary data")
    try:
        check.decode(b"" if head == b"" or len(head) >= 3 else head, True)
    except UnicodeDecodeError:
        valid = False
        if mark:
            raise ParseError("encoding") from None
    return ("utf-8" if valid else "cp1252"), 3 if mark else 0


def _mark(head: bytes) -> str:
    return "utf-8" if head.startswith(b"\xef\xbb\xbf") else {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(head[:2], "")


def decode(data: bytes, most: int = MOST) -> tuple[str, bool]:
    """Text with line ends ``\\n``, and whether the bytes had to be read as Windows-1252."""
    if len(data) > most:
        raise ParseError("too_large")
    encoding, mark = encoding_of([data])
    text = data[mark:].decode(encoding, "strict" if encoding == "utf-8" else "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n"), encoding == "cp1252"
