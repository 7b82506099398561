"""Plain text, notes and Markdown as located blocks."""

from __future__ import annotations

import re

from .decode import ParseError

#: Characters beyond which a paragraph is split, and of its parts; characters of a note (fixed values).
LONG, PART, NOTE = 2000, 1000, 1_000_000


def block(kind: str, text: str, first: int, last: int, path=(), **more) -> dict:
    return {"path": list(path), "kind": kind, "text": text, "first": first, "last": last, **more}


def paragraphs(text: str, longest: int = LONG) -> list[dict]:
    """Runs of lines that are not blank, trimmed, located by characters [first, last). Those of more than *longest* characters
    are split at line breaks."""
    out = []
    for m in re.finditer(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*", text):
        lead = len(m[0]) - len(m[0].lstrip())
        body, at = m[0].strip(), m.start() + lead
        if len(body) <= longest:
            out.append(block("paragraph", body, at, at + len(body)))
            continue
        begin = 0
        while begin < len(body):
            stop = min(len(body), begin + PART)
            if stop < len(body):
                cut = body.rfind("\n", begin + 1, stop)
                if cut < 0:
                    cut = body.find("\n", stop)
                stop = cut if cut > 0 else len(body)
            piece = body[begin:stop]
            if piece.strip():
                lead = len(piece) - len(piece.lstrip())
                out.append(block("paragraph", piece.strip(), at + begin + lead, at + begin + lead + len(piece.strip())))
            begin = stop + 1
    if not out:
        raise ParseError("empty")
    return out


def cleaned_note(text: str, longest: int = NOTE) -> str:
    """Line ends unified, lines right-trimmed, at most one blank line in a row."""
    x = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    x = re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for line in x.split("\n"))).strip("\n")
    if not x.strip():
        raise ParseError("empty")
    if len(x) > longest:
        raise ParseError("too_large")
    return x


def note_title(text: str) -> str:
    """The first line if it is short and no sentence, else the first words."""
    line = next((x.strip() for x in text.split("\n") if x.strip()), "")
    if len(line) <= 80 and not line.endswith((".", "!", "?", ";", ",")):
        return line
    flat = " ".join(text.split())
    if len(flat) <= 60:
        return flat
    cut = flat[:60]
    return (cut[: cut.rfind(" ")] if " " in cut else cut).rstrip() + "…"


_FENCE, _HEAD = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^\s`]*)"), re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
_ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])\s+(?:\[[ xX]\]\s+)?(.*)$")
_INLINE = (
    (re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"<(https?://[^>]+)>"), r"\1"), (re.compile(r"</?[a-zA-Z][^>]*>"), ""),
    (re.compile(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1"), r"\2"), (re.compile(r"(?<![\w*])[*_](?=\S)(.+?)(?<=\S)[*_](?![\w*])"), r"\1"), (re.compile(r"`+([^`]+)`+"), r"\1"))


def inline(text: str) -> str:
    """The readable text of Markdown's inline marks."""
    for pattern, to in _INLINE:
        text = pattern.sub(to, text)
    return " ".join(text.split())


def _cells(line: str) -> list[str]:
    return [inline(c.replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def markdown(text: str) -> tuple[dict, list[dict]]:
    """(metadata, blocks) of Markdown: headings give paths; blocks are located by lines from 1. Raw HTML is ignored.

    Metadata comes from front matter (title, author, language); the title falls back to the first level-one heading.
    """
    lines, meta, out, path, k = text.split("\n"), {}, [], [], 0
    if lines and lines[0].strip() == "---" and (end := next((j for j in range(1, len(lines)) if lines[j].strip() in ("---", "...")), None)):
        for line in lines[1:end]:
            key, sep, value = line.partition(":")
            if sep and key.strip().lower() in ("title", "author", "language", "lang"):
                meta["language" if key.strip().lower() == "lang" else key.strip().lower()] = value.strip().strip("\"'")
        k = end + 1
    names = lambda: [p for _, p in path]
    while k < len(lines):
        line, first = lines[k], k + 1
        if not line.strip():
            k += 1
        elif m := _FENCE.match(line):
            body = []
            k += 1
            while k < len(lines) and not re.match(rf"^ {{0,3}}{m[1][0]}{{{len(m[1])},}}\s*$", lines[k]):
                body.append(lines[k])
                k += 1
            k += 1
            out.append(block("code", "\n".join(body), first, min(k, len(lines)), names(), language=m[2] or None))
        elif m := _HEAD.match(line):
            k += 1
            _heading(out, path, meta, len(m[1]), inline(m[2] or ""), first, first)
        elif k + 1 < len(lines) and re.match(r"^ {0,3}(=+|-+)\s*$", lines[k + 1]) and not _ITEM.match(line) and "|" not in line:
            _heading(out, path, meta, 1 if "=" in lines[k + 1] else 2, inline(line), first, first + 1)
            k += 2
        elif "|" in line and k + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[k + 1]):
            rows = [_cells(line)]
            k += 2
            while k < len(lines) and "|" in lines[k]:
                rows.append(_cells(lines[k]))
                k += 1
            out.append(block("table", "\n".join(" | ".join(r) for r in rows), first, k, names(), header=rows[0]))
        elif m := _ITEM.match(line):
            body = [m[3]]
            k += 1
            while k < len(lines) and lines[k].strip() and not _ITEM.match(lines[k]) and not _HEAD.match(lines[k]) and not _FENCE.match(lines[k]):
                body.append(lines[k].strip())
                k += 1
            out.append(block("list_item", inline(" ".join(body)), first, k, names(), ordered=m[2][0].isdigit(), depth=len(m[1].expandtabs(4)) // 2))
        elif re.match(r"^ {0,3}([-*_]\s*){3,}$", line):
            k += 1
        else:
            body = []
            while k < len(lines) and lines[k].strip() and not _HEAD.match(lines[k]) and not _FENCE.match(lines[k]) and not (body and _ITEM.match(lines[k])):
                body.append(re.sub(r"^\s*>\s?", "", lines[k]))
                k += 1
            if (readable := inline(" ".join(body))):
                out.append(block("paragraph", readable, first, k, names()))
    if not out:
        raise ParseError("empty")
    return meta, out


def _heading(out, path, meta, level, title, first, last) -> None:
    while path and path[-1][0] >= level:
        path.pop()
    path.append((level, title))
    if level == 1:
        meta.setdefault("title", title)
    out.append(block("heading", title, first, last, [p for _, p in path], level=level))
