"""The text functions that ordered folds need, in Python; same results as the expressions in :mod:`text`."""

from __future__ import annotations

import math
import re
import unicodedata

from .text import ABBREVIATIONS, ACCENTED, PLAIN

_FOLD = str.maketrans(ACCENTED, PLAIN)


def fold(x: str) -> str:
    return x.lower().translate(_FOLD)


def folded_words(x: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in fold(x)).split()


def trigrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {" ".join(words)}


def numbers(words: list[str]) -> list[str]:
    return [w for w in words if re.search("[0-9]", w)]


def contains_words(outer: list[str], inner: list[str]) -> bool:
    return bool(inner) and f" {' '.join(inner)} " in f" {' '.join(outer)} "


def join_adjacent(first: str, second: str) -> str:
    a, b = first.split(), second.split()
    n = next((n for n in range(min(len(a), len(b)), 0, -1) if a[-n:] == b[:n]), 0)
    return "\n\n".join(x for x in (first.strip(), " ".join(b[n:])) if x)


def chunk_tokens(x: str) -> int:
    return max(math.ceil(4 * len(x.split()) / 3), math.ceil(len(x) / 4))


def prompt_tokens(x: str) -> int:
    return math.ceil(len(x) / 3)


def neutralize(x: str) -> str:
    x = x.replace("<", "‹").replace(">", "›")
    return "".join(c for c in x if c in "\n\t" or unicodedata.category(c) != "Cc")


def attribute(x: str) -> str:
    return " ".join(neutralize(x).replace('"', "'").split())


def shorten(x: str, most: int) -> tuple[str, bool]:
    """*x* within about *most* prompt tokens, cut after a sentence whose end lies in the second half of the cut's
    bytes, else at white space; and whether it was cut."""
    if prompt_tokens(x) <= most:
        return x, False
    cut = x[: max(0, most * 3 - 2)]
    half, at, end = len(cut.encode()) // 2, 0, None
    for k, c in enumerate(cut):
        if at >= half and c in ".!?;\n":
            end = k + 1
        at += len(c.encode())
    if end is None:
        end = next((k for k in range(len(cut) - 1, -1, -1) if cut[k].isspace()), len(cut))
    return cut[:end].rstrip() + " …", True


def sentences(x: str) -> list[str]:
    out, begin = [], 0
    for m in re.finditer(r"[.!?…](?=\s)", x):
        before = x[begin : m.start()].split()
        last = before[-1].lower() if before and not x[m.start() - 1].isspace() else ""
        if m[0] == "." and (len(last) == 1 and last.isalpha() or last in ABBREVIATIONS):
            continue
        out.append(x[begin : m.end()])
        begin = m.end()
    return [s.strip() for s in [*out, x[begin:]] if s.strip()]


def longest_fit(n: int, fits) -> int:
    """The largest k up to *n* with fits(k), where fits holds up to some k and then no more."""
    lo, hi = 0, 1
    while hi <= n and fits(hi):
        lo, hi = hi, hi * 2
    hi = min(hi, n + 1)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo


def pieces(parts: list[str], glue: str, most: int, split=None) -> list[str]:
    """*parts* joined by *glue* into pieces of at most *most* tokens; a single part beyond that is split by
    *split*, or stands alone."""
    out = []
    while parts:
        n = longest_fit(len(parts), lambda k: chunk_tokens(glue.join(parts[:k])) <= most)
        if n:
            out.append(glue.join(parts[:n]))
        else:
            n = 1
            out += split(parts[0], most) if split else [parts[0]]
        parts = parts[n:]
    return out


def split_characters(x: str, most: int) -> list[str]:
    n = max(1, most * 4)
    return [x[k : k + n] for k in range(0, len(x), n)]


def split_words(x: str, most: int) -> list[str]:
    return pieces(x.split(), " ", most, split_characters)


def split_lines(x: str, most: int) -> list[str]:
    return pieces([y for y in x.split("\n") if y.strip()], "\n", most, split_words)


def last_words(x: str, most: int) -> str:
    w = x.split()
    n = longest_fit(len(w), lambda k: chunk_tokens(" ".join(w[len(w) - k :])) <= most)
    return " ".join(w[len(w) - n :]) if n else ""


def nfc(x: str) -> str:
    return unicodedata.normalize("NFC", x)
