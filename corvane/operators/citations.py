"""Citations in answers: groups such as [1], [1, 3], [2-4], page references such as [page 7], and what they point to."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import pytext as P
from ..session import through

#: Numbers of a group at most, and words that begin a page reference (fixed values).
MOST = 10
PAGE_WORDS = ("pagina", "pag", "p", "pp", "page", "pg")
RESOLVED = (
    "answer_id long, cleaned string, cited array<struct<n: int, start: int, stop: int>>, invalid array<int>, "
    "pages array<struct<page: int, document_id: long, n: int, start: int, stop: int>>, unresolved_pages array<int>, not_found boolean")


def group_numbers(inner: str) -> list[int] | None:
    """Numbers of a citation group in order, each once; None if it is no group."""
    numbers: list[int] = []
    for part in re.split("[,;]", inner):
        ends = [x.strip() for x in re.split("[-–—]", part.strip())]
        if len(ends) > 2 or not all(re.fullmatch(r"\+?[0-9]+", x) for x in ends):
            return None
        lo, hi = int(ends[0]), int(ends[-1])
        if hi < lo or hi - lo >= MOST or len(numbers) + hi - lo + 1 > MOST:
            return None
        numbers += range(lo, hi + 1)
    return list(dict.fromkeys(numbers))


def page_number(inner: str) -> int | None:
    m = re.fullmatch(r"([a-z]+)[ .][. ]*([0-9]+)", P.fold(inner.strip()))
    return int(m[2]) if m and m[1] in PAGE_WORDS and int(m[2]) >= 1 else None


def resolve(answer: str, sources: list, not_found: str = "I did not find this information") -> tuple:
    """(cleaned, cited, invalid, pages, unresolved_pages, not_found). *sources*: (document, page_start, page_end, paged)
    in the order of their numbers. Spans are byte ranges in the cleaned text."""
    out, size, cited, invalid, pages, unresolved = [], 0, [], set(), [], []

    def put(x: str) -> tuple[int, int]:
        nonlocal size
        out.append(x)
        size += len(x.encode())
        return size - len(x.encode()), size

    rest = answer
    while (m := re.search(r"\[", rest)) and (close := rest.find("]", m.start())) >= 0:
        before, inner, after = rest[: m.start()], rest[m.start() + 1 : close], rest[close + 1 :]
        if (page := page_number(inner)) is not None:
            put(before)
            holder = next(((k, s) for k, s in enumerate(sources, 1) if s[3] and s[1] <= page <= s[2]), None)
            alone = sources and sources[0][3] and len({s[0] for s in sources}) == 1
            if holder or alone:
                pages.append((page, holder[1][0] if holder else sources[0][0], holder[0] if holder else None, *put(f"[page {page}]")))
            else:
                unresolved.append(page)
                put(f"page {page}")
            rest = after
        elif (numbers := group_numbers(inner)) is None:
            put(before + "[")
            rest = rest[m.start() + 1 :]
        else:
            good = [n for n in numbers if 1 <= n <= len(sources)]
            invalid |= set(numbers) - set(good)
            if good:
                put(before)
                cited += [(n, *put(f"[{n}]")) for n in good]
            else:
                kept = before.rstrip(" ")
                put(kept)
            rest = after
    put(rest)
    text = "".join(out)
    lead = len(text.encode()) - len(text.lstrip().encode())
    key = " ".join(P.folded_words(not_found)[:4])
    move = lambda rows: [(*r[:-2], r[-2] - lead, r[-1] - lead) for r in rows]
    return text.strip(), move(cited), sorted(invalid), move(pages), unresolved, key in " ".join(P.folded_words(text))


def resolved(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """RESOLVED for each row of *answers* (answer_id, answer). *sources*: answer_id, n, document_id, page_start, page_end,
    paged. The sources of an answer fit a prompt, so they travel as one array beside it."""
    s = sources.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("n", "document_id", "page_start", "page_end", "paged"))).alias("sources"))
    t = answers.select("answer_id", "answer").join(s, "answer_id", "left")

    def fold(rows):
        out = []
        for r in rows:
            listed = [(x["document_id"], x["page_start"], x["page_end"], x["paged"]) for x in r["sources"] or ()]
            text, cited, invalid, pages, left, none = resolve(r["answer"] or "", listed)
            cited = [dict(zip(("n", "start", "stop"), c, strict=True)) for c in cited]
            pages = [dict(zip(("page", "document_id", "n", "start", "stop"), p, strict=True)) for p in pages]
            out.append((r["answer_id"], text, cited, invalid, pages, left, none))
        return out

    return through(t, fold, RESOLVED)


def cited_documents(resolved_answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct pages of each cited document of an answer, paged formats only."""
    c = resolved_answers.select("answer_id", F.explode("cited.n").alias("n")).distinct().join(sources, ["answer_id", "n"])
    p = c.withColumn("page", F.explode_outer(F.expr("if(paged, sequence(page_start, page_end), null)")))
    return p.groupBy("answer_id", "document_id").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def answer_status(cancelled: str, not_found: str, n_cited: str) -> str:
    """SQL for the outcome: cancelled before not found before answered, and whether it is grounded."""
    return f"case when {cancelled} then 'cancelled' when {not_found} then 'not_found' when {n_cited} = 0 then 'answered_ungrounded' else 'answered' end"


def answer_warnings(dropped: str, truncated: str, invalid: str, cut: str, unresolved: str, status: str, grounded: str) -> str:
    """SQL for the warnings of an answer, an array in the order in which they arise: passages left out for the budget, passages cut,
    citations of no passage (*invalid*, an array of numbers), an answer that the limit cut, pages of no document, and an answer that cites nothing."""
    numbers = f"array_join(transform({invalid}, n -> concat('[', n, ']')), ', ')"
    found = (
        (dropped, "'some passages did not fit'"), (truncated, "'long passages were shortened'"), (f"size({invalid}) > 0", f"concat('citations of no passage removed: ', {numbers})"),
        (cut, "'the answer was cut at the limit'"), (unresolved, "'page references of no document'"), (f"{status} = 'answered' and not {grounded}", "'the answer cites no passage'"))
    return "filter(array(" + ", ".join(f"if({test}, {text}, null)" for test, text in found) + "), w -> w is not null)"


def stored_sources(sources: DataFrame, cited: DataFrame) -> DataFrame:
    """*sources* (answer_id, n and more) with cited: whether the answer cites that number. *cited* has (answer_id, n); an answer that no
    model gave keeps its sources, none of them cited."""
    return sources.join(cited.select("answer_id", "n").distinct().withColumn("cited", F.lit(True)), ["answer_id", "n"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
