"""Prompts from passages: token budget, order, numbering, blocks. A prompt is a fold over one question's passages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import labels, pytext as P, text as T

SOURCES = "query_id long, n int, rank int, document_id long, chunk_id long, content string, truncated boolean, reason string"
SYSTEM = "Answer from the numbered passages only, cite them as [n], and say that nothing was found if they do not hold the answer."


class Budget(NamedTuple):
    """Tokens of the model's window and their use (fixed values)."""

    context: int = 4096
    most: int = 3500
    answer: int = 700
    passage: int = 1200
    margin: float = 0.1


def passage_budget(question_tokens: str, budget: Budget = Budget(), fixed: int | None = None) -> Column:  # noqa: B008
    """Tokens left for passages: a fraction of the window that the rest leaves, truncated, at most ``most``."""
    fixed = P.prompt_tokens(SYSTEM) if fixed is None else fixed
    free = f"greatest(0, {budget.context} - {fixed + budget.answer} - {question_tokens})"
    return F.expr(f"cast(least({budget.most}, floor({free} * {1 - budget.margin}D)) as int)")


def block(n: int, p, content: str) -> str:
    where = f"pages {p.page_start}-{p.page_end}" if p.page_end > p.page_start else f"page {p.page_start}"
    section = f' section="{P.attribute(p.section)}"' if p.section else ""
    return f'<passage n="{n}" document="{p.document_id}" where="{where}"{section}>\n{content}\n</passage>\n'


def fold_sources(passages: list, budget: int, most: int) -> list[tuple]:
    """(n, rank, document, chunk, content, truncated, reason): kept passages are numbered in prompt order, dropped
    ones have a reason. A passage that does not fit is skipped; later, smaller ones may still fit."""
    kept, dropped, used = [], [], 0
    for p in passages:
        words = P.folded_words(p.content)
        if any(words == w for _, w, _, _ in kept):
            dropped.append((p, "duplicate"))
        elif any(k.document_id == p.document_id and P.contains_words(w, words) for k, w, _, _ in kept):
            dropped.append((p, "contained"))
        else:
            content, cut = P.shorten(P.neutralize(p.content), most)
            cost = P.prompt_tokens(block(0, p, content))
            if used + cost > budget:
                dropped.append((p, "budget"))
            else:
                used += cost
                kept.append((p, words, content, cut))
    first = {}
    for p, *_ in kept:
        first.setdefault(p.document_id, len(first))
    kept.sort(key=lambda k: (first[k[0].document_id], k[0].page_start, k[0].chunk_id))
    rows = [(n, p.rank, p.document_id, p.chunk_id, content, cut, None) for n, (p, _, content, cut) in enumerate(kept, 1)]
    return rows + [(None, p.rank, p.document_id, p.chunk_id, None, None, reason) for p, reason in dropped]


def sources(passages: DataFrame, budgets: DataFrame, most: int = Budget().passage) -> DataFrame:
    """SOURCES of each question. *budgets* has (query_id, budget); questions without one get the default."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("rank")
        rows = fold_sources(list(pdf.itertuples(index=False)), int(pdf["budget"].iloc[0]), most)
        out = pd.DataFrame([(pdf["query_id"].iloc[0], *r) for r in rows], columns=[x.strip().split(" ")[0] for x in SOURCES.split(",")])
        return out.astype({"n": "Int32", "truncated": "boolean"})

    t = passages.join(budgets, "query_id", "left").withColumn("budget", F.coalesce("budget", F.lit(Budget().most)))
    return t.groupBy("query_id").applyInPandas(run, SOURCES)


def fitted(sources: DataFrame, limit: int, retries: int = 4) -> DataFrame:
    """*sources* (query_id, n, score, tokens, base) with kept and fits: while the exact count, base plus the tokens of what is
    kept, is over *limit*, the source of the lowest score goes (ties: the first), at most *retries* times and never the last.
    fits: whether the prompt of the question is within the limit in the end; if not, it is an error and nothing is kept.
    """
    by = Window.partitionBy("query_id").orderBy("score", "n")
    all_ = Window.partitionBy("query_id")
    t = sources.withColumn("_k", F.row_number().over(by) - 1).withColumn("_total", F.col("base") + F.sum("tokens").over(all_))
    # what the count is once the sources before this one have gone
    t = t.withColumn("_left", F.col("_total") - F.coalesce(F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    enough = F.min(F.when((F.col("_left") <= limit) & (F.col("_k") <= retries), F.col("_k"))).over(all_)
    t = t.withColumn("_gone", enough).withColumn("fits", F.col("_gone").isNotNull())
    return t.withColumn("kept", F.col("fits") & (F.col("_k") >= F.col("_gone"))).drop("_k", "_total", "_left", "_gone")


def found(passages: DataFrame, least: float = 0.28) -> DataFrame:
    """Questions whose best passage is relevant enough to be asked at all."""
    return passages.groupBy("query_id").agg(F.max("score").alias("best")).select("query_id", (F.col("best") >= least).alias("answerable"))


def header(n: str, document: str, place: str, section: str) -> str:
    """SQL for the line above a numbered passage: pages and section for page formats, format and label of the place for others. *place* is
    a location as in ``functions.labels``."""
    quoted = lambda x: T.attribute(x)
    pages = f"if({place}.page_end > {place}.page_start, concat('pages ', {place}.page_start, '-', {place}.page_end), concat('page ', {place}.page_start))"
    paged = f"concat(' where=\"', {pages}, '\"', if(coalesce({section}, '') = '', '', concat(' section=\"', {quoted(section)}, '\"')))"
    other = f"concat(' type=\"', {place}.kind, '\" where=\"', {quoted(f"coalesce({labels.location_label(place)}, '')")}, '\"')"
    return f"concat('<passage n=\"', {n}, '\" document=\"', {quoted(document)}, '\"', if({place}.kind = 'pdf', {paged}, {other}), '>')"


def assembled(passages: DataFrame, questions: DataFrame, system: str = SYSTEM) -> DataFrame:
    """Rows (query_id, prompt): the whole prompt of each question (query_id, question): instructions, passages (query_id, n, header, content)
    by number, and the question, with what could pass for markup made harmless. A budget bounds the passages of a question before."""
    b = F.expr(f"concat(header, '\\n', {T.neutralize('content')}, '\\n</passage>\\n')")
    p = passages.select("query_id", "n", b.alias("block")).groupBy("query_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(n, block))), x -> x.block), '')").alias("blocks"))
    return questions.join(p, "query_id", "left").select("query_id", F.concat(F.lit(system + "\n\n"), F.coalesce("blocks", F.lit("")), F.lit("\nQuestion: "), F.expr(T.neutralize("question"))).alias("prompt"))
