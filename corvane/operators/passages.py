"""From hits to passages: for each question, duplicates dropped, neighbours joined, near-duplicates dropped, the best
chosen, documents covered and grouped.

Search bounds the hits of a question (at most 100), and the steps depend on their order, so they run as one
fold for each question; exact duplicates, which do not, are also given as a grouping.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import pytext as P, text as T
from ..session import dealt

#: Chunks of a passage at most (fixed value).
MOST_JOINED = 3
#: Search results that may join the passages of a section (fixed value).
EXTRAS = 3
HITS = "query_id long, chunk_id long, document_id long, ordinal int, section string, page_start int, page_end int, text string, score double, semantic double, lexical double"
PASSAGES = (
    "query_id long, rank int, chunk_id long, document_id long, page_start int, page_end int, section string, content string, score double, chunk_ids array<long>, "
    "by_semantic boolean, by_lexical boolean, duplicates array<struct<document_id: long, chunk_id: long>>")


class Options(NamedTuple):
    """Defaults of the retriever (fixed values)."""

    top_k: int = 6
    min_score: float = 0.2
    max_per_document: int = 4
    near_duplicate: float = 0.8
    join_neighbours: bool = True
    cover_documents: bool = False

    def checked(self) -> Options:
        if not (1 <= self.top_k <= 100 and self.max_per_document >= 1 and 0 <= self.min_score <= 1 and 0 <= self.near_duplicate <= 1):
            raise ValueError("the options are out of range")
        return self

    @property
    def search_top_k(self) -> int:
        return min(max(3 * self.top_k, 20), 100)


@dataclass
class _Group:
    """Neighbouring hits in reading order, and what they stand for."""

    hits: list
    also: set = field(default_factory=set)

    @property
    def main(self):
        return max(self.hits, key=lambda h: (h.score, -h.chunk_id))

    @property
    def content(self) -> str:
        text = ""
        for h in self.hits:
            text = P.join_adjacent(text, h.text)
        return text

    def touches(self, h) -> bool:
        a, b = self.hits[0], self.hits[-1]
        return (a.document_id, a.section) == (h.document_id, h.section) and len(self.hits) < MOST_JOINED and h.ordinal in (a.ordinal - 1, b.ordinal + 1)

    def add(self, h) -> None:
        self.hits = [h, *self.hits] if h.ordinal < self.hits[0].ordinal else [*self.hits, h]


def _distinct(hits: list) -> list[_Group]:
    kept: dict[tuple, _Group] = {}
    for h in hits:
        key = tuple(P.folded_words(h.text))
        if key in kept:
            kept[key].also.add((h.document_id, h.chunk_id))
        else:
            kept[key] = _Group([h])
    return list(kept.values())


def _joined(groups: list[_Group]) -> list[_Group]:
    """Best hits first, each joins the first group that it touches."""
    out: list[_Group] = []
    for g in groups:
        target = next((o for o in out if o.touches(g.hits[0])), None)
        if target is None:
            out.append(_Group(list(g.hits), set(g.also)))
        else:
            target.add(g.hits[0])
            target.also |= g.also
    return out


def _different(groups: list[_Group], least: float) -> list[_Group]:
    """Best first, what repeats a kept one nearly, with the same numbers, is dropped."""
    kept: list[tuple[_Group, list, set]] = []
    for g in sorted(groups, key=lambda g: -g.main.score):
        w = P.folded_words(g.content)
        grams = P.trigrams(w)
        for better, words, others in kept:
            if len(grams & others) >= least * len(grams | others) and P.numbers(w) == P.numbers(words):
                better.also |= {(g.main.document_id, g.main.chunk_id)} | g.also
                break
        else:
            kept.append((g, w, grams))
    return [k[0] for k in kept]


def _chosen(groups: list[_Group], o: Options) -> list[_Group]:
    order = sorted((g for g in groups if g.main.score >= o.min_score), key=lambda g: (-g.main.score, -(-1.0 if g.main.semantic is None else g.main.semantic), g.main.chunk_id))
    seen: dict = {}
    allowed = []
    for g in order:
        d = g.main.document_id
        seen[d] = seen.get(d, 0) + 1
        if seen[d] <= o.max_per_document:
            allowed.append(g)
    top, rest = allowed[: o.top_k], allowed[o.top_k :]
    if o.cover_documents:
        for g in rest:
            documents = [t.main.document_id for t in top]
            if not any(h.lexical is not None for h in g.hits) or g.main.document_id in documents:
                continue
            spare = [k for k, d in enumerate(documents) if documents.count(d) > 1]
            if not spare:
                break
            del top[spare[-1]]
            at = next((k for k, t in enumerate(top) if t.main.score < g.main.score), len(top))
            top.insert(at, g)
    return top


def fold_passages(hits: list, options: Options) -> list[tuple]:
    """Rows of PASSAGES, without the question, from one question's hits, best first."""
    groups = _distinct(hits)
    if options.join_neighbours:
        groups = _joined(groups)
    out = []
    for rank, g in enumerate(_chosen(_different(groups, options.near_duplicate), options), 1):
        m, ids = g.main, [h.chunk_id for h in g.hits]
        out.append((
            rank, m.chunk_id, m.document_id, min(h.page_start for h in g.hits), max(h.page_end for h in g.hits), g.hits[0].section, g.content, m.score, ids,
            any(h.semantic is not None for h in g.hits), any(h.lexical is not None for h in g.hits), sorted(g.also)))
    return out


def passages(hits: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """PASSAGES of each question from its hits (HITS)."""
    o = options.checked()
    names = [x.strip().split(" ")[0] for x in HITS.split(",")]

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True]).astype(object)
        pdf = pdf.where(pdf.notna(), None)
        rows = [(pdf["query_id"].iloc[0], *r) for r in fold_passages(list(pdf.itertuples(index=False)), o)]
        columns = ["query_id", "rank", "chunk_id", "document_id", "page_start", "page_end", "section", "content", "score", "chunk_ids", "by_semantic", "by_lexical", "duplicates"]
        return pd.DataFrame([(*r[:-1], [{"document_id": d, "chunk_id": c} for d, c in r[-1]]) for r in rows], columns=columns)

    return dealt(hits.select(*names), "query_id").groupBy("query_id").applyInPandas(run, PASSAGES)


def exact_duplicates(hits: DataFrame) -> DataFrame:
    """For each question and content (folded words), the best hit and the others: an equivalence, so a grouping."""
    key = F.expr(f"array_join({T.folded_words('text')}, ' ')").alias("content_key")
    best = F.struct(F.col("score"), -F.col("chunk_id"))
    t = hits.select("query_id", "chunk_id", "score", key).groupBy("query_id", "content_key").agg(F.max_by("chunk_id", best).alias("kept"), F.sort_array(F.collect_list("chunk_id")).alias("all"))
    return t.select("query_id", "kept", F.expr("filter(all, x -> x <> kept)").alias("others"))


def grouped(p: DataFrame) -> DataFrame:
    """Documents of each question by their best passage, with passages in page order."""
    t = p.groupBy("query_id", "document_id").agg(F.max("score").alias("best_score"), F.min("rank").alias("first"), F.expr("transform(array_sort(collect_list(struct(page_start, chunk_id, rank))), x -> x.rank)").alias("ranks"))
    return t.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).drop("first")


def overview(chunks: DataFrame, budget: int = 3000) -> DataFrame:
    """What an overview of each document reads: the first chunk of each run of equal sections, in order, with the tokens that
    it may use: an equal share of the budget, from 120 to 600. *chunks*: document_id, ordinal, section, chunk_id."""
    from . import conversations

    first = conversations.first_of_runs(chunks, "document_id", "ordinal", "section")
    share = F.least(F.lit(600), F.greatest(F.lit(120), F.floor(F.lit(budget) / F.count(F.lit(1)).over(Window.partitionBy("document_id"))))).cast("int")
    return first.select("document_id", "ordinal", "section", "chunk_id", share.alias("tokens"), F.lit(1.0).alias("score"))


def of_section(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Structural passages for questions about a numbered section: runs of up to three consecutive chunks of a section that
    the label fits. *asked*: query_id, document_id, label."""
    from ..functions import intents
    from . import conversations

    t = chunks.join(asked, "document_id").where(F.expr(intents.section_matches("section", "label")))
    t = t.withColumn("_key", F.struct("query_id", "document_id"))
    t = conversations.groups_of(t, "_key", "ordinal", "section", MOST_JOINED)
    return t.groupBy("query_id", "document_id", "section", "island", "part").agg(
        F.min("ordinal").alias("ordinal"), F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids")).select("query_id", "document_id", "section", "ordinal", "chunk_ids", F.lit(1.0).alias("score"))


def with_extras(questions: DataFrame, sections: DataFrame, found: DataFrame, least: float = 0.28, most: int = EXTRAS) -> DataFrame:
    """Rows (query_id, chunk_ids, rank, kind): what answers a question about a section. The passages of the section (sections: query_id,
    ordinal, chunk_ids) come first (section), then the best *most* of the search (found: query_id, rank, score, chunk_ids) that are relevant
    and share no chunk with them (extra); a question without a section gets all that the search found (search)."""
    asked = questions.select("query_id").distinct()
    s = sections.join(asked, "query_id", "left_semi").select("query_id", "ordinal", "chunk_ids")
    own = s.select("query_id", "chunk_ids", F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal", "chunk_ids")).alias("rank"), F.lit("section").alias("kind"))
    f = found.join(asked, "query_id", "left_semi").select("query_id", "rank", "score", "chunk_ids")
    known = s.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("chunk_ids"))).alias("_known"))
    f = f.join(known, "query_id", "left").where(F.col("_known").isNull() | (F.col("score") >= least) & F.expr("not arrays_overlap(chunk_ids, _known)"))
    f = f.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_ids")))
    extra = F.col("_known").isNotNull()
    f = f.where(~extra | (F.col("_n") <= most)).select("query_id", "chunk_ids", F.when(extra, F.col("_n")).otherwise(F.col("rank")).alias("rank"), F.when(extra, "extra").otherwise("search").alias("kind"))
    return own.unionByName(f)
