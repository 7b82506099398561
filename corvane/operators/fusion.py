"""Weighted fusion of semantic and lexical candidates."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window, functions as F


class Options(NamedTuple):
    """What a search may ask for; checked before anything is planned."""

    semantic_weight: float = 0.6
    lexical_weight: float = 0.4
    top_k: int = 8
    page_from: int | None = None
    page_to: int | None = None

    def checked(self) -> Options:
        weights = self.semantic_weight, self.lexical_weight
        if not all(math.isfinite(w) and w >= 0 for w in weights) or not any(weights):
            raise ValueError("weights must be finite, not negative, and not both zero")
        if not 1 <= self.top_k <= 100:
            raise ValueError("top_k must be from 1 to 100")
        if self.page_from is not None and (self.page_from < 1 or (self.page_to or self.page_from) < self.page_from):
            raise ValueError("the page range is not valid")
        return self

    @property
    def candidates(self) -> int:
        """What each mechanism fetches before fusion."""
        return max(4 * self.top_k, 20)


def fuse(semantic: DataFrame, lexical: DataFrame, options: Options = Options(), digits: int = 6) -> DataFrame:  # noqa: B008
    """Rows (query_id, chunk_id, semantic, lexical, score, rank), the top_k of each question.

    *semantic* has (query_id, chunk_id, similarity), *lexical* (query_id, chunk_id, bm25, coverage or null). The semantic
    part is the cosine within 0 and 1; the lexical part is -bm25, min-max over the question's candidates (1 if
    all are equal), times the coverage squared. Ties: higher semantic part, then lower id.
    """
    o = options.checked()
    of = Window.partitionBy("query_id")
    spread = F.max(-F.col("bm25")).over(of) - F.min(-F.col("bm25")).over(of)
    part = F.when(spread > 2.220446049250313e-16, (-F.col("bm25") - F.min(-F.col("bm25")).over(of)) / spread).otherwise(F.lit(1.0))
    seen = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("coverage", F.lit(1.0))))
    lex = lexical.select("query_id", "chunk_id", (part * seen * seen).alias("lexical"))
    sem = semantic.select("query_id", "chunk_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))).alias("semantic"))
    both = sem.join(lex, ["query_id", "chunk_id"], "full_outer")
    total = o.semantic_weight + o.lexical_weight
    score = (F.lit(o.semantic_weight) * F.coalesce("semantic", F.lit(0.0)) + F.lit(o.lexical_weight) * F.coalesce("lexical", F.lit(0.0))) / F.lit(total)
    both = both.select("query_id", "chunk_id", F.round("semantic", digits).alias("semantic"), F.round("lexical", digits).alias("lexical"), F.round(score, digits).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce("semantic", F.lit(-1.0))), "chunk_id")
    return both.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= o.top_k)


class Retrieved(NamedTuple):
    """What a search gives: hits (None if nothing was searched), its mode, and what went wrong on the way."""

    hits: DataFrame | None
    mode: str
    warnings: tuple[str, ...]


def retrieve(semantic: Callable[[], DataFrame], lexical: Callable[[], DataFrame], options: Options = Options()) -> Retrieved:  # noqa: B008
    """Fused hits of both mechanisms, or of the one that works. A mechanism of weight zero is skipped; one that cannot be
    planned, say because its table is missing, counts with weight zero and a warning. If none is left, that is an error,
    unless both were only skipped or empty."""
    o = options.checked()
    found, warnings = {}, []
    for name, weight, make in (("semantic", o.semantic_weight, semantic), ("lexical", o.lexical_weight, lexical)):
        if weight > 0:
            try:
                found[name] = make()
            except (PySparkException, OSError) as e:
                warnings.append(f"{name} search failed: {type(e).__name__}")
    if not found:
        raise RuntimeError("; ".join(warnings))
    some = next(iter(found.values()))
    none = some.sparkSession.createDataFrame([], "query_id long, chunk_id long, similarity double, bm25 double, coverage double")
    used = o._replace(semantic_weight=o.semantic_weight if "semantic" in found else 0.0, lexical_weight=o.lexical_weight if "lexical" in found else 0.0)
    return Retrieved(fuse(found.get("semantic", none), found.get("lexical", none), used), "hybrid" if len(found) == 2 else next(iter(found)), tuple(warnings))
