"""Around an answer: prompts from the conversation, outcomes, details of a source, text found on pages."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, functions as F

from ..functions import pytext as P, text as T
from . import conversations

#: Turns and characters that a rewritten question sees; characters of a free turn (fixed values).
TURNS, TURN_CHARS, FREE_CHARS = 3, 300, 1500
#: Places that a search in a document returns at most; the limit is part of the feature (fixed value).
MOST_FOUND = 500


def rewrite_prompts(messages: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows (conv_id, prompt): the last turns, cut and neutralized, before the follow-up *questions* (conv_id, question)."""
    h = conversations.history(messages, TURNS)
    cut = lambda c: f"left({T.neutralize(c)}, {TURN_CHARS})"
    h = h.select("conv_id", "position", F.expr(f"concat('User: ', {cut('question')}, '\n', 'Assistant: ', {cut('answer')}, '\n')").alias("turn"))
    h = h.groupBy("conv_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(position, turn))), x -> x.turn), '')").alias("turns"))
    return questions.join(h, "conv_id", "left").select("conv_id", F.expr(f"concat(coalesce(turns, ''), 'Follow-up: ', {T.neutralize('question')})").alias("prompt"))


def rewritten(reply: str, question: str) -> str:
    """SQL for the question to search with: the rewriting, unless it is empty or too long."""
    return f"if(trim(coalesce({reply}, '')) <> '' and char_length(trim({reply})) <= 400, trim({reply}), {question})"


def free_prompt(turns: list[tuple[str, str]], budget: int) -> list[tuple[str, str]]:
    """The turns (role, text) of a free chat that fit: each is cut, the oldest go first, the last always stays."""
    cut = [(role, text if len(text) <= FREE_CHARS else text[:FREE_CHARS] + "…") for role, text in turns]
    while len(cut) > 1 and sum(P.prompt_tokens(text) for _, text in cut) > budget:
        cut = cut[1:]
    return cut


def free_prompts(messages: DataFrame, budget: int = 3000) -> DataFrame:
    """Rows (conv_id, turns, tokens) of what a free chat sends. Dropping the oldest until the rest fits keeps the turns whose
    running sum from the end fits, so one window does it."""
    from pyspark.sql import Window

    t = messages.select("conv_id", "turn", "role", F.expr(f"if(char_length(text) > {FREE_CHARS}, concat(left(text, {FREE_CHARS}), '…'), coalesce(text, ''))").alias("text"))
    t = t.withColumn("tokens", F.expr(T.prompt_tokens("text")))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"))
    t = t.withColumn("used", F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("back", F.row_number().over(back))
    return t.where(f"used <= {budget} or back = 1").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"))


def message_status(outcome: str) -> str:
    """SQL for how a message is stored after an outcome."""
    return f"case {outcome} when 'answered' then 'complete' when 'not_found' then 'complete' when 'cancelled' then 'cancelled' when 'refused' then 'failed' else 'failed' end"


def source_details(documents: DataFrame, chunks: DataFrame, cited: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per document (document_id, name, title, format): title falls back to the name; chunks; conversations that cite
    it; sheets, for workbooks only. *cited* has (document_id, conversation_id)."""
    c = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    v = cited.groupBy("document_id").agg(F.count_distinct("conversation_id").alias("conversations"))
    s = sections.groupBy("document_id").agg(F.count(F.lit(1)).alias("sheets"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    t = documents.join(c, "document_id", "left").join(v, "document_id", "left").join(s, "document_id", "left")
    return t.select("document_id", F.coalesce("title", "name").alias("title"), zero("chunks"), zero("conversations"), F.when(F.col("format") == "xlsx", F.coalesce("sheets", F.lit(0).cast("long"))).alias("sheets"))


def import_summary(results: DataFrame) -> DataFrame:
    """Counts of a batch by what became of its files (decision)."""
    return results.agg(F.count_if(F.col("decision").isin("new", "updated", "retry")).alias("imported"), F.count_if(F.col("decision") == "duplicate").alias("duplicate"), F.count_if(F.col("decision") == "failed").alias("failed"))


def find(lines: list[str], needle: str) -> list[tuple[int, int, int]]:
    """Places (line, start, stop) of *needle*, without regard to case and accents, over line ends, where a hyphen does not
    count. A match over several lines gives a place in each; matches do not overlap."""
    flat, at = [], []
    for n, line in enumerate(lines):
        for k, c in enumerate(line):
            for d in unicodedata.normalize("NFD", c.lower()):
                if unicodedata.category(d) != "Mn":
                    flat.append(" " if d.isspace() else d)
                    at.append((n, k))
        if flat and flat[-1] == "-" and n + 1 < len(lines):
            flat.pop()
            at.pop()
        else:
            flat.append(" ")
            at.append((n, len(line)))
    want = "".join(d for d in unicodedata.normalize("NFD", " ".join(needle.lower().split())) if unicodedata.category(d) != "Mn")
    out: list[tuple[int, int, int]] = []
    if want:
        pattern = re.compile(r"\s+".join(map(re.escape, want.split(" "))))
        for m in pattern.finditer("".join(flat)):
            spots = [at[k] for k in range(m.start(), m.end())]
            for n in dict.fromkeys(s[0] for s in spots):
                ks = [k for row, k in spots if row == n and k < len(lines[n])]
                if ks:
                    out.append((n, min(ks), max(ks) + 1))
    return out


def found(pages: DataFrame, needle: str, most: int = MOST_FOUND) -> DataFrame:
    """Rows (document_id, page, line, start, stop) of *needle* in *pages* (document_id, page, text), the first *most* of each
    document."""
    from pyspark.sql import Window

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(d, p, *f) for d, p, x in zip(b["document_id"], b["page"], b["text"], strict=True) for f in find((x or "").split("\n"), needle)]
            yield pd.DataFrame(rows, columns=["document_id", "page", "line", "start", "stop"])

    hits = pages.select("document_id", "page", "text").mapInPandas(run, "document_id long, page int, line int, start int, stop int")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "line", "start"))
    return hits.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")
