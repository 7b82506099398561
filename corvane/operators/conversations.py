"""Conversations: histories, questions and answers, runs of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def pairs(messages: DataFrame) -> DataFrame:
    """Rows (conversation, question turn, answer turn, texts): each answer with the user turn right before it."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = messages.select("conv_id", "turn", "role", "text", F.lag("role").over(by).alias("p_role"), F.lag("turn").over(by).alias("p_turn"), F.lag("text").over(by).alias("p_text"))
    return t.where("role = 'assistant' and p_role = 'user'").select("conv_id", F.col("p_turn").alias("question_turn"), F.col("turn").alias("answer_turn"), F.col("p_text").alias("question"), F.col("text").alias("answer"))


def history(messages: DataFrame, most: int = 3) -> DataFrame:
    """The last *most* answered questions of each conversation, oldest first, numbered from 1."""
    p = pairs(messages)
    back = Window.partitionBy("conv_id").orderBy(F.desc("answer_turn"))
    p = p.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= most)
    return p.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("answer_turn"))).drop("_back")


def runs(t: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """*t* with run: the number, from 1, of the stretch of equal *kind* (null equals null) that a row belongs to."""
    w = Window.partitionBy(by).orderBy(order)
    change = F.when(F.row_number().over(w) == 1, 1).when(F.lag(kind).over(w).eqNullSafe(F.col(kind)), 0).otherwise(1)
    return t.withColumn("_change", change).withColumn("run", F.sum("_change").over(w)).drop("_change")


def first_of_runs(t: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """The first row of each run: what an overview of a document reads."""
    r = runs(t, by, order, kind)
    return r.withColumn("_n", F.row_number().over(Window.partitionBy(by, "run").orderBy(order))).where("_n = 1").drop("_n")


def groups_of(t: DataFrame, by: str, order: str, kind: str, most: int = 3) -> DataFrame:
    """Runs of consecutive numbers within a kind, cut after *most*: t with island and part. Partitions of *t* dealt by *by* stay."""
    w = Window.partitionBy(by, kind).orderBy(order)
    t = t.withColumn("island", F.col(order) - F.row_number().over(w))
    n = F.row_number().over(Window.partitionBy(by, kind, "island").orderBy(order))
    return t.withColumn("part", F.floor((n - 1) / most).cast("int"))


def last_cited(citations: DataFrame) -> DataFrame:
    """For each conversation, the document that its latest citing answer cites, if it is just one: repeats side by
    side count once, so A, A is one and A, B, A is several. *citations*: conv_id, turn, ordinal, document."""
    latest = citations.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("ordinal", "document"))).alias("c"))
    latest = latest.groupBy("conv_id").agg(F.max_by("c", "turn").alias("c"))
    latest = latest.withColumn("d", F.expr("transform(filter(c, (x, i) -> i = 0 or get(c, i - 1).document <> x.document), x -> x.document)"))
    return latest.where("size(d) = 1").select("conv_id", F.expr("d[0]").alias("document"))


def finished(messages: DataFrame, citations: DataFrame, answers: DataFrame, sources: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, citations) after *answers* (message_id, text, status): these messages say so, and their citations are those of
    *sources* (message_id, ordinal, chunk_id), whose chunk is null if it is none of *chunks*. Citations of other messages stay."""
    new = answers.select("message_id", F.col("text").alias("_text"), F.col("status").alias("_status"), F.lit(True).alias("_done"))
    m = messages.join(new, "message_id", "left")
    m = m.withColumn("text", F.when(F.col("_done"), F.col("_text")).otherwise(F.col("text"))).withColumn("status", F.when(F.col("_done"), F.col("_status")).otherwise(F.col("status")))
    told = sources.join(answers.select("message_id").distinct(), "message_id", "left_semi")
    there = chunks.select("chunk_id").distinct().withColumn("_there", F.lit(True))
    told = told.join(there, "chunk_id", "left").withColumn("chunk_id", F.when(F.col("_there"), F.col("chunk_id"))).select(*citations.columns)
    return m.select(*messages.columns), citations.join(answers.select("message_id").distinct(), "message_id", "left_anti").select(*citations.columns).union(told)


def reset(messages: DataFrame, citations: DataFrame, which: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, citations): the answers in *which* (message_id) wait again, empty and without citations; questions cannot be reset."""
    again = messages.where("role = 'assistant'").join(which.select("message_id").distinct(), "message_id", "left_semi").select("message_id").withColumn("_again", F.lit(True))
    m = messages.join(again, "message_id", "left")
    m = m.withColumn("text", F.when(F.col("_again"), "").otherwise(F.col("text"))).withColumn("status", F.when(F.col("_again"), "streaming").otherwise(F.col("status")))
    return m.select(*messages.columns), citations.join(again, "message_id", "left_anti").select(*citations.columns)


def touched(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """*conversations* (conversation_id, updated_at) with the time of their latest message (created_at), if that is later."""
    last = messages.groupBy("conversation_id").agg(F.max("created_at").alias("_last"))
    t = conversations.join(last, "conversation_id", "left")
    return t.withColumn("updated_at", F.greatest("updated_at", "_last")).select(*conversations.columns)


def asked(messages: DataFrame, questions: DataFrame) -> DataFrame:
    """*messages* (conv_id, turn, role, text) with status, after *questions* (conv_id, question): each adds what the user says, trimmed,
    and an answer that waits. A blank question adds nothing. Of several for a conversation the least counts."""
    q = questions.select("conv_id", F.trim("question").alias("text")).where("text <> ''").groupBy("conv_id").agg(F.min("text").alias("text"))
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    new = q.join(last, "conv_id", "left").select("conv_id", F.explode(F.expr(
        "array(struct(coalesce(last, -1) + 1 as turn, 'user' as role, text as text, 'answered' as status), struct(coalesce(last, -1) + 2 as turn, 'assistant' as role, '' as text, 'streaming' as status))")).alias("m"))
    return messages.select("conv_id", "turn", "role", "text", F.lit("answered").alias("status")).union(new.select("conv_id", F.col("m.turn").cast(messages.schema["turn"].dataType), "m.role", "m.text", "m.status"))


def pending(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, question): the answers that wait, each with the latest question before it; without one there is none."""
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    question = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(by)
    t = messages.select("conv_id", "turn", "role", "status", question.alias("question"))
    return t.where("role = 'assistant' and status = 'streaming' and question is not null").select("conv_id", "turn", "question")
