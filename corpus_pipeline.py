"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Quality rules, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE. Each stage works on
all that its predecessor kept. All but the last return the columns of their input; the last adds the
tokens, their number and whether decoding gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import bpe, decontaminate, linededup, quality, simhash
from corvane.llm.common import written
from corvane.session import ship, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. In every stage null texts count as empty, rows that repeat others are treated like them, an empty
    table stays empty, long texts are read whole, and other columns, of whatever name, are carried along."""
    return quality.kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier one; documents with no line left go."""
    return linededup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a Jaccard similarity of 0.8 or more over five-word shingles, found by blocks of fingerprints."""
    ship(spark)
    return simhash.deduplicated_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, n_tokens and intact (names get underscores if they are taken)."""
    import public_tokenizers

    ship(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    t = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    t = bpe.encoded_and_decoded(t, ranks, pattern)
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("token_ids", "n_tokens", "intact"):
        while name in taken:
            name += "_"
        names.append(name)
    return t.select(
        "row.*", F.col("ids").alias(names[0]), F.size("ids").cast("long").alias(names[1]),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias(names[2]))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the pipeline (MinHash components, BPE); tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
