"""License scans by diagonal voting.

Every text's rolling word k-grams are joined with the places that they have in license templates. A match
of text place i and template place j votes for the diagonal i - j: a template that stands in a text gives many
votes on one diagonal, and inserted or missing words move the rest to a neighbour. Votes are counted per
diagonal, neighbouring diagonals merged, and the merged spans verified. Built-in functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import LOWER, UPPER, hot_join, written

#: Words of a k-gram, farthest neighbouring diagonal, least share of a template's k-grams in a span, and
#: longest span in template lengths.
GRAM, GAP, COVER, STRETCH = 2, 3, 0.7, 1.5
#: Template k-grams, of about 100 bytes each, that a broadcast may hold.
BROADCAST = 100_000


class Template(NamedTuple):
    """A base template is a phrase and counts wherever its words stand consecutively."""

    label: str
    base: bool
    words: str


#: Phrases, and wordings of well-known notices (fixed values).
TEMPLATES = (
    Template("gpl", True, "gnu general public license"),
    Template("apache", True, "apache license"),
    Template("cc-by", True, "cc by"),
    Template("mit", True, "mit license"),
    Template("gpl-3.0", False, "licensed under the gnu general public license version 3"),
    Template("gpl", False, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("apache-2.0", False, "licensed under the apache license version 2 0"),
    Template("apache-2.0", False, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("cc-by-nc-4.0", False, "licensed under cc by nc 4 0"),
    Template("cc-by-sa-4.0", False, "licensed under cc by sa 4 0"),
    Template("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    Template("isc", False, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("zlib", False, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    Template("unlicense", False, "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    Template("lgpl", False, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", False, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("all-rights-reserved", False, "all rights reserved"),
)


def words(t: str) -> str:
    """SQL for the words of a string expression: letters, digits and what is beyond ASCII, A-Z lower-cased."""
    return rf"array_remove(split(translate({t}, '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', -1), '')"


def grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Template k-grams with their places; its rows follow the templates only, not the texts. Up to
    BROADCAST of them are sent to every executor; beyond that the join shuffles."""
    rows = []
    for k, t in enumerate(templates):
        w = t.words.split()
        rows += [(k, t.label, t.base, len(w), len(w) - GRAM + 1, j, w[j : j + GRAM]) for j in range(len(w) - GRAM + 1)]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, template_words int, n_grams int, j int, gram array<string>")
    table = table.withColumn("h", _hash("gram", 0))
    return F.broadcast(table) if len(rows) <= BROADCAST else table


def _hash(array: str, at) -> F.Column:
    return F.expr("xxhash64(" + ", ".join(f"get({array}, {at} + {k})" for k in range(GRAM)) + ")")


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """All columns of *df* in a struct ``row``, then n_words, n_base, first_word, last_word, base_labels,
    labels, score and spans (label, start, words, score) of each row.

    What is found depends on the text alone, so hits are grouped by a 128-bit hash of the text: repeated
    rows and copies are counted once and share the result. Null and empty texts have no words and no label;
    an empty table gives no rows; other columns stay inside ``row`` and cannot clash. Equal spans of two templates
    are both listed. Long texts are read whole; only their k-grams travel. A text that most rows have is joined back by broadcast.
    """
    key = [F.expr("xxhash64(t)").alias("k1"), F.expr("xxhash64('copy', t)").alias("k2")]
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).select(*key, F.expr(words("t")).alias("w"))
    places = texts.where(f"size(w) >= {GRAM}").select("k1", "k2", "w", F.explode(F.expr(f"sequence(0, size(w) - {GRAM})")).alias("i"))
    places = places.select("k1", "k2", "i", _hash("w", "i").alias("h"), *[F.expr(f"get(w, i + {k})").alias(f"g{k}") for k in range(GRAM)])
    hits = places.join(grams(df.sparkSession, templates), "h").where(" and ".join(f"g{k} = get(gram, {k})" for k in range(GRAM)))
    votes = hits.groupBy("k1", "k2", "template", "label", "base", "template_words", "n_grams", F.expr("i - j").alias("diagonal")).agg(F.collect_set("j").alias("js"), F.count(F.lit(1)).alias("hits"))
    votes = written(votes, "votes")  # read twice below, and far smaller than the texts
    exact = votes.where("base and size(js) = n_grams").select(
        "k1", "k2", "label", "base", F.col("diagonal").alias("start"), F.col("template_words").alias("size"), F.lit(1.0).alias("score"))
    # neighbouring diagonals of the other templates become one span
    by = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    loose = votes.where("not base").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > GAP).cast("int"), F.lit(1)))
    loose = loose.withColumn("island", F.sum("new").over(by)).groupBy("k1", "k2", "template", "label", "template_words", "n_grams", "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("js")))).alias("n"), F.min(F.expr("diagonal + array_min(js)")).alias("start"),
        F.max(F.expr("diagonal + array_max(js)")).alias("stop"),
        F.collect_list(F.expr("struct(size(js) as n, diagonal + array_min(js) as start, diagonal + array_max(js) as stop)")).alias("lines"))
    spread = f"n >= {COVER}D * n_grams and stop - start + {GRAM} <= {STRETCH}D * template_words"
    # copies back to back make one island that is too long for a span: each diagonal that reaches COVER is one then
    loose = loose.select("*", F.expr(f"inline(if({spread}, array(struct(n, start, stop)), transform(filter(lines, x -> x.n >= {COVER}D * n_grams), x -> struct(x.n, x.start, x.stop))))").alias("n_", "start_", "stop_"))
    loose = loose.select("k1", "k2", "label", "template_words", "n_grams", F.col("n_").alias("n"), F.col("start_").alias("start"), F.col("stop_").alias("stop"))
    loose = loose.select(
        "k1", "k2", "label", F.lit(False).alias("base"), "start", F.expr(f"stop - start + {GRAM}").alias("size"), F.expr("n / cast(n_grams as double)").alias("score"))
    # a place of a template has one hit on a diagonal in each row that has the text
    times = votes.groupBy("k1", "k2").agg(F.max(F.expr("hits div size(js)")).alias("times"))
    found = exact.union(loose).groupBy("k1", "k2").agg(
        F.count_if("base").alias("n_base"), F.min(F.expr("if(base, start, null)")).cast("long").alias("first_word"), F.max(F.expr("if(base, start, null)")).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.expr("if(base, label, null)"))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", F.col("size").alias("words"), "label", "score"))).alias("spans"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    hashable = [F.col(f"row.`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = rows.select("row", *key, F.expr(f"size({words('t')})").cast("long").alias("n_words"), F.xxhash64(*hashable).alias("spread"))
    found = written(found.join(times, ["k1", "k2"]), "found")
    return hot_join(rows, found, ["k1", "k2"], "times", F.col("spread")).select(
        "row", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans")


SQL = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
t(template, label, base, w) as (values {", ".join(f"({k}, '{t.label}', {t.base}, string_split('{t.words}', ' '))" for k, t in enumerate(TEMPLATES))}),
tg as (select template, label, base, len(w) template_words, len(w) - 1 n_grams, j, w[j] || ' ' || w[j + 1] g from (select *, unnest(range(1, len(w))) j from t)),
dg as (select doc_id, i, w[i] || ' ' || w[i + 1] g from (select *, unnest(range(1, len(w))) i from d)),
hits as (select doc_id, template, label, base, template_words, n_grams, i - j diagonal, j from dg join tg using (g)),
votes as (select doc_id, template, label, base, template_words, n_grams, diagonal, count(distinct j) n, min(j) lo, max(j) hi from hits group by all),
exact as (select doc_id, label, base, diagonal::bigint as start, 1.0::double as score from votes where base and n = n_grams),
marked as (
  select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= {GAP} then 0 else 1 end new from votes where not base),
islands as (select *, sum(new) over (partition by doc_id, template order by diagonal) island from marked),
merged as (
  select doc_id, template, label, template_words, n_grams, island, count(distinct j) n, min(diagonal + j) lo, max(diagonal + j) hi
  from islands join hits using (doc_id, template, label, template_words, n_grams, diagonal) group by all),
found as (
  select * from exact union all
  select doc_id, label, false, lo, n / n_grams::double from merged where n >= {COVER}::double * n_grams and hi - lo + {GRAM} <= {STRETCH}::double * template_words),
per as (
  select doc_id, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word,
         string_agg(distinct label, ',' order by label) filter (base) base_labels, string_agg(distinct label, ',' order by label) labels, max(score) score
  from found group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join per using (doc_id)
"""
