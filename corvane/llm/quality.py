"""Quality rules: a table of thresholds, compiled into one Spark projection over whole texts.

Every measure is a built-in function; rows never leave the JVM and nothing is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

#: Frequent function words of the languages served (fixed values).
STOP_WORDS = (
    "a all also an and are as at be but by for from had has have he her his i in is it its not of on or she that "
    "the their they this to was we were which who will with you "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich "
    "im in ist mit nach nicht noch oder sein sich sie sind so über um und vom von vor war werden wie wir zu zum zur "
    "à au aux avec ce cette ces dans de des du elle en est et être il ils je la le les leur lui mais ne nous on ou où "
    "par pas plus pour qu que qui sa se ses si son sont sur un une vous y "
    "al como con cuando de del desde el ella en entre era es esta este fue ha hay la las le lo los más me muy no nos o "
    "para pero por que se ser si sin sobre son su sus también un una uno ya yo"
).split()


class Rule(NamedTuple):
    """A text passes if ``low <= measure <= high``; a bound of None is open."""

    name: str
    measure: str
    low: float | None
    high: float | None


#: Measures that rules can use, as SQL over the columns of :func:`_measured`. A text without words
#: has ratios of zero.
MEASURES = {
    "words": "n_words",
    "mean_word_length": "coalesce(try_divide(word_chars, n_words), 0D)",
    "symbols_per_word": "coalesce(try_divide(n_symbols, n_words), 0D)",
    "marks_per_word": "coalesce(try_divide(n_marks, n_words), 0D)",
    "stop_word_ratio": "coalesce(try_divide(n_stop_words, n_words), 0D)",
    "duplicate_line_ratio": "coalesce(try_divide(n_dup_lines, n_lines), 0D)",
    "cut_line_ratio": "coalesce(try_divide(n_cut_lines, n_lines), 0D)",
    "bullet_line_ratio": "coalesce(try_divide(n_bullet_lines, n_lines), 0D)",
}

#: Thresholds of the default verdict: length, symbols, stop words and lines.
RULES = (
    Rule("length", "words", 50, None),
    Rule("word length", "mean_word_length", 2.0, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("marks", "marks_per_word", None, 0.5),
    Rule("stop words", "stop_word_ratio", 0.005, None),
    Rule("repeated lines", "duplicate_line_ratio", None, 0.5),
    Rule("cut lines", "cut_line_ratio", None, 0.3),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
)


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a measured row breaks, as one array expression."""
    broken = []
    for r in rules:
        value, bounds = f"({MEASURES[r.measure]})", []
        if r.low is not None:
            bounds.append(f"{value} < {float(r.low)}D")
        if r.high is not None:
            bounds.append(f"{value} > {float(r.high)}D")
        broken.append(F.when(F.expr(" or ".join(bounds) or "false"), F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.expr("cast(array() as array<string>)")


def _measured(df: DataFrame, text: str, keep: str) -> DataFrame:
    """Counts of every text; *keep* is a struct column that is carried along."""
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    t = df.select(keep, F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select(
        keep, "t",
        F.expr(r"array_remove(split(t, '[\\x20\\x09-\\x0D]+', -1), '')").alias("w"),
        F.expr(r"filter(split(t, '\n', -1), x -> trim(both ' \t\n\u000b\u000c\r' from x) <> '')").alias("lines"),
    )
    # three-word windows as (hash, place), sorted: equal windows become neighbours
    t = t.select("*", F.expr(
        "if(size(w) < 3, cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform("
        "sequence(0, greatest(size(w) - 3, 0)), i -> struct(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) as h, i as i))))").alias("s"))
    t = t.select("*", F.expr(
        "sort_array(transform(filter(s, (x, k) -> get(s, k - 1).h <=> x.h or get(s, k + 1).h <=> x.h), x -> x.i))").alias("p"))
    return t.select(
        keep,
        F.size("w").cast("long").alias("n_words"),
        F.expr("cast(length(array_join(w, '')) as bigint)").alias("word_chars"),
        F.expr("cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(length(t) - length(translate(t, '!?', '')) as bigint)").alias("n_marks"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr("aggregate(p, 0L, (n, x) -> n + 3L) - aggregate(transform(p, (x, k) -> "
               "greatest(3 - coalesce(get(p, k + 1) - x, 3), 0)), 0L, (n, x) -> n + x)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr(r"cast(size(filter(lines, x -> rtrim(x) like '%...' or rtrim(x) like '%…')) as bigint)").alias("n_cut_lines"),
        F.expr(r"cast(size(filter(lines, x -> ltrim(x) like '- %' or ltrim(x) like '* %' or ltrim(x) like '• %')) as bigint)").alias("n_bullet_lines"),
        F.expr(f"cast(size(filter(w, x -> lower(x) in ({stops}))) as bigint)").alias("n_stop_words"),
    )


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of *df* in a struct ``row``, then the counts, ``base_failed``, ``broken`` and ``kept``.

    Words are runs of anything but ASCII white space, lines are split at ``\\n``. n_repeat_words counts
    the words inside three-word windows that stand twice or more in the text, the first included.
    base_failed: under 50 words, or more than half of the words repeated so. kept: neither base_failed
    nor any rule broken. A null or empty text has no words and fails; repeated rows are judged alike;
    an empty table gives no rows; columns of any name are carried inside ``row`` and cannot clash.
    Windows are compared by 64-bit hashes inside one text; of equal windows and lines all count, so there are no ties to
    break. Long texts are read whole: a task holds one text's words and windows at a time.
    """
    t = _measured(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("t0")), "t0", "row")
    t = t.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    t = t.withColumn("broken", compiled(rules))
    return t.withColumn("kept", F.expr("not base_failed and size(broken) = 0"))


def kept_rows(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of *df* that :func:`judge` keeps, with the columns of *df*. Null and empty texts go, repeated rows stay
    or go together, and an empty table stays empty."""
    # inline() keeps the filter above what it filters by, which would else be computed once more for it
    judged = judge(df, text, rules).select("row", F.expr("inline(array(struct(kept as stays)))"))
    return judged.where("stays").select("row.*")


def _sql_rules() -> str:
    """RULES for DuckDB, over the columns of the query below."""
    out = []
    for r in RULES:
        value = MEASURES[r.measure]
        for whole in ("word_chars", "n_symbols", "n_marks", "n_stop_words", "n_dup_lines", "n_cut_lines", "n_bullet_lines"):
            for part in ("n_words", "n_lines"):
                value = value.replace(f"coalesce(try_divide({whole}, {part}), 0D)", f"coalesce({whole}::double / nullif({part}, 0), 0)")
        out += [f"{value} >= {r.low}"] * (r.low is not None) + [f"{value} <= {r.high}"] * (r.high is not None)
    return " and ".join(out)


SQL = rf"""
with words as (
  select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') ls
  from (select doc_id, coalesce(text, '') t from documents)),
windows as (
  select doc_id, i, count(*) over (partition by doc_id, a, b, c) n
  from (select doc_id, i, w[i] a, w[i + 1] b, w[i + 2] c
        from (select doc_id, w, unnest(range(1, len(w) - 1)) i from words))),
places as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from windows where n > 1) group by 1),
measured as (
  select doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
         (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::bigint n_marks,
         (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words, len(ls) n_lines,
         len(list_filter(ls, lambda x: rtrim(x) like '%...' or rtrim(x) like '%…')) n_cut_lines,
         len(list_filter(ls, lambda x: ltrim(x) like '- %' or ltrim(x) like '* %' or ltrim(x) like '• %')) n_bullet_lines,
         len(list_filter(w, lambda x: lower(x) in ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}))) n_stop_words
  from words left join places using (doc_id)),
judged as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {_sql_rules()} as kept
from judged
"""
