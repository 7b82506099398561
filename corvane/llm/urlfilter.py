r"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Rules are stored as the SHA-256 digest of an expression ``host/path`` plus a 32-bit prefix of that
digest. Each distinct URL is expanded into all expressions that a rule could have (suffixes of the
host at label borders, prefixes of the path at slashes), the expressions meet the rules in an equi-join
on the prefix, and a match counts only if the full digests agree. Among the matches the longest rule
wins; of equally long ones, a block wins. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rules of the registered query: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Bytes of compiled rules that a broadcast may hold; with more, the join shuffles.
BROADCAST = 50_000_000


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def parsed(url: str) -> tuple:
    """Columns host and path of a URL column: the host after the first ``://`` up to ``/``, ``?``, ``#``
    or the end, A-Z lower-cased; the path after it up to ``?``, ``#`` or the end. Null, or no ``://``: both empty.
    """
    rest = f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')"
    host = f"translate(coalesce(regexp_extract({rest}, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"
    return F.expr(host), F.expr(path)


def compiled(rules: DataFrame) -> DataFrame:
    """Rules as digests. A rule is filed under the part of its path up to the last slash (``stem``);
    what follows is compared after the join, so paths need not end in a slash. Null parts are
    empty; rules without host fit nothing; repeated rules count once.
    """
    r = rules.select(F.lower(F.coalesce("rule_host", F.lit(""))).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "rule_verdict").distinct()
    r = r.where("rule_host <> ''").withColumn("stem", F.expr("regexp_extract(rule_path, '^(.*/)?', 0)"))
    r = r.withColumn("digest", F.expr("sha2(concat(rule_host, stem), 256)"))
    return r.select("*", F.expr("conv(substring(digest, 1, 8), 16, 10)").cast("long").alias("prefix"))


def verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of *pages* in a struct ``row``, then host, path, rule (``host/path`` or null), verdict.

    Each distinct URL is judged once and the verdict joined back, so a host or URL that holds most of
    the rows costs one row before the join; expansion stops at the depth that the rules reach.
    Null urls have empty parts and the default verdict; repeated rows are judged alike; empty tables
    give no rows, no rules give the default for all; other columns stay inside ``row``. A long URL is expanded no further
    than the rules reach, so it costs its length once for each of their levels.
    """
    table = compiled(rules)
    facts = table.agg(F.max(F.expr("size(split(rule_host, '[.]'))")), F.max(F.expr("size(split(stem, '/'))")), F.sum(F.expr("200 + 2 * length(rule_host) + 2 * length(rule_path)"))).first()
    labels, slashes = facts[0] or 0, facts[1] or 0
    table = F.broadcast(table) if (facts[2] or 0) <= BROADCAST else table
    host, path = parsed("u")
    urls = pages.select(F.col(url).alias("u")).where("u is not null").distinct().select("u", host.alias("host"), path.alias("path"))
    own = urls.where("host <> ''").select(
        "u", "path",
        F.explode(F.expr(f"transform(sequence(1, least(size(split(host, '[.]')), {max(labels, 1)})), i -> substring_index(host, '.', -i))")).alias("h"))
    own = own.select("u", "path", "h", F.explode(F.expr(
        f"transform(sequence(0, least(size(split(path, '/')) - 1, {max(slashes - 1, 0)})), i -> if(i = 0, '', concat(substring_index(path, '/', i), '/')))")).alias("p"))
    own = own.select("u", "path", F.expr("sha2(concat(h, p), 256)").alias("full")).select(
        "*", F.expr("conv(substring(full, 1, 8), 16, 10)").cast("long").alias("prefix"))
    hits = own.join(table, "prefix").where("full = digest and startswith(path, rule_path)")
    best = hits.groupBy("u").agg(F.max(F.struct(
        F.expr("length(rule_host) + length(rule_path)").alias("size"), F.expr("rule_verdict = 'block'").alias("blocks"),
        F.expr("concat(rule_host, rule_path)").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(url).alias("u"))
    return rows.join(best, "u", "left").select(
        "row", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
with rules(rule_host, rule_path, rule_verdict) as (values
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  from (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages))
select page_id, host, path, rule_host || rule_path as rule, coalesce(rule_verdict, 'allow') as verdict
from parts left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
qualify row_number() over (partition by page_id order by length(rule_host) + length(rule_path) desc nulls last, rule_verdict desc) = 1
"""
