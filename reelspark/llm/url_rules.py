"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

Every distinct (host, path) is expanded into the expressions under which a rule
can be filed (each host suffix with each directory prefix of the path). Rules and
expressions meet in an equi-join on the first eight hex digits of a SHA-256; the
full digest and the rest of the rule's path then confirm the hit, and precedence
picks one rule. Only DataFrame functions are used.

Cases: a null url, or one without "://", has an empty host and path and meets no
rule. Repeated rows each get their row back. An empty table gives an empty result.
Columns of the input are kept only as far as `keep` names them; one that bears the
name of a result column comes back with "_input" appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept_names, local_rows, small_or_none, table

OWN = ("host", "path", "rule", "verdict")

#: Rules of the contract (fixed values).
RULES = [
    {"verdict": "block", "rule_host": "net", "rule_path": "/"},
    {"verdict": "allow", "rule_host": "example.net", "rule_path": "/en/"},
    {"verdict": "block", "rule_host": "example.com", "rule_path": "/de/"},
    {"verdict": "allow", "rule_host": "org", "rule_path": "/fr/"},
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _counted(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def host_suffixes(host: Column, most: int) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(_counted(F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, -k, k), "."))


def path_prefixes(path: Column, most: int) -> Column:
    """The empty prefix, and the path up to each slash."""
    parts = F.split(path, "/", -1)
    own = F.transform(_counted(F.least(F.size(parts) - 1, F.lit(most))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    return F.concat(F.array(F.lit("")), own)


def judge(pages: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = "allow", broadcast_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """keep, host, path, rule and verdict for every row of pages.

    rules: verdict, rule_host, rule_path. A rule fits its host and all subdomains if
    the path starts with the rule's. The longest rule (host and path) wins; between
    equally long ones block goes before allow, then the later in the alphabet.
    Expressions deeper than the deepest rule are not made, since none can fit.
    Rules are broadcast if at most broadcast_rows; else joined with salted keys.
    """
    directory = F.regexp_extract("rule_path", r"^(?s:.*)/", 0)
    filed = rules.select(
        "verdict",
        F.translate("rule_host", UPPER, LOWER).alias("rule_host"),
        "rule_path",
        F.sha2(F.concat(F.translate("rule_host", UPPER, LOWER), directory), 256).alias("rule_digest"),
    ).withColumn("prefix", F.substring("rule_digest", 1, 8))
    deepest = filed.agg(F.max(F.size(F.split("rule_host", r"\.", -1))).alias("h"), F.max(F.size(F.split("rule_path", "/", -1)) - 1).alias("p")).first()
    most_labels, most_parts = deepest["h"] or 0, deepest["p"] or 0

    host, path = host_and_path(F.col(url))
    judged = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    distinct = judged.select(F.col("host").alias("u_host"), F.col("path").alias("u_path")).distinct()
    asked = (
        distinct.withColumn("suffix", F.explode(host_suffixes(F.col("u_host"), most_labels)))
        .withColumn("directory", F.explode(path_prefixes(F.col("u_path"), most_parts)))
        .withColumn("digest", F.sha2(F.concat("suffix", "directory"), 256))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )
    small = small_or_none(filed, broadcast_rows)
    if small is filed:  # many rules: a short suffix such as a top-level domain is a hot key, so it is salted
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("u_host", "u_path"), F.lit(salts)))
        met = asked.join(filed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["prefix", "salt"])
    else:
        met = asked.join(small, "prefix")
    rule = F.concat("rule_host", "rule_path")
    best = (
        met.where((F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("u_path"), F.col("rule_path")))
        .groupBy("u_host", "u_path")
        .agg(F.max(F.struct(F.length(rule).alias("n"), (F.col("verdict") == "block").alias("blocks"), rule.alias("rule"), F.col("verdict").alias("ruled"))).alias("best"))
    )
    return judged.join(best, (F.col("host") == F.col("u_host")) & (F.col("path") == F.col("u_path")), "left").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept_names(keep, OWN))], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.ruled", F.lit(default)).alias("verdict")
    )


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), local_rows(spark, RULES), ["page_id"])


ORACLE = {
    "op9_url_filters": """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
b AS (SELECT p.page_id, p.host, p.path, arg_max(r.rh || r.rp, length(r.rh || r.rp)) AS rule, arg_max(r.verdict, length(r.rh || r.rp)) AS ruled
      FROM p LEFT JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)
      GROUP BY p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(ruled, 'allow') AS verdict FROM b
"""
}
QUERIES = {"op9_url_filters": op9_url_filters}
