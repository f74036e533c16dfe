"""URL filters: host-suffix and path-prefix expressions against a rule table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.llm.common import ascii_lower, table

#: Fixed values: (verdict, host, path) of the query's contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Hex digits of a digest that are joined on; the whole digest is compared after.
PREFIX = 8
#: Most rules, and bytes of them, that are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    """How many labels a host has."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judges urls by the longest rule that fits; ``rules`` has verdict, host and path.

    A url becomes the expressions (host suffix at a label, path prefix): the
    suffixes of its host that have as many labels as some rule's host, and the
    prefixes of its path that are as long as some rule's path. Expressions meet
    the rules in an equi-join on the first digits of a digest; the full digest
    confirms; the longest rule wins (host and path together, then the host, then
    block before allow). Only distinct pairs of host and path prefix are judged,
    and verdicts go back to the rows by that pair, as one key: so the join
    shuffles both sides for itself and adaptive execution splits a hot url.
    Rows without a host do not take part.

    Returns ``pages`` plus ``host``, ``path``, ``rule`` and ``verdict``; input
    columns of these names are replaced. Urls that no rule fits get ``default``.

    Edge cases: a null url, or one without ``://``, has an empty host and path
    and gets the default; an empty path fits no rule; repeated rows stay and get
    the same verdict; an empty table gives an empty table; a rule with a null
    field fits nothing; no rules at all: the default for all. A host of many
    thousand labels costs no more than its length.
    """
    rules = (
        rules.select("verdict", ascii_lower(F.col("host")).alias("rhost"), F.col("path").alias("rpath"))
        .dropna()
        .withColumn("rdigest", _digest(F.col("rhost"), F.col("rpath")))
        .withColumn("rprefix", F.substring("rdigest", 1, PREFIX))
    )
    n_rules, n_bytes, lengths, depths = rules.agg(
        F.count(F.lit(1)), F.sum(F.octet_length("rhost") + F.octet_length("rpath") + 100), F.collect_set(F.length("rpath")), F.collect_set(_labels(F.col("rhost")))
    ).first()
    if n_rules <= BROADCAST_RULES and (n_bytes or 0) <= BROADCAST_BYTES:
        rules = F.broadcast(rules)
    longest = max(lengths, default=0)
    rest = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    # what decides: the host, and the path up to the longest rule's
    rest = rest.withColumn("__uf_k", F.when((F.col("host") != "") & (F.col("path") != ""), F.struct("host", F.substring("path", 1, longest).alias("path"))))
    hosts = F.array_compact(F.array(*[F.when(_labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in sorted(depths)]))
    paths = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]))
    judged = (
        rest.where(F.col("__uf_k").isNotNull())
        .select("__uf_k.host", "__uf_k.path")
        .distinct()
        .select("host", "path", F.explode(hosts).alias("xhost"), paths.alias("paths"))
        .select("host", "path", "xhost", F.explode("paths").alias("xpath"))
        .withColumn("digest", _digest(F.col("xhost"), F.col("xpath")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX))
        .join(rules, (F.col("prefix") == F.col("rprefix")) & (F.col("digest") == F.col("rdigest")))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    (F.length("rhost") + F.length("rpath")).alias("len"),
                    F.length("rhost").alias("hlen"),
                    (F.col("verdict") == "block").alias("block"),
                    F.concat("rhost", "rpath").alias("rule"),
                    "verdict",
                )
            ).alias("__uf_won")
        )
        .select(F.struct("host", "path").alias("__uf_k2"), "__uf_won")
    )
    return (
        rest.join(judged, F.col("__uf_k") == F.col("__uf_k2"), "left")
        .withColumns({"rule": F.col("__uf_won.rule"), "verdict": F.coalesce(F.col("__uf_won.verdict"), F.lit(default))})
        .drop("__uf_k", "__uf_k2", "__uf_won")
    )


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).drop("url")


ORACLE_SQL = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (SELECT page_id, row_number() OVER () AS rid,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*(/[^?#]*)', 1, 's'), '') AS path FROM pages),
m AS (SELECT p.rid, r.verdict, r.host || r.path AS rule,
  row_number() OVER (PARTITION BY p.rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS k
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.rid = m.rid AND m.k = 1
"""
