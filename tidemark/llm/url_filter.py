"""URL filter by hashed expressions, in DataFrame and SQL functions only.

A rule is a host, a path and a verdict; it fits a URL whose host is the rule's or a subdomain of it and whose path starts
with the rule's. Each URL is expanded into expressions: suffixes of its host with prefixes of its path, of those shapes
(labels of the host, length of the path) that some rule has. Expressions meet rules in an equi-join on a short prefix of
their SHA-256, full digests confirm the match, and of the rules that fit the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii
from tidemark.session import saved

# The rules of the contract, as (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Hex digits of a digest that are joined on.
PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no `://`.

    The host stands after the first `://` up to `/`, `?`, `#` or the end, with a user or port if there is one; the path
    follows, up to `?`, `#` or the end.
    """
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def labels(host: Column) -> Column:
    return F.split(host, r"\.")


def digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; the length of the host tells it from the path."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def default_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")


def prepared(rules: DataFrame) -> DataFrame:
    """(prefix, digest, host, path, verdict): one row for each host and path of rules (host, path, verdict).

    A host is lower-cased (A-Z); a null host or path counts as empty, and rules with an empty host or with a verdict
    other than allow and block are left out, since they fit nothing. Of repeated rules that differ, block holds.
    """
    r = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> '' AND verdict IN ('allow', 'block')")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("digest", digest(F.col("host"), F.col("path")))
    return r.select(F.substring("digest", 1, PREFIX).alias("prefix"), "digest", "host", "path", "verdict")


def shapes(rules: DataFrame) -> Column:
    """Array of (n, len, open): labels of a rule's host, length of its path, and whether some rule's path of this shape does not end in `/`.

    It holds one entry for each shape, whatever the number of rules: a host has 127 labels and a path some thousand
    characters at most.
    """
    found = rules.groupBy(F.size(labels(F.col("host"))).alias("n"), F.length("path").alias("len")).agg(F.max(~F.col("path").endswith("/") & (F.col("path") != "")).alias("open"))
    every = [F.struct(F.lit(r["n"]).alias("n"), F.lit(r["len"]).alias("len"), F.lit(r["open"]).alias("open")) for r in found.orderBy("n", "len").collect()]
    return F.array(*every) if every else F.expr("cast(array() AS array<struct<n: int, len: int, open: boolean>>)")


def expressions(host: Column, path: Column, shape: Column) -> Column:
    """Array of (host, path): a URL's expressions. A prefix that no open rule has must end in `/`."""
    parts = labels(host)
    n, size = F.size(parts), F.length(path)
    fits = F.filter(shape, lambda s: (s["n"] <= n) & (s["len"] <= size) & (s["open"] | (s["len"] == 0) | (F.substr(path, s["len"], F.lit(1)) == "/")))
    return F.transform(fits, lambda s: F.struct(F.array_join(F.slice(parts, n - s["n"] + 1, s["n"]), ".").alias("host"), F.substr(path, F.lit(1), s["len"]).alias("path")))


def judge(pages: DataFrame, rules: DataFrame | None = None, otherwise: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (columns of pages with these names are replaced).

    rules: (host, path, verdict), by default those of the contract; see prepared() for odd ones. rule is the host and
    path of the rule that decides, null where none fits; there the verdict is `otherwise`: an address that no list names
    passes, as in any filter by lists. Of several that fit, the longest (host and path together) decides, then the longer
    host; block holds over allow for one host and path. Null, empty and malformed URLs have an empty host and path, which
    no rule fits. Repeated rows are judged alike, each for itself; very long URLs are expanded by the shapes of the rules,
    never by their own length. Empty tables of pages or rules give an empty table, or `otherwise` throughout.

    Equal hosts and paths are judged once, and only the decided ones are written and joined back, in a plain join that
    Spark broadcasts by its size or whose hot keys it splits.
    """
    spark = pages.sparkSession
    listed = prepared(default_rules(spark) if rules is None else rules)
    host, path = host_and_path(F.col(url))
    judged = pages.withColumns({"_url_host": host, "_url_path": path}).drop("host", "path", "rule", "verdict")
    one = judged.select("_url_host", "_url_path").filter("_url_host <> ''").distinct()
    tried = one.select("_url_host", "_url_path", F.explode(expressions(F.col("_url_host"), F.col("_url_path"), shapes(listed))).alias("e"))
    tried = tried.select("_url_host", "_url_path", digest(F.col("e.host"), F.col("e.path")).alias("d")).withColumn("prefix", F.substring("d", 1, PREFIX))
    hits = tried.join(listed, "prefix").filter("d = digest")
    order = F.struct(F.length("host") + F.length("path"), F.length("host"))
    best = hits.groupBy("_url_host", "_url_path").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), order).alias("best"))
    decided = saved(best.select("_url_host", "_url_path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")), "url-verdicts")
    kept = [c for c in judged.columns if c not in ("_url_host", "_url_path")]
    return judged.join(decided, ["_url_host", "_url_path"], "left").select(
        *[F.col(f"`{c}`") for c in kept], F.col("_url_host").alias("host"), F.col("_url_path").alias("path"), "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")
    )


def op11(pages: DataFrame) -> DataFrame:
    """Verdict of every page's URL by the contract's rules."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
