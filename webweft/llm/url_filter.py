"""URL filter rules looked up by hash prefixes.

A rule is a host and the beginning of a path.  Each URL is expanded into expressions, one for each suffix of its host (at
the dots) and beginning of its path that a rule can have: only the shapes (labels in the host, length of the path) that
occur among the rules are formed, so a URL has no more expressions than its own labels times its path's length.  Rules
and expressions meet in an equi-join on the first four bytes of SHA-256; the full digest then confirms, as prefixes of
different expressions may agree.  Of the rules that fit, the longest (host and path) decides; of equally long ones that
with the longer host; where one rule is listed with both verdicts, block.

Rules of at most BROADCAST_BYTES, counted before, go to every task.  Beyond that they are shuffled: each goes to SALTS
partitions and a URL's expressions to one of these, by its row, so a host with a third of all rows is spread.  Expressions
that no rule has end at the join; what returns to the URLs is one row for each of them, made before any shuffle where
rules are broadcast.

Defined cases: a null URL or one without :// has an empty host and path, and no rule fits it (but one with an empty host and
path, which fits all); a path may be empty, and no rule with a path fits then; rules with a null host or path count as
having an empty one, rules with a null verdict are left out; repeated rules are one; repeated rows are judged each; extra
columns of the URLs are kept whatever their names by judged()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shielded

#: The size up to which rules are broadcast, and the copies of a rule where they are not.
BROADCAST_BYTES, SALTS = 64 << 20, 32
UNLISTED = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case, and the path after it up to ?, # or the end."""
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.when(host == "", 0).otherwise(F.size(F.split(host, "\\.")))


def _digest(host: Column, path: Column) -> Column:
    """Of the expression; a line feed cannot be in a host that was cut at /, so no two expressions are written alike."""
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path), 256))


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 4)


def rule_table(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) with what the join needs, each expression once."""
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    once = rules.where("verdict is not null").select(host.alias("r_host"), path.alias("r_path"), "verdict").groupBy("r_host", "r_path").agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocks"))
    out = once.select("r_host", "r_path", F.when(F.col("blocks") == 1, "block").otherwise("allow").alias("verdict"))
    out = out.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
    return out.withColumn("r_short", _short(F.col("r_digest")))


def shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """(labels, length) of the rules of rule_table(), each once: no more than the longest host has labels times the longest
    path has characters."""
    return sorted(tuple(r) for r in rules.select(_labels(F.col("r_host")).alias("labels"), F.length("r_path").alias("length")).distinct().collect())


def expressions(host: Column, path: Column, forms: list[tuple[int, int]]) -> Column:
    """The digests of a URL's expressions: one for each of the shapes that fits into it."""
    if not forms:
        return F.array().cast("array<binary>")
    parts, size, length = F.split(host, "\\."), _labels(host), F.length(path)
    listed = F.array(*(F.struct(F.lit(k).alias("labels"), F.lit(n).alias("length")) for k, n in forms))
    fit = F.filter(listed, lambda s: (s["labels"] <= size) & (s["length"] <= length))

    def one(s: Column) -> Column:
        end = F.when(s["labels"] == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, size - s["labels"] + 1, F.greatest(s["labels"], F.lit(0))), "."))
        return _digest(end, F.substring(path, F.lit(1), s["length"]))

    return F.transform(fit, one)


def judged(urls: DataFrame, rules: DataFrame, url: str = "url", unlisted: str = UNLISTED, broadcast_bytes: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """urls with host, path, rule (host and path of the one that decides, else null) and verdict (its, else `unlisted`).
    Columns of urls with one of these names are replaced."""
    new = ("host", "path", "rule", "verdict")
    kept, (rows, inner) = [c for c in urls.columns if c.lower() not in new or c == url], shielded(urls)
    listed = rule_table(rules)
    host, path = host_and_path(F.col(inner[url]))
    rows = rows.select(*(inner[c] for c in kept), F.monotonically_increasing_id().alias("__row"), host.alias("__host"), path.alias("__path"))
    found = rows.select("*", F.posexplode_outer(expressions(F.col("__host"), F.col("__path"), shapes(listed))).alias("__pos", "__digest"))
    found = found.withColumn("__short", _short(F.col("__digest")))
    size = listed.agg(F.sum(F.octet_length("r_host") + F.octet_length("r_path") + 64)).first()[0] or 0
    same = (F.col("__short") == F.col("r_short")) & (F.col("__digest") == F.col("r_digest"))
    if size <= broadcast_bytes:
        found = found.join(F.broadcast(listed), same, "left")
    else:
        listed = listed.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = found.withColumn("__salt", F.pmod("__row", F.lit(salts)).cast("int")).join(listed.hint("merge"), same & (F.col("__salt") == F.col("r_salt")), "left")
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("size"), F.length("r_host").alias("host"), F.concat("r_host", "r_path").alias("rule"), "verdict")
    # A row's columns ride with its first expression only.
    row = F.struct(*(inner[c] for c in kept), "__host", "__path")
    first = F.first(F.when(F.coalesce("__pos", F.lit(0)) == 0, row), ignorenulls=True)
    best = found.groupBy("__row").agg(first.alias("__was"), F.max(F.when(F.col("r_host").isNotNull(), rank)).alias("__best"))
    made = {"host": F.col("__was.__host"), "path": F.col("__was.__path"), "rule": F.col("__best.rule"), "verdict": F.coalesce("__best.verdict", F.lit(unlisted))}
    return best.select(*(F.col(f"__was.{inner[c]}").alias(c) for c in kept if c.lower() not in new), *(v.alias(k) for k, v in made.items()))


def accepted(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The urls that are not blocked, with the columns of judged()."""
    return judged(urls, rules, url).where("verdict = 'allow'")


def fixed_rules(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def digest(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url, ...)."""
    return judged(pages.select("page_id", "url"), fixed_rules(pages.sparkSession)).select("page_id", "host", "path", "rule", "verdict")
