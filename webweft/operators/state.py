"""The tables after a change: every operator takes tables and returns the changed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.url import clipped

# Column widths of the store.
WIDTHS = {"host": 255, "scheme": 32, "reason": 40, "link_text": 255, "raw_href": 500, "value": 500}


def clip(df: DataFrame) -> DataFrame:
    return df.select(*[clipped(F.col(c), WIDTHS[c]).alias(c) if c in WIDTHS else F.col(c) for c in df.columns])


def upsert(links: DataFrame, urls: DataFrame, ignores: DataFrame) -> DataFrame:
    """(url_hash, id, status) of each distinct address of links(url_hash): the stored one, else a new one (id -1), ignored
    where a person ignored its hash."""
    known = urls.select("url_hash", "id", "status")
    hit = ignores.where("scope = 'url'").select("url_hash").distinct().withColumn("hit", F.lit(True))
    out = links.select("url_hash").distinct().join(known, "url_hash", "left").join(hit, "url_hash", "left")
    return out.select("url_hash", F.coalesce("id", F.lit(-1).cast("long")).alias("id"), F.coalesce("status", F.when(F.col("hit"), "ignored").otherwise("pending")).alias("status"))


def new_urls(links: DataFrame, urls: DataFrame, ignores: DataFrame, as_of: str) -> DataFrame:
    """The rows to store for addresses of links(url, is_internal, site_id, pos) that are not stored yet, each once, as its first
    link says: url_hash, url, host, scheme, site_id (own addresses only), is_internal, status, date_first_seen, clipped.

    A stand-in has its own scheme and no host.  An address whose hash a person ignored comes back ignored."""
    first = links.where("url is not null").groupBy("url").agg(F.min_by(F.struct("is_internal", "site_id"), F.struct("pos", "site_id")).alias("f"))
    first = first.withColumn("url_hash", U.fingerprint(F.col("url"))).join(urls.select("url_hash"), "url_hash", "left_anti")
    hit = ignores.where("scope = 'url'").select("url_hash").distinct().withColumn("__hit", F.lit(True))
    out = first.join(hit, "url_hash", "left")
    kind = U.stand_in_scheme(F.col("url"))
    return clip(out.select(
        "url_hash",
        "url",
        F.when(kind.isNotNull(), "").otherwise(F.coalesce(U.host_of(F.col("url")), F.lit(""))).alias("host"),
        F.coalesce(kind, U.scheme_of(F.col("url"))).alias("scheme"),
        F.when(F.col("f.is_internal"), F.col("f.site_id")).alias("site_id"),
        F.col("f.is_internal").alias("is_internal"),
        F.when(F.col("__hit"), "ignored").otherwise("pending").alias("status"),
        F.lit(as_of).cast("timestamp_ntz").alias("date_first_seen"),
    ))


def addresses_of(elements_sites: DataFrame, sites: DataFrame, ids: DataFrame, strip: bool = True) -> DataFrame:
    """(element_id, url_hash) of every address under which elements ids(element_id) may be linked: both stand-ins, and their
    page on each site that has one (elements_sites(element_id, site_id, uri), sites(site_id, base_url))."""
    who = dealt(ids.select("element_id"), "element_id").distinct()
    stand_ins = who.select("element_id", F.explode(F.array(U.stand_in(F.col("element_id")), U.stand_in(F.col("element_id"), True))).alias("url"))
    pages = elements_sites.where("uri is not null").join(who, "element_id", "left_semi").join(sites.select("site_id", "base_url").where("base_url is not null"), "site_id")
    path = F.when(F.col("uri") == U.HOME, "").otherwise(F.ltrim("uri", F.lit("/")))
    pages = pages.select("element_id", U.normalised(F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/"), path), strip=strip).alias("url")).where("url is not null")
    # Stand-ins of distinct elements are distinct; only pages can be met twice, each beside its own element's.
    return stand_ins.unionByName(pages.distinct()).select("element_id", U.fingerprint(F.col("url")).alias("url_hash"))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key to all tasks of a shuffle.  Left to itself Spark joins small parts to tasks by their packed bytes, and
    narrow rows pack so well that millions are sorted and hashed in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def replace(table: DataFrame, where: Column, rows: DataFrame | None = None) -> DataFrame:
    """table without the rows where the condition holds, and with new ones (a null condition keeps a row)."""
    kept = table.where(~F.coalesce(where, F.lit(False)))
    return kept if rows is None else kept.unionByName(rows)


def of_element(element_ids: list[int], site: int | None = None, sources: tuple[str, ...] = (), owned: bool = True) -> Column:
    """Condition on references: of these elements (or of what they own), a site, some sources."""
    out = F.col("element_id").isin(*element_ids)
    if owned:
        out = out | F.coalesce(F.col("owner_element_id").isin(*element_ids), F.lit(False))
    if site is not None:
        out = out & (F.col("site_id") == site)
    return out & F.col("source").isin(*sources) if sources else out


def of_site(site: int, sources: tuple[str, ...]) -> Column:
    return (F.col("site_id") == site) & F.col("source").isin(*sources)


def element_deleted(urls: DataFrame, refs: DataFrame, element_id: int) -> tuple[DataFrame, DataFrame]:
    """(urls, refs) without the element's references, and without addresses that only they held."""
    mine = F.coalesce(of_element([element_id]), F.lit(False))
    left = refs.where(~mine)
    touched = refs.where(mine).select(F.col("url_id").alias("id")).distinct()
    gone = touched.join(left.select(F.col("url_id").alias("id")), "id", "left_anti")
    return urls.join(gone, "id", "left_anti"), left


def set_where(table: DataFrame, where: Column, **new: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def settings_released(urls: DataFrame) -> DataFrame:
    """Addresses ignored by a setting or a rule are pending again."""
    hit = (F.col("status") == "ignored") & F.col("reason").isin("setting", "ignore-rule")
    return set_where(urls, hit, status=F.lit("pending"), reason=F.lit(None).cast("string"), next_check_after=F.lit(None).cast("timestamp_ntz"))


def brought_forward(urls: DataFrame, hashes: DataFrame, as_of: str) -> DataFrame:
    """Addresses of hashes(url_hash) that nobody ignores are due a minute ago."""
    hit = dealt(hashes.select("url_hash"), "url_hash").distinct().withColumn("__hit", F.lit(True))
    at = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 1 MINUTE")
    return set_where(dealt(urls, "url_hash").join(hit, "url_hash", "left"), F.col("__hit") & (F.col("status") != "ignored"), next_check_after=at).select(*urls.columns)


def ignored(urls: DataFrame, ignores: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(urls, ignores) after people ignore chosen(url_hash, value, user_id, date_created, note).  An earlier decision on the
    same hash is replaced."""
    hit = chosen.select("url_hash").distinct().withColumn("__hit", F.lit(True))
    new = set_where(urls.join(hit, "url_hash", "left"), F.col("__hit"), status=F.lit("ignored"), reason=F.lit("ignored"), next_check_after=F.lit(None).cast("timestamp_ntz")).select(*urls.columns)
    kept = ignores.join(hit, "url_hash", "left_anti")
    rows = clip(chosen.select(F.lit(None).cast("long").alias("id"), F.lit("url").alias("scope"), "url_hash", "value", "date_created", "user_id"))
    return new, kept.select("id", "scope", "url_hash", "value", "date_created", "user_id").unionByName(rows)


def restored(urls: DataFrame, ignores: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(urls, ignores) after people take ignoring back: pending, next check open, the reason left as it was."""
    hit = hashes.select("url_hash").distinct().withColumn("__hit", F.lit(True))
    new = set_where(urls.join(hit, "url_hash", "left"), F.col("__hit"), status=F.lit("pending"), next_check_after=F.lit(None).cast("timestamp_ntz")).select(*urls.columns)
    return new, ignores.join(hit, "url_hash", "left_anti")


def reset(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """Empty tables of the same columns (what people ignored is not among them)."""
    return tuple(t.limit(0) for t in tables)


def due_again(urls: DataFrame, as_of: str, everything: bool = False) -> DataFrame:
    """Broken and unreachable addresses (or all that nobody ignores) are due a minute ago."""
    hit = (F.col("status") != "ignored") if everything else F.col("status").isin("broken", "unreachable")
    return set_where(urls, hit, next_check_after=F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 1 MINUTE"))


def element_due(urls: DataFrame, refs: DataFrame, element_id: int, site: int, as_of: str) -> DataFrame:
    """The element's addresses that nobody ignores are due a minute ago."""
    mine = refs.where(of_element([element_id], site)).select(F.col("url_id").alias("id")).distinct().withColumn("__hit", F.lit(True))
    at = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 1 MINUTE")
    return set_where(urls.join(mine, "id", "left"), F.col("__hit") & (F.col("status") != "ignored"), next_check_after=at).select(*urls.columns)
