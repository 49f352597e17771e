"""Report operators over urls and refs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "ok", "broken", "redirect", "unreachable", "blocked", "ignored", "unsafe")


def scoped(urls: DataFrame, refs: DataFrame, sites: list[int], **equal) -> DataFrame:
    """Addresses that some reference on the sites holds (a semi join; further reference columns must equal)."""
    held = refs.where(F.col("site_id").isin(*sites))
    for column, value in equal.items():
        held = held.where(F.col(column) == value)
    return urls.join(held.select(F.col("url_id").alias("id")), "id", "left_semi")


def verdict_counts(urls: DataFrame, refs: DataFrame, sites: list[int]) -> DataFrame:
    """Every status with its number of addresses, zero included."""
    spark = urls.sparkSession
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    found = scoped(urls, refs, sites).groupBy("status").agg(F.count("*").alias("n"))
    return every.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_broken_by_places(urls: DataFrame, refs: DataFrame, site: int, k: int = 5) -> DataFrame:
    """Broken addresses with the most references on a site; counted before the join, so the shuffle is narrow."""
    places = refs.where(F.col("site_id") == site).groupBy(F.col("url_id").alias("id")).agg(F.count("*").alias("places"))
    broken = urls.where("status = 'broken'").select("id", "url", "http_status")
    return broken.join(places, "id").orderBy(F.desc("places"), "id").limit(k).select("id", "url", F.col("http_status").cast("int").alias("http_status"), "places")


def top_pages(urls: DataFrame, refs: DataFrame, site: int, k: int = 5) -> DataFrame:
    broken = urls.where("status = 'broken'").select(F.col("id").alias("url_id"))
    held = refs.where(F.col("site_id") == site).join(broken, "url_id", "left_semi")
    page = F.coalesce("owner_element_id", "element_id").alias("element_id")
    return held.groupBy(page).agg(F.count_distinct("url_id").alias("n")).orderBy(F.desc("n"), "element_id").limit(k)


def search(urls: DataFrame, term: str) -> DataFrame:
    return urls.where(F.lower("url").contains(term.lower()))


def filtered(urls: DataFrame, refs: DataFrame, status: str, sites: list[int], host: str | None = None, permanent: bool | None = None, internal: bool | None = None, term: str | None = None, **equal) -> DataFrame:
    """Addresses of a verdict on the sites; further filters narrow them (a redirect of unknown kind matches neither)."""
    out = urls.where(F.col("status") == status)
    if host is not None:
        out = out.where(F.col("host") == host)
    if permanent is not None:
        out = out.where(F.col("redirect_permanent") == permanent)
    if internal is not None:
        out = out.where(F.col("is_internal") == internal)
    return scoped(search(out, term) if term else out, refs, sites, **equal)


SORTS = {"url": "url", "host": "host", "httpStatus": "http_status", "refCount": "ref_count", "lastChecked": "date_last_checked"}


def url_table(urls: DataFrame, refs: DataFrame, status: str, site: int, page: int = 1, per_page: int = 100, sort: str = "lastChecked", descending: bool = True, **filters) -> DataFrame:
    """A page of a list: addresses with the number of references that the filters leave; nulls first upward, last downward."""
    own = {k: filters.pop(k) for k in ("host", "permanent", "internal", "term") if k in filters}
    held = refs.where(F.col("site_id") == site)
    for column, value in filters.items():
        held = held.where(F.col(column) == value)
    n = held.groupBy(F.col("url_id").alias("id")).agg(F.count("*").alias("ref_count"))
    found = filtered(urls, refs, status, [site], **own, **filters).join(n, "id")
    order = F.desc_nulls_last(SORTS[sort]) if descending else F.asc_nulls_first(SORTS[sort])
    return found.orderBy(order, "id").offset((page - 1) * per_page).limit(per_page)


def host_counts(urls: DataFrame, refs: DataFrame, site: int, status: str = "broken") -> DataFrame:
    return scoped(urls.where(F.col("status") == status).where("host <> ''"), refs, [site]).groupBy("host").agg(F.count("*").alias("n"))


def top_hosts(urls: DataFrame, refs: DataFrame, site: int, k: int = 5) -> DataFrame:
    return host_counts(urls, refs, site).orderBy(F.desc("n"), "host").limit(k)


def host_options(urls: DataFrame, refs: DataFrame, site: int, status: str = "broken") -> DataFrame:
    return host_counts(urls, refs, site, status).select("host", F.concat("host", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("label"))


def element_types(urls: DataFrame, refs: DataFrame, site: int, status: str = "broken") -> DataFrame:
    wanted = urls.where(F.col("status") == status).select(F.col("id").alias("url_id"))
    return refs.where(F.col("site_id") == site).join(wanted, "url_id", "left_semi").select("element_type").distinct()


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def element_summary(urls: DataFrame, refs: DataFrame, site: int, element_id: int | None = None) -> DataFrame:
    """Per element: its different addresses, how many were checked and are broken, and when last."""
    held = refs.where(F.col("site_id") == site)
    if element_id is not None:
        held = held.where((F.col("element_id") == element_id) | F.coalesce(F.col("owner_element_id") == element_id, F.lit(False)))
    one = held.select("element_id", "url_id").distinct().join(urls.select(F.col("id").alias("url_id"), "status", "date_last_checked"), "url_id")
    n = lambda test: F.count(F.when(test, F.col("url_id")))
    return one.groupBy("element_id").agg(n(F.lit(True)).alias("total"), n(F.col("status") != "pending").alias("checked"), n(F.col("status") == "broken").alias("broken"), F.max("date_last_checked").alias("last_checked"))


def element_panel(urls: DataFrame, refs: DataFrame, site: int, most: int = 10, element_id: int | None = None) -> DataFrame:
    """Per page, or of the page asked for: its different addresses in all and by verdict, those checked and broken, when one
    was last checked, and the first `most` broken ones by address, each with the reference that comes first.

    A page has the references on it and in what it owns, so a reference counts for its element and its owner.  An address
    counts once a page and verdict, however many references hold it."""
    held = refs.where(F.col("site_id") == site).withColumn("page_id", F.explode(F.array_distinct(F.filter(F.array("element_id", "owner_element_id"), lambda i: i.isNotNull()))))
    if element_id is not None:
        held = held.where(F.col("page_id") == element_id)
    first = held.groupBy("page_id", "url_id").agg(F.min(F.struct("id", "element_id", "owner_element_id", "field_handle")).alias("ref"))
    one = first.join(urls.select(F.col("id").alias("url_id"), "url", "url_hash", "status", "http_status", "date_last_checked"), "url_id")
    n = lambda test: F.count_if(test)
    status = F.col("status")
    sums = one.groupBy("page_id").agg(F.count("*").alias("total"), n(status != "pending").alias("checked"), *(n(status == s).alias(s) for s in STATUSES), F.max("date_last_checked").alias("last_checked"))
    ranked = one.where("status = 'broken'").withColumn("__n", F.row_number().over(Window.partitionBy("page_id").orderBy("url", "url_id"))).where(F.col("__n") <= most)
    nested = F.coalesce(F.col("ref.owner_element_id") != F.col("ref.element_id"), F.lit(False))
    item = F.struct("__n", "url", F.col("http_status").cast("int").alias("http_status"), F.col("ref.id").alias("ref_id"), F.when(nested, F.col("ref.element_id")).alias("block_id"), F.col("ref.field_handle").alias("field_handle"))
    listed = ranked.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("__n")).alias("broken_urls"))  # at most `most` a page
    return sums.join(listed, "page_id", "left")


def reference_location(refs: DataFrame, elements: DataFrame, ids: list[int]) -> DataFrame:
    """Where references are: (id, page_id, site_id, block_id, field_handle, raw text); none where the page is gone."""
    found = refs.where(F.col("id").isin(*ids)).withColumn("page_id", F.coalesce("owner_element_id", "element_id"))
    alive = elements.where("date_deleted is null").select(F.col("id").alias("page_id"))
    block = F.when(F.col("owner_element_id").isNotNull() & (F.col("owner_element_id") != F.col("element_id")), F.col("element_id"))
    return found.join(alive, "page_id", "left_semi").select("id", "page_id", "site_id", block.alias("block_id"), "field_handle", "link_text")


def with_total(page: DataFrame, found: DataFrame) -> DataFrame:
    """A page of a list with the number of all rows found beside each of its rows."""
    return page.crossJoin(found.agg(F.count("*").alias("total")))  # with one row


def broken_locations(urls: DataFrame, refs: DataFrame, site: int) -> DataFrame:
    """Per element and broken address the first reference."""
    broken = urls.where("status = 'broken'").select(F.col("id").alias("url_id"), "url")
    return refs.where(F.col("site_id") == site).join(broken, "url_id").groupBy("element_id", "url_id").agg(F.min("id").alias("ref_id"), F.first("url").alias("url")).select("element_id", "url", "ref_id")


def console_totals(urls: DataFrame, refs: DataFrame, due: DataFrame) -> DataFrame:
    """(name, n): addresses per verdict, references, internal and external addresses, addresses due."""
    kinds = F.when(F.col("is_internal"), "internal").otherwise("external")
    parts = [urls.groupBy(F.col("status").alias("name")), refs.groupBy(F.lit("references").alias("name")), urls.groupBy(kinds.alias("name")), due.groupBy(F.lit("due").alias("name"))]
    out = parts[0].agg(F.count("*").alias("n"))
    for p in parts[1:]:
        out = out.unionByName(p.agg(F.count("*").alias("n")))
    return out


def console_hosts(urls: DataFrame, k: int = 10) -> DataFrame:
    return urls.where("status in ('broken', 'unreachable')").groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(k)


def incremental_cutoff(scans: DataFrame, sites: list[int]) -> DataFrame:
    """One row (since): the earliest of the sites' last complete scans; null where a site has none."""
    spark = scans.sparkSession
    every = spark.createDataFrame([(s,) for s in sites], "site long")
    done = scans.where("status = 'complete' and mode in ('full', 'incremental')").select(F.explode(F.when(F.col("site_id").isNull(), F.array(*map(F.lit, sites)).cast("array<long>")).otherwise(F.array("site_id"))).alias("site"), "date_started")
    last = every.join(done.groupBy("site").agg(F.max("date_started").alias("latest")), "site", "left")
    return last.agg(F.when(F.count("*") == F.count("latest"), F.min("latest")).alias("since"))


def latest_scan(scans: DataFrame) -> DataFrame:
    last = scans.where("status in ('complete', 'cancelled') and mode in ('full', 'incremental')").orderBy(F.desc_nulls_last("date_finished"), F.desc("id")).limit(1)
    seconds = F.unix_timestamp("date_finished") - F.unix_timestamp("date_started")
    return last.select("id", "mode", "status", F.greatest(F.lit(0).cast("long"), seconds).alias("seconds"))


def ignored(ignores: DataFrame, urls: DataFrame, refs: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """What people ignored: rows whose address is not stored or still has references, with who did it."""
    held = refs.select(F.col("url_id").alias("__ref")).distinct()
    u = urls.select(F.col("url_hash").alias("__hash"), F.col("id").alias("__url"), "status")
    out = ignores.join(u, F.col("url_hash") == F.col("__hash"), "left").join(held, F.col("__url") == F.col("__ref"), "left").where("__url is null or __ref is not null")
    if users is not None:
        out = out.join(users.select(F.col("id").alias("user_id"), "name"), "user_id", "left")
    return out.drop("__hash", "__url", "__ref")


def references(refs: DataFrame, url_id: int, sites: list[int], can_view=None, k: int = 100) -> DataFrame:
    """The places of an address; those that the reader may not see are there without their page."""
    out = refs.where((F.col("url_id") == url_id) & F.col("site_id").isin(*sites)).orderBy("site_id", "id").limit(k)
    seen = F.lit(True) if can_view is None else can_view
    return out.select("id", F.when(seen, F.col("element_id")).alias("element_id"), "site_id", "source")


def places_sum(top: DataFrame) -> DataFrame:
    return top.agg(F.coalesce(F.sum("places"), F.lit(0)).cast("long").alias("places"))


def readable(urls: DataFrame, refs: DataFrame, sites: list[int]) -> DataFrame:
    """Addresses that a reader of the sites may open: some reference is on one of them."""
    return scoped(urls, refs, sites)
