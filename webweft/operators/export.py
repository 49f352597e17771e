"""The CSV export and the notification text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.url import BLANK

# The headings, the byte order mark and the characters that begin a formula.
HEADER = ("Page", "Edit URL", "Page URL", "Page Type", "Site", "Field", "Link Text", "URL", "Verdict", "Reason", "Response Code", "Redirect Code", "Goes To", "Host", "Found Via", "Places Total", "First Seen", "Last Checked")
REDIRECT_ONLY = ("Redirect Code", "Goes To")
BOM, EOL = "﻿", "\r\n"
FORMULA = ("=", "+", "-", "@", "\t", "\r")


def header(status: str) -> list[str]:
    return [h for h in HEADER if status == "redirect" or h not in REDIRECT_ONLY]


def filename(status: str, day: str) -> str:
    return f"link-audit-{re.sub('[^a-z0-9]+', '-', L.STATUS[status].lower()).strip('-')}-{day}.csv"


def cell(value: Column) -> Column:
    """Text of a cell: null is empty, what a spreadsheet would take for a formula gets a quote in front."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.substring(text, 1, 1).isin(*FORMULA), F.concat(F.lit("'"), text)).otherwise(text)


def quoted(text: Column) -> Column:
    """In double quotes where it holds a delimiter, a quote or white space."""
    return F.when(text.rlike('[",\\n\\r\\t ]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def line(cells: list[Column]) -> Column:
    return F.concat_ws(",", *[quoted(cell(c)) for c in cells])


def iso(at: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), F.lit(""))


def files(urls: DataFrame, refs: DataFrame, site_ids: list[int], day: str) -> DataFrame:
    """(status, rows, filename, header) of the export of each verdict that an address on the sites has."""
    held = refs.where(F.col("site_id").isin(*site_ids)).groupBy(F.col("url_id").alias("id")).agg(F.count("*").alias("rows"))
    found = urls.join(held, "id").groupBy("status").agg(F.sum("rows").alias("rows"))
    name = F.concat(F.lit("link-audit-"), F.btrim(F.regexp_replace(F.lower(L.status_label(F.col("status"))), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(f"-{day}.csv"))
    top = F.when(F.col("status") == "redirect", ",".join(header("redirect"))).otherwise(",".join(header("")))
    return found.select("status", "rows", name.alias("filename"), top.alias("header"))


def rows(urls: DataFrame, refs: DataFrame, elements: DataFrame, sites: DataFrame, status: str, site_ids: list[int], **equal) -> DataFrame:
    """(id, line) of each reference on the sites to an address of the verdict; elements(id, title, edit_url, page_url)
    may lack a page, whose columns then stay blank."""
    held = refs.where(F.col("site_id").isin(*site_ids))
    for column, value in equal.items():
        held = held.where(F.col(column) == value)
    places = held.groupBy("url_id").agg(F.count("*").alias("places"))
    u = urls.where(F.col("status") == status).select(F.col("id").alias("url_id"), "url", "host", "status", "reason", "http_status", "redirect_status", "final_url", "date_first_seen", "date_last_checked")
    page = elements.select(F.col("id").alias("page_id"), "title", "edit_url", "page_url")
    found = held.join(u, "url_id").join(places, "url_id").withColumn("page_id", F.coalesce("owner_element_id", "element_id")).join(page, "page_id", "left").join(sites.select("site_id", F.col("handle").alias("site")), "site_id", "left")
    edit = L.edit_url(F.col("edit_url"), F.col("id"), F.col("element_id"), F.col("owner_element_id"), F.col("field_handle"), F.lit(None).cast("string"))
    cells = {
        "Page": F.col("title"),
        "Edit URL": edit,
        "Page URL": F.col("page_url"),
        "Page Type": F.col("element_type"),
        "Site": F.col("site"),
        "Field": F.col("field_handle"),
        "Link Text": F.col("link_text"),
        "URL": F.col("url"),
        "Verdict": L.status_label(F.col("status")),
        "Reason": L.reason_label(F.col("reason")),
        "Response Code": F.col("http_status").cast("int"),
        "Redirect Code": F.col("redirect_status").cast("int"),
        "Goes To": F.col("final_url"),
        "Host": F.col("host"),
        "Found Via": F.coalesce(L.labels(F.col("source"), L.SOURCE), F.col("source")),
        "Places Total": F.coalesce("places", F.lit(1)),
        "First Seen": iso(F.col("date_first_seen")),
        "Last Checked": iso(F.col("date_last_checked")),
    }
    return found.select("id", line([cells[h] for h in header(status)]).alias("line"))


def count(urls: DataFrame, refs: DataFrame, status: str, site_ids: list[int]) -> DataFrame:
    """Rows that the export has; none on no sites."""
    held = refs.where(F.col("site_id").isin(*site_ids)) if site_ids else refs.limit(0)
    return held.join(urls.where(F.col("status") == status).select(F.col("id").alias("url_id")), "url_id", "left_semi").agg(F.count("*").alias("n"))


def write(lines: DataFrame, status: str, path: str) -> None:
    """Part files in order of id, each line ended as CSV asks; the first begins with the mark and the headings."""
    from functools import reduce

    top = BOM + reduce(lambda a, b: f"{a},{b}", [f'"{h}"' if " " in h else h for h in header(status)])
    first = lines.sparkSession.createDataFrame([(-1, top)], "id long, line string")
    first.unionByName(lines.select("id", "line")).orderBy("id").select("line").write.option("lineSep", EOL).text(path)


def recipients(text: Column) -> Column:
    """Addresses of a setting: one a line or between commas, blanks and empty ones dropped."""
    return F.filter(F.transform(F.split(text, "[,\\r\\n]+"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")


def slack_text(text: Column) -> Column:
    out = text
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def broken(urls: DataFrame, refs: DataFrame, since: str | None = None, site: int | None = None) -> DataFrame:
    """Broken addresses that some reference holds, of a site or any; since: those that broke then or later."""
    held = refs if site is None else refs.where(F.col("site_id") == site)
    out = urls.where("status = 'broken'").join(held.select(F.col("url_id").alias("id")), "id", "left_semi")
    return out if since is None else out.where(F.col("date_last_broken") >= F.lit(since).cast("timestamp_ntz"))


# The message's subject, for one and for more, and who sends it.
SUBJECT, SENDER = ("One broken link on ", " broken links on "), "Link Audit"
def digest(found: DataFrame, site_name: str, report_url: str, threshold: int = 1, most: int = 20) -> DataFrame:
    """One row (total, body) where the threshold is reached, else none.  found(id, url, url_hash, http_status, reason,
    date_last_broken); listed are the `most` that broke last."""
    total = found.agg(F.count("*").alias("total"))
    last = found.orderBy(F.desc_nulls_last("date_last_broken"), "id").limit(most)
    note = F.coalesce(F.col("http_status").cast("int").cast("string"), L.reason_label(F.col("reason")), F.lit(""))
    text = F.concat(F.lit("- "), F.col("url"), F.when(note != "", F.concat(F.lit(" ("), note, F.lit(")"))).otherwise(""), F.lit(f"\n  {report_url}/url?hash="), F.col("url_hash"))
    order = F.struct(F.coalesce(-F.unix_timestamp("date_last_broken"), F.lit(1 << 60)).alias("a"), F.col("id").alias("b"), text.alias("t"))
    listed = last.agg(F.array_sort(F.collect_list(order)).alias("items"))
    n = F.col("total")
    came = F.when(n == 1, "one broken link came").otherwise(F.concat(n.cast("string"), F.lit(" broken links came")))
    top = F.concat(F.lit(f"The link scan on {site_name} has finished, and "), came, F.lit(" out of it.\n\n"))
    more = F.when(n > F.size("items"), F.concat(F.lit("\n\nAnd "), (n - F.size("items")).cast("string"), F.lit(" more."))).otherwise("")
    end = F.lit(f"\n\nThe note after each link is what the website said when it was asked. The full list, and the pages carrying each one, is here: {report_url}")
    body = F.concat(top, F.array_join(F.col("items.t"), "\n"), more, end)
    return total.crossJoin(listed).where(n >= max(1, threshold)).select(n.alias("total"), body.alias("body"))  # one row by one row


def messages(found: DataFrame, site_name: str, report_url: str, threshold: int = 1, most: int = 20) -> DataFrame:
    """digest() as it is sent: one row (subject, body, slack), or none.  slack is the JSON to post, with the three characters
    that have a meaning there written as entities."""
    n = F.col("total")
    subject = F.concat(F.when(n == 1, SUBJECT[0]).otherwise(F.concat(n.cast("string"), F.lit(SUBJECT[1]))), F.lit(site_name))
    out = digest(found, site_name, report_url, threshold, most).select(subject.alias("subject"), "body")
    text = F.concat(F.lit("*"), slack_text(F.col("subject")), F.lit("*\n"), slack_text(F.col("body")))
    return out.withColumn("slack", F.to_json(F.struct(F.lit(SENDER).alias("username"), text.alias("text"))))
