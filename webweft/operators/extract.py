"""From values of content to link records: one row a link, with its kind and canonical address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reftag
from ..functions import url as U
from ..sources.staging import stored
from . import resolve

#: How deep content may nest.
DEEPEST = 10
TAG_TYPES = ("entry", "asset", "category")


def _tagged(raw: Column) -> tuple[dict[str, Column], Column, Column]:
    """The parts of a reference tag, the element that it points at by number, and the address to read: the tag's fallback, or
    what is there."""
    tag = reftag.parts(raw)
    target = F.when(F.lower(tag["type"]).isin(*TAG_TYPES) & tag["ref"].rlike("^[0-9]{1,18}$"), tag["ref"].cast("long"))
    return tag, target, F.when(tag["type"].isNotNull(), tag["fallback"]).otherwise(raw)


def leans(href: Column) -> Column:
    """Whether the address that records() makes of href depends on its base."""
    _, target, address = _tagged(F.btrim(href, F.lit(U.BLANK)))
    return F.coalesce(target.isNull() & U.is_relative(address), F.lit(False))


def rooted(href: Column) -> Column:
    """Whether of its base an address that leans on one takes only scheme and host."""
    return F.coalesce(U.clean(_tagged(F.btrim(href, F.lit(U.BLANK)))[2]).startswith("/"), F.lit(False))


def records(found: DataFrame, bases: DataFrame, strip: bool = True, fragments: bool = False, rendered: bool = False, idn: bool = False, targets: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """found(href, text, base, ...) with kind, url, raw_href, target_id and link_text; rows without a link are left out.

    A reference tag to an entry, asset or category by number becomes a stand-in (kind element), any other one its fallback.
    With targets(id, site_id, url) and sites(site_id, handle, base_url) it becomes its target's own address at the site that
    it names by number or handle, else at the row's site_id, which is set to that site.
    Schemes that cannot be checked give an ignored row, without credentials, from content, and none from rendered pages.
    An internal address keeps its fragment where fragments are checked."""
    out = found.withColumn("__raw", F.btrim("href", F.lit(U.BLANK)))
    tag, target, address = _tagged(F.col("__raw"))
    out = out.withColumn("target_id", target).withColumn("__href", address)
    kind = U.scheme_kind(F.col("__href"))
    out = out.withColumn("__scheme", kind)
    out = U.with_normalised(out, "__url", F.col("__href"), F.col("base"), strip) if idn else out.withColumn("__url", U.normalised(F.col("__href"), F.col("base"), strip))
    out = resolve.internal(out.withColumn("url", F.col("__url")), bases)
    unknown = (F.col("__scheme") == "unknown") & F.col("__url").isNull() & (F.lit(not rendered))
    kind = F.when(F.col("target_id").isNotNull(), "element").when(F.col("__url").isNotNull(), F.when(F.col("is_internal"), "internal").otherwise("external")).when(unknown, "ignored")
    url = F.when(F.col("is_internal"), U.with_fragment(F.col("__url"), F.col("__href"))).otherwise(F.col("__url")) if fragments else F.col("__url")
    bare = U.without_credentials(F.col("__href"))
    out = out.withColumn("kind", kind).where("kind is not null")
    address = F.when(F.col("kind") == "element", U.stand_in(F.col("target_id"))).when(F.col("kind") == "ignored", bare).otherwise(url)
    raw = F.when(F.col("kind") == "ignored", bare).otherwise(F.col("__raw"))
    kept = [c for c in found.columns if c not in ("href", "text", "base", "url", "kind", "raw_href", "target_id", "link_text")]
    out = out.select(*kept, "kind", address.alias("url"), U.clipped(raw, 500).alias("raw_href"), "target_id", U.tidy_text(F.col("text")).alias("link_text"), tag["site"].alias("__named"))
    return out.drop("__named") if targets is None else at_targets(out, targets, sites, strip)


def at_targets(links: DataFrame, targets: DataFrame, sites: DataFrame, strip: bool = True) -> DataFrame:
    """links(site_id, kind, url, target_id, __named) with the address that the target of each link of kind element has at the
    site named (a number, or a handle that exists), else at the link's own site; the stand-in stays where it has none."""
    is_element = F.col("kind") == "element"
    number = F.when(F.col("__named").rlike("^[0-9]{1,18}$"), F.col("__named").cast("long"))
    by_handle = sites.select(F.lower("handle").alias("__handle"), F.col("site_id").alias("__by_handle"))
    out = links.join(by_handle, is_element & number.isNull() & (F.lower("__named") == F.col("__handle")), "left")
    out = out.withColumn("site_id", F.when(is_element, F.coalesce(number, "__by_handle", "site_id")).otherwise(F.col("site_id")))
    own = targets.select(F.col("id").alias("__id"), F.col("site_id").alias("__at"), F.col("url").alias("__own"))
    base = sites.select(F.col("site_id").alias("__site"), F.col("base_url").alias("__base"))
    # Links that have no target are many and would all meet in one task: each looks for a number of its own, in vain.
    sought = F.when(is_element, F.col("target_id")).otherwise(F.xxhash64("url"))
    out = out.join(own, is_element & (sought == F.col("__id")) & (F.col("site_id") == F.col("__at")), "left").join(base, F.col("site_id") == F.col("__site"), "left")
    return out.withColumn("url", F.when(is_element, F.coalesce(U.normalised(F.col("__own"), F.col("__base"), strip), "url")).otherwise(F.col("url"))).select(*(c for c in links.columns if c != "__named"))


def plain_text(value: Column) -> Column:
    """The address that a text is, as a whole; null where it is more or less than one."""
    text = F.btrim(value, F.lit(U.BLANK))
    return F.when(text.rlike("(?i)^https?://[^\\s]+$"), text)


def cells(table: DataFrame, rows: str = "rows") -> DataFrame:
    """table with a row for each cell (array of arrays of strings) that is an address: column href."""
    cell = table.withColumn("__row", F.explode(rows)).withColumn("__cell", F.explode("__row"))
    return cell.withColumn("href", plain_text(F.col("__cell"))).where("href is not null").drop("__row", "__cell", rows)


def element_links(links: DataFrame, targets: DataFrame, relation: bool = False) -> DataFrame:
    """links(target_id, ...) with kind and url: the target's own address (targets(id, url)) or a stand-in."""
    t = targets.select(F.col("id").alias("target_id"), F.col("url").alias("__url"))
    url = F.coalesce(U.normalised(F.col("__url")), U.stand_in(F.col("target_id"), relation))
    return links.join(t, "target_id", "left").withColumn("kind", F.lit("relation" if relation else "element")).withColumn("url", url).drop("__url")


def value_target(value: Column) -> Column:
    """The element that a link field's stored value {type:12@1:url} points at."""
    return F.regexp_extract(value, r"(?i)^\{[a-z]\w*:(\d{1,18})(?:@\d+)?:url\}$", 1).try_cast("long")


def navigation(nodes: DataFrame) -> DataFrame:
    """nodes(node_id, kind, target_id, raw_url, suffix, title, ...) to (node_id, target_id, href): passive nodes have no
    link; a typed address with a placeholder, a variable or an alias is left alone; a node of any further kind has the address
    that it gives itself (own_url, where there is such a column)."""
    typed = F.btrim("raw_url", F.lit(U.BLANK))
    plain = (typed != "") & ~typed.contains("{") & ~typed.contains("$") & ~typed.startswith("@")
    own = F.col("own_url") if "own_url" in nodes.columns else F.lit(None).cast("string")
    href = F.when((F.col("kind") == "custom") & plain, F.concat(typed, F.coalesce("suffix", F.lit("")))).when(~F.col("kind").isin("custom", "element"), F.nullif(F.btrim(own, F.lit(U.BLANK)), F.lit("")))
    out = nodes.where("kind <> 'passive'").select("node_id", "site_id", "title", F.when(F.col("kind") == "element", F.col("target_id")).alias("target_id"), href.alias("href"))
    return out.where("target_id is not null or href is not null")


def last_of_each(links: DataFrame, page: str = "page_id", url: str = "url", pos: str = "pos") -> DataFrame:
    """One row a page and address, the last one met (rendered pages)."""
    by = Window.partitionBy(page, url).orderBy(F.desc(pos))
    return links.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def walk(roots: DataFrame, nesting: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(root, element_id, depth) of everything nested in roots(element_id) by nesting(element_id, owner_id), each once a
    root, at its least depth; the root is depth 0 and owns all of it.  Cycles end where they began.

    One join a level; each level is written to the shared folder, so plans stay short."""
    edges = nesting.select("owner_id", F.col("element_id").alias("__child"))
    level = stored(roots.select(F.col("element_id").alias("root"), "element_id", F.lit(0).alias("depth")).distinct(), "level")
    seen = level
    for depth in range(1, deepest + 1):
        found = level.join(edges, F.col("element_id") == F.col("owner_id")).select("root", F.col("__child").alias("element_id")).distinct()
        level = stored(found.join(seen.select("root", "element_id"), ["root", "element_id"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
