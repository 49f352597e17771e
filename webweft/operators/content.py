"""Links of structured content: field values of several kinds, read element by element through all that is nested.

A field's value says by its kind how it is stored: `html` (rich text), `text`, and as JSON `link` (one typed object), `links`
(an array of typed objects), `relation` and `nested` (arrays of ids), `table` (rows of cells).  JSON is read as variant, so one
column holds all shapes, and what has the wrong shape gives no link.  A value that cannot be read is one row with a problem;
it stops neither its element nor the walk.

The walk goes level by level, first over elements alone: those that any root reaches for the first time are read (each text
once, however many roots reach it), what they nest (by field or inside a rich text) is the next level.  Then every root
follows what was read.  Cycles end at the deepest level, and an element counts once a root and site; what is not live is not
entered; all links belong to the root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import url as U
from ..sources.staging import discard, stored
from . import extract

#: Types of a link object that point at an element, and kinds of fields that are stored as JSON.
ELEMENT_TYPES = ("entry", "asset", "category", "product", "variant", "user")
JSON_KINDS = ("link", "links", "relation", "nested", "table")
KEY = ("element_id", "site_id", "field_uid", "field_handle", "pos")
_ITEM = "struct<what:string,href:string,target_id:bigint,text:string>"


@dataclass(frozen=True)
class Reading:
    """What is looked for: images and iframes in rich texts, addresses in plain texts and tables, relation fields; fields that
    are left out (by uid); how deep content may nest."""

    images: bool = True
    iframes: bool = False
    plain: bool = True
    relations: bool = True
    excluded: tuple[str, ...] = ()
    deepest: int = extract.DEEPEST


def _item(what: str, href: Column | None = None, target: Column | None = None, text: Column | None = None) -> Column:
    none = F.lit(None)
    parts = [F.lit(what).alias("what"), (none if href is None else href).cast("string").alias("href"), (none if target is None else target).cast("long").alias("target_id"), (none if text is None else text).cast("string").alias("text")]
    return F.struct(*parts).cast(_ITEM)


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _listed(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _kind_of(v: Column) -> Column:
    """The last part of an object's type, in lower case."""
    return F.lower(F.regexp_extract(_text(v, "$.type"), r"([^\\]*)$", 1))


def _number(text: Column) -> Column:
    return F.when(F.btrim(text).rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), F.regexp_extract(text, "([+-]?[0-9]+)", 1).try_cast("long"))


def link_object(v: Column) -> Column:
    """The items of one link object {type, value, label}: an element by its reference, or an address."""
    value, label, target = _text(v, "$.value"), _text(v, "$.label"), extract.value_target(_text(v, "$.value"))
    element = F.when(target.isNotNull(), F.array(_item("element", value, target, label)))
    return F.when(_kind_of(v).isin(*ELEMENT_TYPES), element).otherwise(F.array(_item("link", value, None, label)))


def collection_object(v: Column) -> Column:
    """The item of one object {type, linkValue, linkText} of a collection; null where it is none.  An element's value is its
    id, alone or first in an array."""
    first = F.coalesce(_text(v, "$.linkValue[0]"), _text(v, "$.linkValue"))
    target, text = _number(first), _text(v, "$.linkText")
    element = F.when(target.isNotNull(), _item("element", U.stand_in(target), target, text))
    return F.when(_kind_of(v).isin(*ELEMENT_TYPES), element).when(_text(v, "$.type").isNotNull() & _text(v, "$.linkValue").isNotNull(), _item("link", _text(v, "$.linkValue"), None, text))


def _ids(v: Column) -> Column:
    return F.filter(F.transform(_listed(v), lambda e: F.try_variant_get(e, "$", "long")), lambda i: i.isNotNull())


def _cells(v: Column) -> Column:
    """The texts among a table's cells; a row is an array or an object."""
    rows = F.transform(_listed(v), lambda r: F.coalesce(_listed(r), F.map_values(F.try_variant_get(r, "$", "map<string,variant>")), F.array().cast("array<variant>")))
    return F.transform(F.filter(F.flatten(rows), lambda c: F.schema_of_variant(c) == "STRING"), lambda c: F.try_variant_get(c, "$", "string"))


def _plain(texts: Column) -> Column:
    found = F.filter(F.transform(texts, extract.plain_text), lambda t: t.isNotNull())
    return F.transform(found, lambda t: _item("link", t))


def typed(fields: DataFrame, how: Reading = Reading()) -> DataFrame:
    """(element_id, site_id, field_uid, field_handle, pos, n, what, href, target_id, text, problem), a row for each thing that a
    value of fields(those and kind, value) holds, n its place in the value.  what is link, element, relation or nested; a
    value that cannot be read is one row with a problem and no what.  Null and empty values hold nothing."""
    rows = fields.select(*KEY, "kind", "value").where("value is not null and value <> ''")
    if how.excluded:
        rows = rows.where(~F.coalesce(F.col("field_uid").isin(*how.excluded), F.lit(False)))
    body = L.bodies(rows.where("kind = 'html'"), "value", how.images, how.iframes)
    links = F.transform("links", lambda x: _item("link", x["href"], None, x["text"]))
    body = body.select(*KEY, F.concat(links, F.transform("entries", lambda e: _item("nested", None, e))).alias("items"), F.lit(None).cast("string").alias("problem"))

    none, v = F.array().cast(f"array<{_ITEM}>"), F.col("v")
    rest = rows.where("kind <> 'html'").withColumn("v", F.when(F.col("kind").isin(*JSON_KINDS), F.try_parse_json("value")))
    is_list = F.col("kind").isin("links", "relation", "nested", "table")
    bad = F.when(F.col("kind").isin(*JSON_KINDS) & v.isNull(), "not JSON").when(is_list & _listed(v).isNull(), "not a list").when((F.col("kind") == "link") & _text(v, "$.type").isNull(), "no type")
    items = (
        F.when(F.col("kind") == "link", link_object(v))
        .when(F.col("kind") == "links", F.filter(F.transform(_listed(v), collection_object), lambda i: i.isNotNull()))
        .when((F.col("kind") == "relation") & F.lit(how.relations), F.transform(_ids(v), lambda i: _item("relation", U.stand_in(i), i)))
        .when(F.col("kind") == "nested", F.transform(_ids(v), lambda i: _item("nested", None, i)))
        .when((F.col("kind") == "text") & F.lit(how.plain), _plain(F.array("value")))
        .when((F.col("kind") == "table") & F.lit(how.plain), _plain(_cells(v)))
    )
    rest = rest.withColumn("problem", bad).select(*KEY, F.when(F.col("problem").isNull(), F.coalesce(items, none)).otherwise(none).alias("items"), "problem")
    out = body.unionByName(rest).select(*KEY, "problem", F.posexplode_outer("items").alias("n", "item")).where("item is not null or problem is not null")
    return out.select(*KEY, "n", "item.*", "problem")


def live(elements: DataFrame) -> DataFrame:
    """(element_id, site_id) of elements(id, site_id, enabled, enabled_for_site) that may be entered; a site that says nothing
    allows it."""
    return elements.where("enabled and coalesce(enabled_for_site, true)").select(F.col("id").alias("element_id"), "site_id").distinct()


def walked(roots: DataFrame, fields: DataFrame, elements: DataFrame, how: Reading = Reading()) -> tuple[DataFrame, DataFrame]:
    """What is reached from roots(element_id, site_id), as (root, site_id, element_id, depth), each once a root and site, at its
    least depth; and typed() of the fields of all that is reached."""
    on, alive = ["element_id", "site_id"], live(elements)
    fresh = stored(roots.select(*on).distinct(), "fresh")
    read, found, edges = fresh, None, None
    for depth in range(how.deepest + 1):
        # What a hash table holds is keys; the values, which are long, are not sorted.
        new = stored(typed(fields.join(fresh.hint("shuffle_hash"), on, "left_semi"), how), "content")
        found = new if found is None else found.unionByName(new)
        into = new.where("what = 'nested'").select(F.col("element_id").alias("__from"), F.col("target_id").alias("element_id"), "site_id").distinct()
        into = stored(into.join(alive, on, "left_semi"), "edges")
        edges = into if edges is None else edges.unionByName(into)
        if depth < how.deepest:
            fresh = stored(into.select(*on).distinct().join(read, on, "left_anti"), "fresh")
            if fresh.isEmpty():
                break
            read = read.unionByName(fresh)

    level = stored(roots.select(F.col("element_id").alias("root"), "site_id", "element_id", F.lit(0).alias("depth")).distinct(), "level")
    seen = level
    for depth in range(1, how.deepest + 1):
        step = level.select("root", "site_id", F.col("element_id").alias("__from")).join(edges, ["__from", "site_id"]).select("root", "site_id", "element_id").distinct()
        level = stored(step.withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    # What a root meets again on its way is sorted out once, not by a join with all that was met at each level.
    return stored(seen.groupBy("root", "site_id", "element_id").agg(F.min("depth").alias("depth")), "reached"), found


def links(reached: DataFrame, found: DataFrame, elements: DataFrame, sites: DataFrame, strip: bool = True, fragments: bool = False, idn: bool = False) -> DataFrame:
    """A row for each link of walked(): root (the owner), site_id, element_id, field_uid, field_handle, pos, n, kind, url, raw_href,
    target_id, link_text.

    An address is taken as the root's own page would take it (elements(id, site_id, url, title)), else the site's base
    (sites(site_id, handle, base_url)).  Elements and relations have their target's own address, else a stand-in; a relation
    whose target is not there has no row.  A reference tag's target is looked up at the site it names, by number or handle."""
    own = elements.select(F.col("id").alias("__id"), F.col("site_id").alias("__site"), F.col("url").alias("__own"), F.col("title").alias("__title"))
    base = sites.select("site_id", F.col("base_url").alias("__base"))
    reached = reached.select("root", F.col("element_id").alias("__element"), F.col("site_id").alias("__here"))
    things = found.where("what <> 'nested'").drop("problem").withColumn("__here", F.col("site_id"))
    kept = [*KEY, "n", "__here"]
    met = lambda rows, by: rows.join(by, (F.col("element_id") == F.col("__element")) & (rows["__here"] == by["__here"])).drop("__element", by["__here"])
    typed_in = things.where("what = 'link'").withColumn("__leans", extract.leans(F.col("href"))).withColumn("__rooted", extract.rooted(F.col("href"))).drop("what", "target_id")

    # What no root changes is worked out once, however many roots there are: an address that stands alone once, one that
    # begins at the top of a host once a host, and only one that leans on the page itself for each root.
    page = F.coalesce("__own", "__base")
    pages = own.join(base.withColumnRenamed("site_id", "__site"), "__site", "left").select(F.col("__id").alias("root"), F.col("__site").alias("__here"), page.alias("base"), U.top_of(page).alias("top"))
    bare = base.select(F.col("site_id").alias("__here"), F.col("__base"), U.top_of(F.col("__base")).alias("__top"))
    pages = reached.join(pages, ["root", "__here"], "left").join(bare, "__here", "left")
    pages = pages.select("root", "__element", "__here", F.coalesce("base", "__base").alias("base"), F.coalesce("top", F.when(F.col("base").isNull(), F.col("__top"))).alias("top"))
    made = lambda rows, *more: extract.records(rows.select(*more, *kept, "href", "text", "base"), sites, strip, fragments, idn=idn)
    leaning = made(met(typed_in.where("__leans and not __rooted"), pages.drop("top")), "root")
    tops = pages.select("__element", "__here", "top").where("top is not null")
    rooted = made(met(typed_in.where("__leans and __rooted"), tops.distinct()).withColumn("base", F.col("top")), "top")
    roots = pages.select("root", F.col("__element").alias("element_id"), F.col("__here"), "top")
    leaning = leaning.unionByName(rooted.join(roots, ["element_id", "__here", "top"]).drop("top"))
    settled = typed_in.where("not __leans").select(*kept, "href", "text", F.lit(None).cast("string").alias("base"))
    settled = extract.records(settled, sites, strip, fragments, idn=idn, targets=elements, sites=sites)

    pointed = things.where("what <> 'link'").join(own, (F.col("target_id") == F.col("__id")) & (F.col("site_id") == F.col("__site")), "left").join(base, "site_id", "left")
    pointed = pointed.where("what = 'element' or __id is not null")
    relation = F.col("what") == "relation"
    url = F.coalesce(U.normalised(F.col("__own"), F.col("__base"), strip), F.when(relation, U.stand_in(F.col("target_id"), True)).otherwise(U.stand_in(F.col("target_id"))))
    pointed = pointed.select(*kept, F.col("what").alias("kind"), url.alias("url"), F.col("href").alias("raw_href"), "target_id", U.tidy_text(F.when(relation, F.col("__title")).otherwise(F.col("text"))).alias("link_text"))
    return met(settled.unionByName(pointed), reached).unionByName(leaning).drop("__here")


def problems(reached: DataFrame, found: DataFrame) -> DataFrame:
    """(element_id, site_id, field_handle, problem, roots): values that could not be read, and how many roots reach each."""
    bad = found.where("problem is not null").select("element_id", "site_id", "field_handle", "pos", "problem").distinct()
    # A root reaches an element once, so that roots are counted before they meet the values.
    return bad.join(reached.groupBy("element_id", "site_id").agg(F.count("root").alias("roots")), ["element_id", "site_id"])
