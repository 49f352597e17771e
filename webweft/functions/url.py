"""Canonical form of addresses, as column expressions.

An address is split with the generic URI pattern rather than a parser, so hosts with underscores and addresses
with spaces survive.  Everything here is native; nothing leaves the JVM."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameters that only track visitors, and the schemes that can or need not be checked.
TRACKING = ("_hsenc", "_hsmi", "dclid", "fbclid", "gbraid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "ttclid", "wbraid", "yclid")
TRACKING_PREFIX = "utm_"
CHECKABLE = ("http", "https")
SKIPPABLE = ("data", "javascript", "mailto", "sms", "tel")

PARTS = "^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"
BLANK = " \t\n\r\x00\x0b"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; '' where absent."""
    return F.regexp_extract(url, "(?s)" + PARTS, group)


def _entities() -> Column:
    """Map of the HTML5 entity names (with their semicolons) to their texts; a constant of the plan."""
    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def named(value: Column, use) -> Column:
    """use(value), with value worked out once and not spelled out at each use: an array of one element gives it a name."""
    return F.element_at(F.transform(F.array(value), use), 1)


def entities_decoded(s: Column) -> Column:
    """Character references that end in a semicolon, named or numeric, in one pass; anything else stays."""

    def number(name: Column) -> Column:
        code = F.when(name.rlike("^#[0-9]{1,7}$"), F.substring(name, F.lit(2), F.length(name)).cast("int")).when(name.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10).cast("int"))
        known = lambda n: (n.between(32, 0x10FFFF) | n.isin(9, 10, 13)) & ~n.between(0x7F, 0x9F) & ~n.between(0xD800, 0xDFFF)
        return named(code, lambda n: F.when(known(n), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))

    def one(piece: Column) -> Column:
        def with_name(name: Column) -> Column:
            text = F.when(piece.contains(";") & (F.length(name) <= 40), F.coalesce(number(name), F.element_at(_entities(), name)))
            return named(text, lambda t: F.when(t.isNotNull(), F.concat(t, F.substring(piece, F.length(name) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece)))

        return named(F.substring_index(piece, ";", 1), with_name)

    def joined(pieces: Column) -> Column:
        return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), one), ""))

    return F.when(s.contains("&"), named(F.split(s, "&"), joined)).otherwise(s)


def clean(href: Column) -> Column:
    """Line breaks and tabs out, blanks off both ends, entities decoded (one pass, semicolon needed)."""
    flat = F.btrim(F.translate(href, "\t\n\r", ""), F.lit(BLANK))
    return named(flat, lambda f: F.btrim(entities_decoded(f), F.lit(BLANK)))


def _kind(h: Column) -> Column:
    scheme = F.lower(F.regexp_extract(h, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    by_scheme = named(scheme, lambda s: F.when(s == "", "checkable").when(s.isin(*CHECKABLE), "checkable").when(s.isin(*SKIPPABLE), "skippable").otherwise("unknown"))
    return F.when((h == "") | h.startswith("#"), "skippable").when(h.isNotNull(), by_scheme)


def scheme_kind(href: Column) -> Column:
    """checkable, skippable or unknown; entities and line breaks inside do not hide a scheme."""
    return named(clean(href), _kind)


def percent_normalised(s: Column) -> Column:
    """%hh of an unreserved character becomes the character, any other %hh upper case; one pass."""

    def one(piece: Column) -> Column:
        code = F.substring(piece, 1, 2)
        char = F.char(F.conv(code, 16, 10).cast("int"))
        rest = F.substring(piece, F.lit(3), F.length(piece))
        plain = char.rlike("^[A-Za-z0-9._~-]$")
        return F.when(~code.rlike("^[0-9A-Fa-f]{2}$"), F.concat(F.lit("%"), piece)).when(plain, F.concat(char, rest)).otherwise(F.concat(F.lit("%"), F.upper(code), rest))

    joined = lambda pieces: F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), one), ""))
    return named(F.split(s, "%"), joined)


def dots_removed(path: Column) -> Column:
    """'.' segments dropped, '..' takes the one before, never past the root; empty segments stay."""

    def step(done: Column, seg: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(seg == ".", done).when(seg == "..", up).otherwise(F.concat(done, F.array(seg)))

    done = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return named(F.array_join(done, "/"), lambda out: F.when(out == "", "/").otherwise(out))


def normalised_path(path: Column) -> Column:
    return dots_removed(percent_normalised(F.replace(F.when(path == "", "/").otherwise(path), F.lit(" "), F.lit("%20"))))


def normalised_query(query: Column, strip: bool = True) -> Column:
    """Empty and tracking pairs dropped, order and repeats kept; null where nothing is left."""
    # A name may be percent-encoded; a plus stays a plus.
    name = lambda p: F.lower(percent_decoded(F.substring_index(p, "=", 1)))
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    if strip:
        pairs = F.filter(pairs, lambda p: ~(name(p).isin(*TRACKING) | name(p).startswith(TRACKING_PREFIX)))
    return named(percent_normalised(F.replace(F.array_join(pairs, "&"), F.lit(" "), F.lit("%20"))), lambda out: F.when(out != "", out))


def host_of(url: Column) -> Column:
    authority = F.regexp_replace(part(url, 2), "^.*@", "")
    return F.lower(F.regexp_replace(authority, ":[0-9]*$", ""))


def port_of(url: Column) -> Column:
    """The port unless it is the scheme's own."""
    port = F.regexp_extract(part(url, 2), ":([0-9]+)$", 1)
    own = ((F.lower(part(url, 1)) == "http") & (port == "80")) | ((F.lower(part(url, 1)) == "https") & (port == "443"))
    return F.when((port == "") | own, "").otherwise(F.concat(F.lit(":"), port))


def is_relative(href: Column) -> Column:
    """Whether an address can be checked and has no scheme of its own, so that normalised() asks for a base."""
    return named(clean(href), lambda ref: (_kind(ref) == "checkable") & ~ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))


def top_of(url: Column) -> Column:
    """Scheme and authority, all that an address beginning with a slash takes of its base; null where there is no authority."""
    return F.when(part(url, 2) != "", F.concat(part(url, 1), F.lit("://"), part(url, 2)))


def absolute(ref: Column, base: Column) -> Column:
    """ref against base."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    path = part(base, 3)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(base.isNull() | (part(base, 2) == ""), F.lit(None).cast("string"))
        .when(ref.startswith("//"), F.concat(part(base, 1), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref.startswith("?"), F.concat(root, F.when(path == "", "/").otherwise(path), ref))
        .otherwise(F.concat(root, folder, ref))
    )


def ascii_host(host: Column) -> Column:
    """The host in letters of DNS: where it has others, mapped (case, width, composition) and in punycode by the JVM's own
    IDNA function, '' where that refuses it."""
    other = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host, F.lit(1))  # 1: letters younger than the tables pass
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.coalesce(F.lower(other), F.lit(""))).otherwise(host)


FITS = (r"^[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?(\.[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?)*\.?$", r"^\[[0-9a-f:.]+\]$")


def _spelled(p: Column, strip: bool) -> Column:
    whole = F.concat(p["scheme"], F.lit("://"), p["host"], p["port"], normalised_path(p["path"]), F.coalesce(F.concat(F.lit("?"), normalised_query(p["query"], strip)), F.lit("")))
    fits = p["host"].rlike(FITS[0]) | p["host"].rlike(FITS[1])
    return F.when(p["scheme"].isin(*CHECKABLE) & fits & (F.length(p["host"]) <= 253), whole)


def _parts(url: Column, host: Column) -> Column:
    return F.struct(F.lower(part(url, 1)).alias("scheme"), host.alias("host"), port_of(url).alias("port"), part(url, 3).alias("path"), part(url, 4).alias("query"))


def _whole(href: Column, base: Column | None) -> Column:
    base = F.lit(None).cast("string") if base is None else base
    return named(clean(href), lambda ref: F.when(_kind(ref) == "checkable", absolute(ref, base)))


def normalised(href: Column, base: Column | None = None, strip: bool = True) -> Column:
    """The address in canonical form, its host in punycode; null where there is none to check."""
    return named(_whole(href, base), lambda url: named(_parts(url, ascii_host(host_of(url))), lambda p: _spelled(p, strip)))


def with_normalised(df: DataFrame, name: str, href: Column, base: Column | None = None, strip: bool = True) -> DataFrame:
    """df with the canonical address as a column."""
    return df.withColumn(name, normalised(href, base, strip))


def percent_decoded(s: Column) -> Column:
    """%hh decoded; a plus stays a plus; text with a broken escape stays as it is."""
    return F.when(s.contains("%"), F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)).otherwise(s)


def fragment_of(url: Column) -> Column:
    """What follows the first #, null where empty."""
    return F.nullif(F.when(url.contains("#"), F.substring(url, F.instr(url, "#") + 1, F.length(url))), F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def with_fragment(url: Column, href: Column) -> Column:
    """The normalised address with the fragment its href had, unless that selects text (:~:)."""
    again = lambda f: F.concat(without_fragment(url), F.lit("#"), percent_normalised(F.replace(f, F.lit(" "), F.lit("%20"))))
    return named(named(clean(href), fragment_of), lambda f: F.when(f.isNull() | f.startswith(":~:"), url).otherwise(again(f)))


def scheme_of(url: Column) -> Column:
    return F.coalesce(F.lower(part(url, 1)), F.lit(""))


def without_credentials(href: Column) -> Column:
    return F.regexp_replace(href, "(?i)^([a-z][a-z0-9+.-]*://)[^/?#@]*@", "$1")


def authority_of(url: Column) -> Column:
    """Host and any port but the scheme's own, for comparing sites; null where there is no host."""
    return named(clean(url), lambda u: F.when(host_of(u) != "", F.concat(host_of(u), port_of(u))))


#: Schemes of stand-ins for addresses that content has not.
STAND_INS = ("element", "relation")


def stand_in(target: Column, relation: bool = False) -> Column:
    return F.concat(F.lit(STAND_INS[relation] + ":"), target.cast("string"))


def stand_in_scheme(url: Column) -> Column:
    """element or relation where the address is a stand-in, else null."""
    return F.nullif(F.regexp_extract(url, "^(element|relation):", 1), F.lit(""))


#: Fixed value: the page address that stands for a site's home.
HOME = "__home__"


def uri_for(url: Column, base_url: Column) -> Column:
    """The page address inside its site: decoded path without the site's own (a plain prefix), slashes off both ends."""
    path = percent_decoded(part(url, 3))
    base = F.regexp_replace(part(base_url, 3), "/+$", "")
    inner = F.when((base != "") & path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)
    uri = F.btrim(inner, F.lit("/"))
    return F.when(uri == "", HOME).otherwise(uri)


def clipped(c: Column, width: int) -> Column:
    return F.substring(c, 1, width)


def numeric_host(host: Column) -> Column:
    """A host that is a number, which a resolver and a client may take for different things."""
    return host.rlike("(?i)^([0-9]+|0x[0-9a-f]+)$")


def openable(url: Column) -> Column:
    return scheme_of(url).isin(*CHECKABLE)


def fingerprint(url: Column) -> Column:
    return F.sha1(url)


def tidy_text(s: Column) -> Column:
    """White space (of any script) to single blanks, trimmed, null where empty, 255 characters."""
    return F.substring(F.nullif(F.trim(F.regexp_replace(s, "(?U)\\s+", " ")), F.lit("")), 1, 255)


def labels(col: Column, names: dict[str, str]) -> Column:
    return reduce(lambda c, kv: c.when(col == kv[0], kv[1]), list(names.items())[1:], F.when(col == next(iter(names)), names[next(iter(names))]))
