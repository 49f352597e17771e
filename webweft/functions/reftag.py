"""Reference tags {type:ref@site:attribute||fallback} as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME, _PART = r"([A-Za-z][A-Za-z0-9_\\]*)", r"([^@:|}]+)"
TAG = rf"^\{{{_NAME}:{_PART}(?:@([^:|}}]+))?(?::([^|}}]+))?(?:\|\|([^}}]*))?\}}(?:#.*)?$"


def parts(href: Column) -> dict[str, Column]:
    """type, ref, site, attribute and fallback of a tag, each null where absent; all null where href is no tag.
    Braces may be percent-encoded; a fragment may follow."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(href), "(?i)%7B", "{"), "(?i)%7D", "}")
    names = ("type", "ref", "site", "attribute", "fallback")
    return {n: F.nullif(F.regexp_extract(plain, TAG, k), F.lit("")) for k, n in enumerate(names, 1)}
