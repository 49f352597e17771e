"""What codes are called on screen, in exports and in messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import host_of, labels, part, stand_in_scheme

# Texts of the screens.
STATUS = {"pending": "Not checked yet", "ok": "Working", "broken": "Broken", "redirect": "Redirect", "unreachable": "No Answer", "blocked": "Unverifiable", "ignored": "Ignored", "unsafe": "Not safe to request"}
COLOUR = {"ok": "green", "redirect": "blue", "broken": "red", "unsafe": "red", "unreachable": "orange", "blocked": "yellow", "ignored": "grey", "pending": "light"}
MODE = {"full": "Everything", "incremental": "Only what changed", "single": "One item", "check-only": "URLs only"}
SCAN = {"queued": "Waiting to start", "extracting": "Reading the content", "checking": "Checking the URLs", "complete": "Finished", "failed": "Failed", "cancelled": "Cancelled"}
SOURCE = {"field": "A field", "nav": "A navigation", "rendered": "A page template"}
ANSWER = {
    200: "Answered normally",
    301: "Moved permanently: update the link to the new address",
    302: "Moved temporarily: the old address is still the right one",
    307: "Moved temporarily: the old address is still the right one",
    308: "Moved permanently: update the link to the new address",
    400: "The server could not make sense of the request",
    401: "Needs a login to see",
    403: "The server refused the request",
    404: "Not found: nothing lives at that address",
    410: "Gone: taken down on purpose",
    429: "The server asked to be asked less often",
    500: "The server hit an error of its own",
    502: "A server in the middle failed to pass the request on",
    503: "The server could not take the request just then",
    504: "A server in the middle gave up waiting",
    999: "A made-up code some sites use to refuse robots",
}
ANSWER_CLASS = {2: "Answered normally", 3: "A redirect", 4: "The server refused it or could not find it", 5: "The server had a problem"}
ANSWER_ELSE = "A code outside the usual run of things"
REASON = {
    "connect": "Could not connect",
    "dns": "Could not find that domain",
    "fragment": "Missing anchor on the page",
    "host-backoff": "Host asked to be left alone for a while",
    "http": "The server answered with an error",
    "ignored": "Ignored by a person",
    "ignore-rule": "Ignored by a rule in the settings",
    "setting": "Not checked, per the settings",
    "no-element": "Nothing on this site answers to it",
    "private-ip": "Not safe to request",
    "rate-limited": "The host asked us to ease off",
    "ssl": "A problem with the security certificate",
    "timeout": "Timed out",
    "unsafe-scheme": "Not an http or https address",
}


def status_label(status: Column) -> Column:
    return labels(status, STATUS)


def status_colour(status: Column) -> Column:
    return labels(status, COLOUR)


def http_status_label(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, text in ANSWER.items():
        out = F.when(code == k, text).otherwise(out)
    by_class = F.lit(ANSWER_ELSE)
    for k, text in ANSWER_CLASS.items():
        by_class = F.when(F.floor(code / 100) == k, text).otherwise(by_class)
    return F.when(code.isNotNull(), F.coalesce(out, by_class))


def reason_label(reason: Column) -> Column:
    """Null for none; a code without a label is shown as it is."""
    return F.when(reason != "", F.coalesce(labels(reason, REASON), reason))


def plain_message(message: Column) -> Column:
    """A client's error without its number and its pointer to the manual; the original where nothing else is left."""
    prefix, docs = r"(?i)^curl error \d+:\s*", r"(?i)\s*\(see https?://[^)]*\).*$"
    plain = F.trim(F.regexp_replace(F.regexp_replace(message, prefix, ""), docs, ""))
    return F.when(message == "", F.lit(None).cast("string")).when(message.rlike(prefix) & (plain != ""), plain).otherwise(message)


def panel_label(url: Column, own_host: Column, most: int = 44, head: int = 26, tail: int = 17) -> Column:
    """The address for a narrow panel: path and query on an own site, the middle left out where long."""
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    query = F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise("")
    label = F.when(own_host, F.concat(path, query)).otherwise(url)
    return F.when(F.length(label) > most, F.concat(F.substring(label, 1, head), F.lit("…"), F.right(label, F.lit(tail)))).otherwise(label)


def url_label(url: Column, title: Column) -> Column:
    """A stand-in goes by its target's title (itself where the target is gone), an address by itself."""
    return F.when(stand_in_scheme(url).isNotNull(), F.coalesce(title, url)).otherwise(url)


def element_type_label(kind: Column, names: dict[str, str]) -> Column:
    return F.coalesce(labels(kind, names), kind)


def field_name(handle: Column, layout_label: Column, nested: Column, block_type: Column, global_name: Column) -> Column:
    """The name an editor knows a field by: its layout's label, the block's type where that hides it, the field's own name,
    its handle."""
    shown = F.when((layout_label != "") & (layout_label != "__blank__"), layout_label)
    hidden = F.when(layout_label.isNotNull() & shown.isNull() & nested, block_type)
    return F.when(handle.isNotNull(), F.coalesce(shown, hidden, global_name, handle))


def edit_url(url: Column, ref_id: Column, element_id: Column, owner_id: Column, handle: Column, block_handle: Column, precise: bool = False) -> Column:
    """Where a reference is edited: the page's screen, with a fragment for the reference, the block or the field."""
    if precise:
        return F.concat(url, F.lit("#la-ref-"), ref_id.cast("string"))
    nested = F.coalesce(owner_id != element_id, F.lit(False))
    block = F.concat(url, F.lit("#la-block-"), element_id.cast("string"), F.coalesce(F.concat(F.lit("--"), block_handle), F.lit("")))
    field = F.trim(F.coalesce(handle, F.lit("")))
    return F.when(nested, block).when(field == "", url).otherwise(F.concat(url, F.lit("#la-field-"), field))


def own_host(url: Column, bases: list[str]) -> Column:
    hosts = sorted({b.split("://", 1)[-1].split("/", 1)[0].split(":", 1)[0].lower() for b in bases})
    return host_of(url).isin(*hosts)
