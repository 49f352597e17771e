"""Secret scan, native: fixed credential patterns plus sliding-window Shannon entropy per character class.

Everything on the path is a DataFrame expression: regular expressions give matches and the gaps between them,
gap and match lengths add up to code-point offsets, and a fold over each candidate string keeps the window's
character counts incrementally.  Work is linear in the text's length: candidates are folded in pieces of PIECE
characters that overlap by a window, offsets are summed in groups, and what one rule has taken is blanked before
the next looks, so no span is compared with all others.  No pattern repeats a group, so Java's matcher does not
recurse and a text of any length is safe.

Defined cases: a null or empty text has no spans; rows pass one by one (no shuffle), so repeated rows, null ids and
empty tables need no care; columns of docs that bear the names of the two new ones are replaced."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, text_or_empty

ASSIGN = """(?i)(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # AKIA and everything after it, 20 characters or more
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")


@dataclass(frozen=True)
class EntropyClass:
    """Candidates are maximal runs of `alphabet` of `window` characters or more with a letter and a digit;
    a window whose entropy reaches `bits` is flagged; flagged windows that touch are one span."""

    kind: str
    chars: str
    alphabet: str
    window: int
    bits: float


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    EntropyClass("entropy_hex", "0-9A-Fa-f", _DIGITS + "abcdefABCDEF", 20, 3.0),
    EntropyClass("entropy_base64", "A-Za-z0-9+/_=-", _DIGITS + _LOWER + _LOWER.upper() + "+/_=-", 20, 3.75),
)
#: Literals (of fixed length) that are blanked before candidates are looked for: counting sequences, placeholders.
ALLOW_LITERALS = ("0123456789", "abcdefghij", "1234567890", "example", "placeholder", "xxxxxx", "your_", "your-")
#: Candidates that match one of these are never flagged: UUIDs, paths of words (with up to four digits at the end).
ALLOW = (
    "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "^/?(?=[A-Za-z]++[/_=-])[A-Za-z/_=-]*+(?<=[A-Za-z])[0-9]{0,4}$",
)
#: Characters of a candidate folded at a time, and matches whose offsets are summed at a time.
PIECE, GROUP = 4096, 256
_COUNT_BITS, _A_LONG = 5, 12  # counts up to 31, twelve to a long

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,found:string>>"
_RANGE = "array<struct<start:int,end:int>>"


def _named(value: Column, use) -> Column:
    """use(value), with value worked out once: an array of one element gives it a name."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _starts(gaps: Column, matches: Column) -> Column:
    """Where each match starts.  The k-th starts after the first k gaps and the matches between them; sums are taken
    inside groups of GROUP and over groups, so that no long array is copied once a match."""
    steps = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))

    def inside(group: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(group, zero, lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.array_append(a["out"], a["at"] + x["g"]).alias("out")))

    def grouped(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil((F.size(s) - 1) / GROUP).cast("int")), lambda k: inside(F.slice(s, k * GROUP + 1, GROUP)))

    def shifted(groups: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(groups, zero, lambda a, g: F.struct((a["at"] + g["at"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(groups, before, lambda g, b: F.transform(g["out"], lambda x: x + b)))

    return _named(steps, lambda s: _named(grouped(s), shifted))


def _spans(gaps: Column, matches: Column, kind: str, keep) -> Column:
    """Spans of the kept matches."""

    def one(m: Column, start: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("found"))

    return F.when(F.size(matches) > 0, F.filter(F.zip_with(matches, _starts(gaps, matches), one), lambda x: keep(x["found"]))).otherwise(F.array().cast(_SPAN))


def _blanked(text: Column, pattern: str, matches: Column, keep) -> Column:
    """text with the kept matches of pattern made blanks of the same length."""
    gaps = F.split(text, pattern, -1)
    blank = lambda m: F.when(keep(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m)
    whole = _named(gaps, lambda g: F.concat(F.array_join(F.zip_with(F.slice(g, 1, F.size(matches)), matches, lambda x, m: F.concat(x, blank(m))), ""), F.element_at(g, -1)))
    return F.when(F.size(matches) > 0, whole).otherwise(text)


def _piece_ranges(codes: Column, base: Column, cls: EntropyClass) -> Column:
    """(start, end) ranges of one piece, merged, whose windows reach the class's entropy.

    The fold's state holds one count per alphabet symbol, packed into longs, and the sum of c*log2(c); a step adds
    the entering character, drops the leaving one and adjusts the sum by the four table values concerned."""
    w, table = cls.window, F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(cls.window + 1)])
    most = w * (math.log2(w) - cls.bits) + 1e-9
    longs = -(-len(cls.alphabet) // _A_LONG)
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1).alias("from"), F.lit(-1).alias("to"), F.array().cast(_RANGE).alias("out"))
    bit = lambda c: (c % _A_LONG) * _COUNT_BITS
    unit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))
    count = lambda n, c: F.call_function("shiftright", F.get(n, F.floor(c / _A_LONG).cast("int")), bit(c)).bitwiseAND(F.lit((1 << _COUNT_BITS) - 1).cast("long")).cast("int")
    steps = F.transform(codes, lambda c, k: F.struct(c.alias("add"), F.when(k >= w, F.get(codes, k - w)).otherwise(F.lit(-1)).alias("gone"), (k + 1).alias("i")))

    def step(acc: Column, x: Column) -> Column:
        add, gone, i = x["add"], x["gone"], x["i"]

        def moved(c: Column) -> Column:
            less = F.when(gone >= 0, F.get(table, c["gone"] - 1) - F.get(table, c["gone"])).otherwise(0.0)
            total = F.when(add == gone, acc["sum"]).otherwise(acc["sum"] + F.get(table, c["add"] + 1) - F.get(table, c["add"]) + less)
            n = F.when(add == gone, acc["n"]).otherwise(
                F.transform(acc["n"], lambda v, k: v + F.when(k == F.floor(add / _A_LONG), unit(add)).otherwise(F.lit(0).cast("long")) - F.when((gone >= 0) & (k == F.floor(gone / _A_LONG)), unit(gone)).otherwise(F.lit(0).cast("long")))
            )
            return F.struct(total.alias("sum"), n.alias("n"))

        counts = F.struct(count(acc["n"], add).alias("add"), F.when(gone >= 0, count(acc["n"], gone)).otherwise(0).alias("gone"))

        def marked(m: Column) -> Column:
            flagged, begin = (i >= w) & (m["sum"] <= most), base + i - w
            new = flagged & (acc["to"] < begin)
            out = F.when(new & (acc["to"] >= 0), F.array_append(acc["out"], F.struct(acc["from"].alias("start"), acc["to"].alias("end")))).otherwise(acc["out"])
            return F.struct(m["n"].alias("n"), m["sum"].alias("sum"), F.when(new, begin).otherwise(acc["from"]).alias("from"), F.when(flagged, base + i).otherwise(acc["to"]).alias("to"), out.alias("out"))

        return _named(_named(counts, moved), marked)

    last = lambda a: F.when(a["to"] >= 0, F.array_append(a["out"], F.struct(a["from"].alias("start"), a["to"].alias("end")))).otherwise(a["out"])
    return F.aggregate(steps, zero, step, last)


def _flagged(found: Column, cls: EntropyClass) -> Column:
    """(start, end) ranges of found, merged over all its pieces."""
    w = cls.window

    def folded(pieces: Column) -> Column:
        def one(p: Column, k: Column) -> Column:
            whole = F.concat(p, F.coalesce(F.substring(F.get(pieces, k + 1), 1, w - 1), F.lit("")))
            codes = F.transform(F.split(whole, ""), lambda c: F.instr(F.lit(cls.alphabet), c) - 1)
            return _named(codes, lambda c: _piece_ranges(c, k * PIECE, cls))

        return F.flatten(F.transform(pieces, one))

    def merged(r: Column) -> Column:
        first = F.filter(r, lambda x, k: (k == 0) | (F.get(r, k - 1)["end"] < x["start"]))
        last = F.filter(r, lambda x, k: (k == F.size(r) - 1) | (x["end"] < F.get(r, k + 1)["start"]))
        return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    return _named(_named(F.regexp_extract_all(found, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), folded), merged)


def _entropy_spans(candidates: Column, cls: EntropyClass) -> Column:
    per = F.transform(
        candidates,
        lambda c: F.transform(
            _flagged(c["found"], cls),
            lambda r: F.struct((c["start"] + r["start"]).alias("start"), F.lit(KINDS.index(cls.kind)).alias("rank"), (c["start"] + r["end"]).alias("end"), F.lit(cls.kind).alias("kind"), F.substring(c["found"], r["start"] + 1, r["end"] - r["start"]).alias("found")),
        ),
    )
    return F.when(F.size(candidates) > 0, F.flatten(per)).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, text: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, literals: tuple[str, ...] = ALLOW_LITERALS) -> DataFrame:
    """docs with `__base` and `__spans`: arrays of (start, rank, end, kind, found) by start, then kind.

    Base spans always stay.  For entropy, base spans (assign, then access, then hex in what is left) and allow-listed
    literals are blanked first, so a candidate ends there; a candidate on the allow-list is not flagged; a candidate of
    an earlier class is blanked for the later ones."""
    rules = (
        ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        ("access", ACCESS, lambda m: F.lit(True)),
        ("hex", HEX, lambda m: F.lit(True)),
    )
    out, inner = shielded(docs)
    out = out.withColumn("__t", text_or_empty(inner[text]))
    for kind, pattern, keep in rules:
        out = out.withColumn(f"__m_{kind}", F.regexp_extract_all("__t", F.lit(pattern), F.lit(0)))
        out = out.withColumn(f"__s_{kind}", _spans(F.slice(F.split("__t", pattern, -1), 1, F.size(f"__m_{kind}")), F.col(f"__m_{kind}"), kind, keep))
    out = out.withColumn("__base", F.array_sort(F.concat(*[f"__s_{k}" for k, _, _ in rules])))
    left = F.col("__t")
    for kind, pattern, keep in rules:
        # Where the text has no match of the rule, what is left of it has none either.
        again = F.when(F.size(f"__m_{kind}") > 0, F.regexp_extract_all(left, F.lit(pattern), F.lit(0))).otherwise(F.col(f"__m_{kind}"))
        out = out.withColumn(f"__l_{kind}", again).withColumn(f"__u_{kind}", _blanked(left, pattern, F.col(f"__l_{kind}"), keep))
        left = F.col(f"__u_{kind}")
    runs = {c.kind: f"(?<![{c.chars}])[{c.chars}]{{{c.window},}}+" for c in classes}
    both = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~F.greatest(*[m.rlike(a) for a in allow], F.lit(False), F.lit(False))
    cleaned = left
    for literal in literals:
        cleaned = F.regexp_replace(cleaned, f"(?i){literal}", " " * len(literal))
    # Blanking only shortens runs, so a text without a long run needs none.
    any_run = left.rlike("|".join(runs.values())) if runs else F.lit(False)
    out = out.withColumn("__c", F.when(any_run, cleaned).otherwise(F.lit("")))
    spans, left = ["__base"], F.col("__c")
    for cls in classes:
        run, k = runs[cls.kind], cls.kind
        out = out.withColumn(f"__m_{k}", F.regexp_extract_all(left, F.lit(run), F.lit(0)))
        out = out.withColumn(f"__c_{k}", _spans(F.slice(F.split(left, run, -1), 1, F.size(f"__m_{k}")), F.col(f"__m_{k}"), k, both))
        out = out.withColumn(f"__e_{k}", _entropy_spans(F.col(f"__c_{k}"), cls)).withColumn(f"__u_{k}", _blanked(left, run, F.col(f"__m_{k}"), both))
        spans, left = [*spans, f"__e_{k}"], F.col(f"__u_{k}")
    out = out.withColumn("__spans", F.array_sort(F.concat(*spans)))
    kept = [F.col(inner[c]).alias(c) for c in docs.columns if c not in ("__base", "__spans")]
    return out.select(*kept, "__base", "__spans")


def joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, all spans as text."""
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs.select("doc_id", "text")).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("__base"), 256).alias("base_sha256"), joined("__spans").alias("spans"))
