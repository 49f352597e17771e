"""Format-preserving pseudonyms for personal data, native.

One pattern finds e-mail addresses, telephone, payment card, bank account (IBAN) and US social security numbers,
IPv4 and IPv6 addresses and dates; each find is validated (Luhn, ISO 7064 mod 97, issued ranges, octets, groups,
calendar) and then permuted inside its format by a keyed, alternating Feistel network whose round function is SHA-2
over the key, so equal values get equal pseudonyms in all documents and a pseudonym is again valid.  Finds that fail
validation are left as they are.  An IPv6 address needs all eight groups, or three colons and a digit where "::"
shortens it; it is permuted as it is spelled, so two spellings of one address get two pseudonyms.

The key is a parameter (of a job: the setting KEY_SETTING).  Who holds it can undo the pseudonyms; without a setting
the public DEFAULT_KEY is used, which is good for tests only.

Card numbers and IBANs are validated before they are found, since the spaces inside them let a neighbouring number
or word join: of a stretch of groups every run of groups with an allowed length and right check digits is a
candidate, and of candidates that overlap the best one stays (usual length of the issuer or country, then the
longest, then the first).  The rest of the stretch is left to the other kinds.  Check digits hold by chance too (one
number in ten, one IBAN in 97), so long rows of numbers may hold runs that are taken for cards.

All of it is DataFrame expressions; rows pass one by one (no shuffle).  Null text stays null, empty stays empty;
repeated rows and null ids need no care; columns of docs are kept whatever their names (but for one named __found)."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shielded

ROUNDS = 8
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
PHONE = r"(?<![\w+.-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+(?!1[ .(-])\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?![\w-])"
CARD = r"(?<![\w.+-])[2-6](?:[ -]?\d){12,18}(?![\w-])"
SSN = r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
ISO_DATE = r"(?<![\w-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w-])"
DAY_DATE = r"(?<![\w./])(?:0[1-9]|[12]\d|3[01])([./])(?:0[1-9]|1[0-2])\1(?:19|20)\d\d(?!\w|[./]\d)"
US_DATE = r"(?<![\w./])(?:0[1-9]|1[0-2])/(?:1[3-9]|2\d|3[01])/(?:19|20)\d\d(?!\w|[./]\d)"
IPV6 = r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:]|\.\d)|(?<![\w:.])(?=[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]*::|[0-9A-Fa-f]{1,4}::[0-9A-Fa-f]{1,4}:)[0-9A-Fa-f:]{6,38}(?<![^:]:)(?![\w:]|\.\d)"
KINDS = {"email": EMAIL, "ssn": SSN, "ip": IP, "ipv6": IPV6, "us_date": US_DATE, "date": ISO_DATE, "day_date": DAY_DATE.replace("\\1", "\\k<sep>").replace("([./])", "(?<sep>[./])"), "iban": IBAN, "card": CARD, "phone": PHONE}
#: Stretches of groups that may hold a card number or an IBAN.
CARDS = r"(?<![\w.+-])(?=\d(?:[ -]?\d){12})\d++(?!\w|-(?!\d))(?:[ -]\d++(?!\w|-(?!\d)))*+"
IBANS = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]*+(?![A-Za-z0-9])(?: [A-Z0-9]++(?![A-Za-z0-9]))*+"
#: For each allowed length a pattern of no width, so that runs may overlap.
CARD_RUNS = [rf"(?<!\d)(?=([2-6](?:[ -]?\d){{{n - 1}}})(?!\d))" for n in range(13, 20)]
IBAN_RUNS = [rf"(?<![A-Z0-9])(?=([A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{{q}}}{f' ?[A-Z0-9]{{{r}}}' if r else ''})(?![A-Z0-9]))" for q in range(2, 8) for r in range(4)]
#: Usual lengths; they only decide between candidates that overlap.
ISSUED = r"^(?:4\d{15}|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3[0689]\d{12}|35\d{14}|6\d{15})$"
COUNTRIES = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
#: What holds where any find begins; inside a word nothing else is tried.
BEGINS = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9._%+(-])"
BEFORE = f"(?:{EMAIL})|(?=[0-9A-Fa-f])(?:" + "|".join(f"(?:{p})" for k, p in KINDS.items() if k not in ("email", "iban", "card", "phone")) + ")"
AFTER = f"(?:{PHONE})"


def _whole(kind: str) -> str:
    """The kind's pattern for a find taken alone."""
    return f"^(?:{KINDS[kind]})$"


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def _shift(half: Column, other: Column, key: Column, r: Column, hexadecimal: Column) -> Column:
    """half with each character moved inside its class by an amount that a keyed hash of the other half gives.
    Reaches 32 characters a hash; longer halves use one hash per 32."""

    def one(c: Column, i: Column) -> Column:
        h = F.sha2(F.concat(key, F.lit("|"), r.cast("string"), F.lit("|"), (i - i % 32).cast("string"), F.lit("|"), F.length(half).cast("string"), F.lit("|"), other), 512)
        n = F.conv(F.substring(h, (i % 32) * 4 + 1, 4), 16, 10).cast("int")

        def move(abc: Column) -> Column:
            return F.substring(abc, ((F.instr(abc, c) - 1 + n) % F.length(abc)) + 1, F.lit(1))

        return _named(F.when(hexadecimal, _DIGITS + "abcdef").when(c.rlike("[0-9]"), _DIGITS).when(c.rlike("[a-z]"), _LOWER).otherwise(_UPPER), move)

    return F.array_join(F.transform(_chars(half), one), "")


def permuted(core: Column, key: Column, hexadecimal: Column) -> Column:
    """A keyed permutation of strings of digits and letters that keeps length and each character's class (or of strings
    of small hexadecimal digits).  Left and right half move in turn, each by the other."""
    state = F.struct((F.length(core) / 2).cast("int").alias("h"), core.alias("s"), key.alias("k"), hexadecimal.alias("x"))

    def step(x: Column, r: Column) -> Column:
        left, right, odd = F.substring(x["s"], F.lit(1), x["h"]), F.substring(x["s"], x["h"] + 1, F.length(x["s"])), r % 2 == 1
        moved = _shift(F.when(odd, left).otherwise(right), F.when(odd, right).otherwise(left), x["k"], r, x["x"])
        return F.struct(x["h"].alias("h"), F.when(odd, F.concat(moved, right)).otherwise(F.concat(left, moved)).alias("s"), x["k"].alias("k"), x["x"].alias("x"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step, lambda x: x["s"])


def _named(value: Column, use) -> Column:
    """use(value), with value worked out once: an array of one element gives it a name."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _refill(s: Column, core: Column) -> Column:
    """s with its letters and digits replaced, in order, by the characters of core."""
    zero = F.struct(F.lit(0).alias("i"), F.lit("").alias("o"))

    def step(a: Column, c: Column) -> Column:
        own = c.rlike("[A-Za-z0-9]")
        return F.struct((a["i"] + F.when(own, 1).otherwise(0)).alias("i"), F.concat(a["o"], F.when(own, F.substring(core, a["i"] + 1, 1)).otherwise(c)).alias("o"))

    return F.aggregate(_chars(s), zero, step, lambda a: a["o"])


def _core(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9]", "")


def _numbers(value: Column, a: Column | int, b: Column | int, key: Column | str) -> Column:
    """A keyed permutation of range(a * b): both coordinates move in turn, each by a hash of the other."""
    a, b = (F.lit(n).cast("long") if isinstance(n, int) else n for n in (a, b))
    key = F.lit(key) if isinstance(key, str) else key
    state = F.struct(F.floor(value / b).cast("long").alias("x"), (value % b).cast("long").alias("y"))

    def step(s: Column, r: Column) -> Column:
        hashed = lambda v, side: F.sha2(F.concat_ws("|", key, F.lit(side), r.cast("string"), v.cast("string")), 256)
        f = lambda v, n, side: F.conv(F.substring(hashed(v, side), 1, 15), 16, 10).cast("long") % n
        x = (s["x"] + f(s["y"], a, "x")) % a
        return F.struct(x.cast("long").alias("x"), ((s["y"] + f(x.cast("long"), b, "y")) % b).cast("long").alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), state, step, lambda s: s["x"] * b + s["y"])


def luhn_sum(digits: Column, even: int) -> Column:
    """Luhn sum; even = 0: digits hold the check digit, 1: they end before it."""
    n = F.length(digits)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((n - 1 - i) % 2 == (1 - even), twice).otherwise(d)

    return F.aggregate(F.transform(_chars(digits), one), F.lit(0), lambda a, d: a + d)


def _mod97(s: Column) -> Column:
    """Remainder of the number that s spells, letters counting 10 to 35."""

    def step(a: Column, c: Column) -> Column:
        v = F.instr(F.lit(_DIGITS + _UPPER), c) - 1
        return F.when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97)

    return F.aggregate(_chars(s), F.lit(0), step)


def _card_holds(m: Column) -> Column:
    return luhn_sum(_core(m), 0) % 10 == 0


def _iban_holds(m: Column) -> Column:
    core = _core(m)
    return _mod97(F.concat(F.substring(core, F.lit(5), F.length(core)), F.substring(core, 1, 4))) == 1


def _valid_runs(text: Column, stretches: str, runs: list[str], holds, usual) -> Column:
    """The runs of groups whose check digits hold, best first where they overlap in their stretch."""

    def best(stretch: Column) -> Column:
        found = F.filter(F.flatten(F.array(*[F.regexp_extract_all(stretch, F.lit(p), F.lit(1)) for p in runs])), holds)
        order = F.sort_array(F.transform(found, lambda c, i: F.struct((~usual(_core(c))).cast("int").alias("odd"), (-F.length(_core(c))).alias("n"), i.alias("i"), c.alias("c"))))
        start = F.struct(stretch.alias("rest"), F.array().cast("array<string>").alias("kept"))

        def take(a: Column, x: Column) -> Column:
            # What is taken leaves the stretch, so runs that overlap it are no longer there.
            return F.when(a["rest"].contains(x["c"]), F.struct(F.replace(a["rest"], x["c"], F.lit("#")).alias("rest"), F.array_append(a["kept"], x["c"]).alias("kept"))).otherwise(a)

        return F.aggregate(order, start, take, lambda a: a["kept"])

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(stretches), F.lit(0)), best))


def valid_numbers(text: Column) -> Column:
    """The card numbers and IBANs of a text as they are spelled there, the longest first."""
    cards = _valid_runs(text, CARDS, CARD_RUNS, _card_holds, lambda c: c.rlike(ISSUED))
    ibans = _valid_runs(text, IBANS, IBAN_RUNS, _iban_holds, lambda c: F.instr(F.lit(COUNTRIES), F.concat(F.substring(c, 1, 2), F.length(c).cast("string"))) > 0)
    sized = F.transform(F.array_distinct(F.concat(ibans, cards)), lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))
    return F.transform(F.sort_array(sized), lambda x: x["v"])


def _find(values: Column) -> Column:
    """The pattern of all kinds, with a text's card numbers and IBANs as they stand; they hold no special characters."""
    one = F.concat(F.lit("(?:"), F.array_join(values, "|"), F.lit(")(?![A-Za-z0-9])"))
    # No telephone number reaches into one of them.
    phone = F.replace(F.lit(AFTER), F.lit("\\d{"), F.concat(F.lit("(?!"), one, F.lit(")\\d{")))
    numbers = F.concat(F.lit(f"{BEGINS}(?:{BEFORE}|"), one, F.lit("|"), phone, F.lit(")"))
    return F.when(F.size(values) > 0, numbers).otherwise(F.lit(f"{BEGINS}(?:{BEFORE}|{AFTER})"))


def _ipv6_holds(m: Column) -> Column:
    groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
    short = m.contains("::") & ~m.rlike(":::|::.*::") & (groups <= 7) & (groups >= 2) & m.rlike("[0-9]")
    return ~m.rlike("[0-9A-Fa-f]{5}") & (short | (~m.contains("::") & (groups == 8)))


#: Days from 1900-01-01 to 2099-12-31: 17 * 4297.
_EPOCH, _DAYS = "1900-01-01", (17, 4297)


def _kind(m: Column) -> Column:
    """What a find is (its pattern's name), null if it fails validation."""
    day = lambda text, form: F.try_to_timestamp(text, F.lit(form)).isNotNull()
    cases = (
        ("email", m.contains("@")),
        ("ssn", m.rlike(_whole("ssn"))),
        ("ip", m.rlike(_whole("ip"))),
        ("date", m.rlike(_whole("date")) & day(m, "yyyy-MM-dd")),
        ("day_date", m.rlike(_whole("day_date")) & day(F.regexp_replace(m, "/", "."), "dd.MM.yyyy")),
        ("us_date", m.rlike(_whole("us_date")) & day(m, "MM/dd/yyyy")),
        ("ipv6", m.rlike(_whole("ipv6")) & _ipv6_holds(m)),
        ("iban", m.rlike(_whole("iban")) & _iban_holds(m)),
        ("card", m.rlike(_whole("card")) & _card_holds(m)),
        ("phone", m.rlike(_whole("phone")) & F.length(_core(m)).between(8, 15)),
    )
    out = F.lit(None).cast("string")
    for name, test in reversed(cases):
        out = F.when(test, name).otherwise(out)
    return out


def _spelled(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a find whose letters and digits are permuted: one network over the part that moves."""
    text = F.when(kind == "email", F.substring_index(m, "@", 1)).when(kind == "ipv6", F.lower(m)).otherwise(m)

    def of_text(x: Column) -> Column:
        d, n = x["d"], F.length(x["d"])
        phone = F.when(m.rlike(r"^\+?1[ .(-]") & (n == 11), 1).when(m.rlike(r"^\+"), F.greatest(n - 9, F.lit(1))).otherwise(0)
        first = F.when(kind == "card", 1).when(kind == "iban", 4).when(kind == "phone", phone).otherwise(0)
        return _named(F.struct(x["t"].alias("t"), d.alias("d"), first.alias("first"), F.when(kind == "card", n - 2).otherwise(n - first).alias("n")), moved)

    def moved(x: Column) -> Column:
        new = permuted(F.substring(x["d"], x["first"] + 1, x["n"]), F.concat(F.lit(key + "|"), kind), kind == "ipv6")
        return _named(F.struct(x["t"].alias("t"), F.substring(x["d"], F.lit(1), x["first"]).alias("kept"), new.alias("new")), filled)

    def filled(x: Column) -> Column:
        luhn = lambda b: F.concat(b, ((10 - luhn_sum(b, 1) % 10) % 10).cast("string"))
        country = F.substring(x["kept"], 1, 2)
        check = F.lpad((98 - _mod97(F.concat(x["new"], country, F.lit("00")))).cast("string"), 2, "0")
        body = F.when(kind == "card", _named(F.concat(x["kept"], x["new"]), luhn)).when(kind == "iban", F.concat(country, check, x["new"])).otherwise(F.concat(x["kept"], x["new"]))
        return _refill(x["t"], body)

    def whole(new: Column) -> Column:
        return F.when(kind == "email", F.concat(new, F.lit("@"), F.substring_index(m, "@", -1))).when((kind == "ipv6") & m.rlike("[A-F]"), F.upper(new)).otherwise(new)

    return _named(_named(F.struct(text.alias("t"), _core(text).alias("d")), of_text), whole)


def _counted(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a find that is a number of a range (social security numbers, IPv4 addresses, days): one network."""
    area, group, serial = (F.substring(m, at, n).try_cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas, 99 groups, 9999 serials
    ssn = (index.cast("long") * 99 + group - 1) * 9999 + serial - 1
    ip = F.aggregate(F.split(m, "\\."), F.lit(0).cast("long"), lambda a, p: a * 256 + p.try_cast("long"))
    parts = F.when(kind == "date", F.array(*(F.substring(m, at, n) for at, n in ((1, 4), (6, 2), (9, 2))))).when(kind == "us_date", F.array(*(F.substring(m, at, n) for at, n in ((7, 4), (1, 2), (4, 2))))).otherwise(F.array(*(F.substring(m, at, n) for at, n in ((7, 4), (4, 2), (1, 2)))))
    epoch = F.lit(_EPOCH).cast("date")
    day = F.datediff(F.array_join(parts, "-").try_cast("date"), epoch).cast("long")
    by = lambda *n: F.when(kind == "ssn", F.lit(n[0])).when(kind == "ip", F.lit(n[1])).otherwise(F.lit(n[2])).cast("long")
    value = F.when(kind == "ssn", ssn).when(kind == "ip", ip).otherwise(day)
    name = F.when(kind.isin("ssn", "ip"), kind).otherwise("date")
    new = _numbers(value, by(898, 1 << 16, _DAYS[0]), by(99 * 9999, 1 << 16, _DAYS[1]), F.concat(F.lit(key + "|"), name))

    def spell(v: Column) -> Column:
        a = F.floor(v / (99 * 9999)).cast("int")
        a = F.when(a >= 665, a + 2).otherwise(a + 1)
        number = F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(v / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((v % 9999 + 1).cast("string"), 4, "0"))
        address = F.concat_ws(".", *[(F.floor(v / d) % 256).cast("long").cast("string") for d in (1 << 24, 1 << 16, 1 << 8, 1)])
        date = F.date_format(F.date_add(epoch, v.cast("int")), "yyyy-MM-dd")
        y, mo, d = F.substring(date, 1, 4), F.substring(date, 6, 2), F.substring(date, 9, 2)
        between = F.when(m.contains("/"), "/").otherwise(".")
        dated = F.when(kind == "date", date).when(kind == "us_date", F.concat_ws("/", mo, d, y)).otherwise(F.concat(d, between, mo, between, y))
        return F.when(kind == "ssn", number).when(kind == "ip", address).otherwise(dated)

    return _named(new, spell)


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value): a find's kind (null if it fails validation) and its pseudonym (itself then)."""

    def of_kind(kind: Column) -> Column:
        value = F.when(kind.isNull(), m).when(kind.isin("email", "ipv6", "iban", "card", "phone"), _spelled(m, kind, key)).otherwise(_counted(m, kind, key))
        name = F.when(kind.endswith("date"), "date").when(kind == "ipv6", "ip").otherwise(kind)
        return F.struct(name.alias("kind"), value.alias("value"))

    return _named(_kind(m), of_kind)


def redact(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text column pseudonymised and `__found`: the kinds of the validated finds, in order."""
    plain = F.coalesce(F.col("__t"), F.lit(""))
    out, inner = shielded(docs)
    out = out.withColumnRenamed(inner[text], "__t")
    out = out.withColumn("__v", valid_numbers(plain))
    out = out.withColumn("__f", _find(F.col("__v")))
    out = out.withColumn("__m", F.regexp_extract_all(plain, F.col("__f"), F.lit(0)))
    out = out.withColumn("__p", F.when(F.size("__m") > 0, F.transform("__m", lambda m: pseudonym(m, key))))
    gaps = F.split("__t", F.col("__f"), -1)
    new = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size("__m")), F.col("__p.value"), lambda g, v: F.concat(g, v)), ""), F.element_at(gaps, -1))
    out = out.withColumn("__new", F.when(F.col("__p").isNull(), F.col("__t")).otherwise(new))
    found = F.when(F.col("__p").isNull(), F.array().cast("array<string>")).otherwise(F.filter("__p.kind", lambda k: k.isNotNull()))
    kept = [F.col("__new").alias(c) if c == text else F.col(inner[c]).alias(c) for c in docs.columns if c != "__found"]
    return out.select(*kept, found.alias("__found"))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs, whatever its columns' names, with the text pseudonymised and n_chars, if there is one, set anew."""
    held, inner = shielded(docs)
    out = redact(held, key, inner["text"])
    if "n_chars" in inner:
        out = out.withColumn(inner["n_chars"], F.length(inner["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(i).alias(c) for c, i in inner.items()])


COUNTED = ("email", "phone", "card", "iban", "ssn", "ip", "date")
#: The session setting that names a job's key, and the key of tests.
KEY_SETTING, DEFAULT_KEY = "spark.webweft.pii.key", "webweft"


def job_key(spark: SparkSession) -> str:
    """The session's key; without one the public key, and a warning, as anyone can undo its pseudonyms."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a public key and can be undone", stacklevel=2)
    return key or DEFAULT_KEY


def digest(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, and the number of finds of each kind."""
    out = redact(docs.select("doc_id", "text"), key or job_key(docs.sparkSession))
    count = lambda kind: F.size(F.filter("__found", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", *[count(k) for k in COUNTED])
