import hashlib
import re

from pyspark.sql import functions as F

from webweft.llm import pii
from webweft.llm.common import table

from .fixtures import frame, prose

KEY = "k"


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def permuted(core, key):
    """The Feistel network, plainly."""
    h, s = len(core) // 2, core

    def shift(half, other, r):
        out = ""
        for i, c in enumerate(half):
            x = hashlib.sha512(f"{key}|{r}|{i - i % 32}|{len(half)}|{other}".encode()).hexdigest()
            n = int(x[(i % 32) * 4 : (i % 32) * 4 + 4], 16)
            abc = next(a for a in (pii._DIGITS, pii._LOWER, pii._UPPER) if c in a)
            out += abc[(abc.index(c) + n) % len(abc)]
        return out

    for r in range(pii.ROUNDS):
        left, right = s[:h], s[h:]
        s = shift(left, right, r) + right if r % 2 else left + shift(right, left, r)
    return s


def one(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.text, r["__found"]) for r in pii.redact(df, KEY).orderBy("doc_id").collect()]


def test_formats(spark):
    (text, found), = one(spark, "Mail jo.De-9@a.example.com, card 4111 1111 1111 1111 or 4012888888881881, tel +1 (243) 555-5526; 078-05-1120 at 10.0.255.1 on 1999-02-28 and 29.02.2000 or 31/12/2024, DE89 3704 0044 0532 0130 00!")
    assert found == ["email", "card", "card", "phone", "ssn", "ip", "date", "date", "date", "iban"]
    m = re.fullmatch(r"Mail ([a-z]{2}\.[A-Z][a-z]-\d)@a\.example\.com, card (4\d{3} \d{4} \d{4} \d{4}) or (4\d{15}), tel \+1 \((\d{3})\) (\d{3})-(\d{4}); (\d{3}-\d\d-\d{4}) at ([\d.]+) on (\d{4}-\d\d-\d\d) and (\d\d\.\d\d\.\d{4}) or (\d\d/\d\d/\d{4}), (DE[\d ]+)!", text)
    assert m and luhn(m[2]) and luhn(m[3]) and mod97(m[12]) == 1 and "078-05-1120" not in text and "4111" not in text and "10.0.255.1" not in text
    assert all(0 <= int(p) < 256 for p in m[8].split("."))
    assert m[1] == (lambda c: f"{c[:2]}.{c[2:4]}-{c[4]}")(permuted("joDe9", "k|email"))
    body = "4" + permuted("11111111111111", "k|card")
    assert m[2].replace(" ", "")[:15] == body
    assert m[4] + m[5] + m[6] == permuted("2435555526", "k|phone")


def test_left_alone(spark):
    texts = ["4111111111111112 and 1234567890123456 and 123", "000-12-3456 666-12-3456 900-12-3456", "1.2.3.256 1.2.3.4.5 v1.2.3.4", "1999-02-30 2100-01-01 31.04.2020", "a@b @c d@ plain text", "DE00 3704 0044 0532 0130 00", "", "x" * 200000]
    assert [t for t, _ in one(spark, *texts)] == texts


def test_linked_and_injective(spark):
    values = [f"{i:03d}-{j:02d}-{k:04d}" for i in (1, 665, 667, 899) for j in (1, 99) for k in (1, 5000, 9999)]
    text = one(spark, " ".join(values) + " " + " ".join(values))[0][0].split(" ")
    assert text[: len(values)] == text[len(values) :] and len(set(text)) == len(values)
    days = spark.sql("select explode(sequence(date'1900-01-01', date'2099-12-31')) as d").select(F.col("d").cast("string").alias("text"), F.lit(1).alias("doc_id"))
    new = [r.text for r in pii.redact(days, KEY).collect()]
    assert len(set(new)) == 73049 and min(new) == "1900-01-01" and max(new) == "2099-12-31"
    local = spark.sql("select concat(chr(97 + id div 26 % 26), chr(97 + id % 26), '.', id div 676, '@x.org') as text, id as doc_id from range(6760)")
    assert len({r.text for r in pii.redact(local, KEY).collect()}) == 6760


def test_edges(spark):
    texts = [None, "", "mail a.b@x.org", prose(20000, 4) + " 1.2.3.4", " ".join(f"u{i}@x.org" for i in range(500))]
    docs = frame(spark, texts)
    out = pii.redact(docs, KEY)
    assert out.columns == [*docs.columns, "__found"] and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert rows[0].text is None and rows[1].text == "" and len(rows[4]["__found"]) == 500 and rows[3].text.startswith(texts[3][:-8])
    assert not pii.digest(docs.limit(0)).collect()


def test_whole_table(spark, small):
    docs = table(spark, small, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    out = pii.digest(docs).collect()
    assert len(out) == len(before)
    for r in out:
        old = before[r.doc_id]
        assert len(r.text) == len(old) or r.n_ip
        for m in re.findall(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) 555-\d{4}", old):
            assert m not in r.text
        for m in re.findall(r"(?<![\w.])[2-6]\d{15}(?!\w)", old):
            assert (m not in r.text) == luhn(m)
        if not (r.n_email + r.n_phone + r.n_card + r.n_iban + r.n_ssn + r.n_ip + r.n_date):
            assert r.text == old
    plan = pii.digest(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_numbers_with_neighbours(spark):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    cases = [
        (f"{card} 123", ["card"], card, " 123"),
        ("4111111111111111 12/25", ["card"], "4111111111111111", " 12/25"),
        ("pay 3 4111111111111111", ["card"], "4111111111111111", ""),
        ("4111-1111-1111-1111-123", ["card"], "4111-1111-1111-1111", "-123"),
        (f"{iban} EUR", ["iban"], iban, " EUR"),
        ("AT61 1904 3002 3457 3201 BIC", ["iban"], "AT61 1904 3002 3457 3201", " BIC"),
        (f"AB12 {iban}", ["iban"], iban, ""),
        (f"{card} 4012 8888 8888 1881", ["card", "card"], card, None),
        (f"{card} 10.0.255.1", ["card", "ip"], card, None),
        (f"{card} 2024-01-05", ["card", "date"], card, None),
        (f"{iban} {card}", ["iban", "card"], iban, None),
        (f"078-05-1120 {card}", ["ssn", "card"], card, None),
        (f"ref 123 456 {card}", ["card"], card, ""),
        (f"+49 {card}", ["card"], card, ""),
        (f"555 123 4567 {card}", ["phone", "card"], card, ""),
        ("a 4111111111111111@x.org", ["email"], "4111111111111111", "@x.org"),
        ("12 34 " * 3000 + "x", None, None, "x"),
    ]
    for (text, kinds, value, end), (new, found) in zip(cases, one(spark, *[c[0] for c in cases]), strict=True):
        assert len(new) == len(text) or "ip" in (kinds or [])
        assert kinds is None or (found == kinds and value not in new), text
        assert end is None or new.endswith(end), text
    assert one(spark, f"ref 123 456 {card}")[0][0].startswith("ref 123 456 4")
    whole = one(spark, f"{card} 123 {iban} EUR", card, iban)
    assert whole[0][0] == f"{whole[1][0]} 123 {whole[2][0]} EUR" and luhn(whole[1][0]) and mod97(whole[2][0]) == 1


def test_more_formats(spark):
    import ipaddress

    texts = ["on 12/25/2020 at 2001:db8::8a2e:370:7334 and 2001:0DB8:0000:0000:0000:FF00:0042:8329.", "a::b std::vec 12:30:45 aa:bb:cc:dd:ee:ff 1::2::3:4 13/32/2020 00/25/2020 ::1 x::1:2:3", "2001:db8::8a2e:370:7334"]
    (text, found), (left, none), (again, _) = one(spark, *texts)
    assert found == ["date", "ip", "ip"] and left == texts[1] and none == []
    m = re.fullmatch(r"on (\d\d)/(\d\d)/(\d{4}) at ([0-9a-f:]+) and ([0-9A-F:]+)\.", text)
    assert m and m[4] == again and m[4] != texts[2] and "12/25/2020" not in text
    assert re.sub("[0-9a-f]", "x", m[4]) == re.sub("[0-9a-f]", "x", texts[2])
    ipaddress.IPv6Address(m[4]), ipaddress.IPv6Address(m[5])


def test_numbers_network(spark):
    """The network over ranges, plainly."""
    def plain(v, a, b, key):
        f = lambda v, n, side, r: int(hashlib.sha256(f"{key}|{side}|{r}|{v}".encode()).hexdigest()[:15], 16) % n
        x, y = divmod(v, b)
        for r in range(1, pii.ROUNDS // 2 + 1):
            x = (x + f(y, a, "x", r)) % a
            y = (y + f(x, b, "y", r)) % b
        return x * b + y

    rows = spark.range(500).select("id", pii._numbers(F.col("id"), 20, 25, "k").alias("v")).collect()
    assert all(r.v == plain(r.id, 20, 25, "k") for r in rows) and len({r.v for r in rows}) == 500


def test_key_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail ab.cd@x.org", 3, "v", "m", None)], "doc_id long, text string, n_chars int, `__v` string, `__m` string, `__new` string")
    a, b = pii.pseudonymised(docs, "k1"), pii.pseudonymised(docs, "k2")
    assert a.columns == docs.columns and a.first()["__v"] == "v" and a.first().n_chars == len(a.first().text)
    assert a.first().text != b.first().text
    before = pii.digest(docs).first().text
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        assert pii.digest(docs).first().text != before
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert pii.digest(docs).first().text == before
