"""Hosts in other letters and network addresses: published vectors, and the standard library's own judgement."""

import ipaddress
import random

from pyspark.sql import functions as F

from webweft.functions import net
from webweft.functions import url as U

EXTRA = [ipaddress.ip_network(n) for n in ("192.88.99.0/24", "224.0.0.0/4", "240.0.0.0/4", "100.64.0.0/10", "ff00::/8", "3fff::/20")]
CARRIERS = [(ipaddress.ip_network("::ffff:0:0/96"), 96), (ipaddress.ip_network("64:ff9b::/96"), 96), (ipaddress.ip_network("2002::/16"), 16)]


def is_private(text):
    if text is None:
        return None
    if text.startswith("[") and text.endswith("]"):
        text = text[1:-1]
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return True
    if ip.version == 6:
        if "%" in text:
            return True
        for network, at in CARRIERS:
            if ip in network:
                return is_private(str(ipaddress.IPv4Address((int(ip) >> (96 - at)) & 0xFFFFFFFF)))
    return not ip.is_global or any(ip.version == n.version and ip in n for n in EXTRA)


def judged(spark, texts, use):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    return [r.o for r in frame.select("i", use(F.col("v")).alias("o")).orderBy("i").collect()]


def spelled(rng, value):
    groups = [value >> (16 * k) & 0xFFFF for k in range(7, -1, -1)]
    form = rng.randrange(5)
    if form == 0:
        return ":".join(format(g, "x") for g in groups)
    if form == 1:
        return ":".join(format(g, "04X") for g in groups)
    if form == 2:
        return str(ipaddress.IPv6Address(value))
    if form == 3:
        return ":".join(format(g, "x") for g in groups[:6]) + ":" + str(ipaddress.IPv4Address(value & 0xFFFFFFFF))
    return "[" + ipaddress.IPv6Address(value).exploded + "]"


def test_ipv6(spark):
    rng, texts = random.Random(4), ["::", "::1", "::ffff:1.2.3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", ":::", "::1::", "1::2::3", ":1::2", "12345::", "g::", "", None, "fe80::1%eth0", "2606::1%x", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::1.2.3.4", "::1.2.3.256", "1.2.3.4::", "[8.8.8.8]", "[2606::1", "2001:4860:4860::8888", "1::2:3:4:5:6:7:8", "::FFFF:8.8.8.8", "64:ff9b::8.8.8.8", "2002:0808:0808::"]
    nets = [ipaddress.ip_network(n) for n in (*net.V6, *net.V6_PUBLIC, *(c[0] for c in net.CARRIERS))]
    for n in nets:
        low, high = int(n.network_address), int(n.broadcast_address)
        texts += [spelled(rng, v) for v in (low, high, max(0, low - 1), min(high + 1, (1 << 128) - 1), *(rng.randint(low, high) for _ in range(8)))]
    for carrier, at in ((0xFFFF << 32, 0), (0x64FF9B << 96, 0), (0x2002 << 112, 80)):
        texts += [spelled(rng, carrier | int(ipaddress.IPv4Address(v)) << at) for v in ("127.0.0.1", "8.8.8.8", "10.1.2.3", "172.32.0.1", "172.31.255.255", "100.64.0.1", "224.0.0.1")]
    texts += [spelled(rng, rng.getrandbits(128)) for _ in range(500)]
    got, want = judged(spark, texts, net.private), [is_private(t) for t in texts]
    assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    assert sum(g is False for g in got) > 200 and sum(got[i] is True for i in range(len(got))) > 100


#: Samples of RFC 3492, section 7.1 (letters in lower case, as the mapping makes them).
SAMPLES = {
    "ليهمابتكلموشعربي؟": "egbpdaj6bu4bxfgehfvwxn",
    "他们为什么不说中文": "ihqwcrb4cv8a8dqg056pqjye",
    "他們爲什麽不說中文": "ihqwctvzc91f659drss3x8bo0yb",
    "pročprostěnemluvíčesky": "proprostnemluvesky-uyb24dma41a",
    "למההםפשוטלאמדבריםעברית": "4dbcagdahymbxekheh6e0a7fei0b",
    "यहलोगहिन्दीक्योंनहींबोलसकतेहैं": "i1baa7eci9glrd9b2ae1bj0hfcgg6iyaf8o0a1dig0cd",
    "なぜみんな日本語を話してくれないのか": "n8jok5ay5dzabd5bym9f0cm5685rrjetr6pdxa",
    "почемужеонинеговорятпорусски": "b1abfaaepdrnnbgefbadotcwatmq2g4l",
    "porquénopuedensimplementehablarenespañol": "porqunopuedensimplementehablarenespaol-fmd56a",
    "tạisaohọkhôngthểchỉnóitiếngviệt": "tisaohkhngthchnitingvit-kjcr8268qyxafd2f1b9g",
    "3年b組金八先生": "3b-ww4c5e180e575a65lsy2b",
    "安室奈美恵-with-super-monkeys": "-with-super-monkeys-pc58ag80a8qai00g7n9n",
    "ひとつ屋根の下2": "2-u9tlzr9756bt3uc0v",
    "majiでkoiする5秒前": "majikoi5-783gue6qz075azm5e",
    "パフィーdeルンバ": "de-jg4avhby1noc0d",
    "そのスピードで": "d9juau41awczczp",
}


def test_punycode(spark):
    assert all(k.encode("punycode").decode() == v for k, v in SAMPLES.items())
    short = {k: v for k, v in SAMPLES.items() if len(v) <= 59}
    assert judged(spark, list(short), U.ascii_host) == [f"xn--{v}" for v in short.values()]
    cases = {"bücher.example": "xn--bcher-kva.example", "faß.de": "fass.de", "例え。テスト": "xn--r8jz45g.xn--zckzah", "ü" * 70: "", "a..ü": "", "plain_1.org": "plain_1.org", "xn--tda.org": "xn--tda.org", None: None}
    assert judged(spark, list(cases), U.ascii_host) == list(cases.values())
    urls = {"HTTP://BÜCHER.Example:80/ä?q": "http://xn--bcher-kva.example/ä?q", "https://a..ü/": None, "https://u:p@пример.рф/x": "https://xn--e1afmkfd.xn--p1ai/x"}
    assert judged(spark, list(urls), U.normalised) == list(urls.values())
