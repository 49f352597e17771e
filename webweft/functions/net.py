"""Which network addresses are private or reserved, as column expressions.

An IPv6 address is 128 bits written as 32 hexadecimal digits, however it was spelled; digits compare like the numbers, so a
network is an interval of strings.  An IPv4 address inside an IPv6 one is judged by itself."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import named

# Networks that are not public.
V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
V6 = ("::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "3fff::/20", "fc00::/7", "fe80::/10", "ff00::/8")
#: Public ones inside of those.
V6_PUBLIC = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
#: IPv6 networks that carry an IPv4 address, and the digit at which it begins (from 1).
CARRIERS = (("::ffff:0:0/96", 25), ("64:ff9b::/96", 25), ("2002::/16", 5))

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED = rf"{_OCTET}(\.{_OCTET}){{3}}"


def _inside(value: Column, nets: tuple[str, ...], form) -> Column:
    out = F.lit(False)
    for net in map(ipaddress.ip_network, nets):
        out = out | value.between(form(net.network_address), form(net.broadcast_address))
    return out


def _digits(ip) -> str:
    return format(int(ip), "032x" if ip.version == 6 else "08x")


def v4_digits(ip: Column) -> Column:
    """The eight digits of an IPv4 address in dotted form."""
    return F.lower(F.array_join(F.transform(F.split(ip, "\\."), lambda p: F.lpad(F.hex(p.cast("long")), 2, "0")), ""))


def v6_digits(ip: Column) -> Column:
    """The 32 digits of an IPv6 address in any spelling; null for what is none (a zone is not part of an address)."""
    low = F.lower(ip)
    tail = F.regexp_extract(low, f"(?<=:)({_DOTTED})$", 1)
    four = v4_digits(tail)
    plain = F.when(tail == "", low).otherwise(F.concat(F.substring(low, F.lit(1), F.length(low) - F.length(tail)), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4)))

    def spelled(text: Column) -> Column:
        halves = F.split(text, "::")
        groups = lambda k: named(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":")))
        return named(F.struct(groups(0).alias("a"), groups(1).alias("b"), F.size(halves).alias("n")), joined)

    def joined(p: Column) -> Column:
        count = F.size(p["a"]) + F.size(p["b"])
        right = ((p["n"] == 1) & (count == 8)) | ((p["n"] == 2) & (count < 8))
        fits = F.forall(F.concat(p["a"], p["b"]), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        padded = lambda x: F.array_join(F.transform(x, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(right & fits, F.concat(padded(p["a"]), F.repeat(F.lit("0"), F.greatest(F.lit(0), 32 - 4 * count)), padded(p["b"])))

    return F.when(ip.contains(":"), named(plain, spelled))


def private(ip: Column) -> Column:
    """Whether an address (an IPv6 one may stand in brackets) must not be requested; null for none, true for what is no
    address."""

    def six(d: Column) -> Column:
        out = _inside(d, V6, _digits) & ~_inside(d, V6_PUBLIC, _digits)
        for net, at in CARRIERS:
            out = F.when(_inside(d, (net,), _digits), _inside(F.substring(d, at, 8), V4, _digits)).otherwise(out)
        return F.coalesce(out, F.lit(True))

    bare = F.regexp_replace(ip, r"^\[([^\[\]]*)\]$", "$1")
    return F.when(ip.isNotNull(), named(bare, lambda b: F.when(b.contains(":"), named(v6_digits(b), six)).otherwise(private_v4(b))))


def private_v4(ip: Column) -> Column:
    """The test for IPv4 addresses alone; true for what is no such address."""
    return F.when(ip.rlike(f"^{_DOTTED}$"), _inside(v4_digits(ip), V4, _digits)).otherwise(True)
