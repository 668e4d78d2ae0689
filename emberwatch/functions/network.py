"""Addresses, ports, URLs and domains as Column expressions (SCA-01, 02, 08, 09)."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .severity import as_col

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# Texts that stand for "no address".
NO_ADDRESS = ("", "-", "none", "null", "unknown", "127.0.0.1/32")

# Private ranges.
RFC1918 = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ipv4(c: Column | str) -> Column:
    return as_col(c).rlike(IPV4)


def ipv6_hextets(c: Column | str) -> Column:
    """Eight hex groups of an IPv6 text (null when the text is not one)."""
    dotted = r"^.*:((?:\d{1,3}\.){3}\d{1,3})$"

    def plain(text: Column) -> Column:
        # a dotted tail counts as two groups
        def pair(i: int) -> Column:
            octet = lambda j: F.split_part(F.regexp_extract(text, dotted, 1), F.lit("."), F.lit(j)).try_cast("int")
            return F.lower(F.hex(octet(i) * 256 + octet(i + 1)))

        tail = F.regexp_extract(text, dotted, 1)
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        return F.when(tail == "", text).when(tail.rlike(IPV4), F.concat(head, pair(1), F.lit(":"), pair(3)))

    def parts(s: Column) -> Column:
        return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":", -1))

    def fill(halves: Column) -> Column:
        left, right = parts(F.get(halves, F.lit(0))), parts(F.get(halves, F.lit(1)))
        missing = F.lit(8) - F.size(left) - F.size(right)
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        return (
            F.when((F.size(halves) == 2) & (missing >= 1), F.concat(left, zeros, right))
            .when((F.size(halves) == 1) & (F.size(left) == 8), left)
        )

    def checked(groups: Column) -> Column:
        ok = F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(ok, F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))

    text = let(F.lower(as_col(c)), plain)
    return let(let(F.split(text, "::", -1), fill), checked)


def canonical_ipv6(c: Column | str) -> Column:
    """Compressed lower-case form: the first longest run of zero groups becomes ``::``."""

    def compress(text: Column) -> Column:
        out = F.when(text.isNull(), None)
        for run in range(8, 1, -1):
            pattern = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::(.*)|$)"
            out = out.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1::$2"))
        return out.otherwise(text)

    return let(F.array_join(ipv6_hextets(c), ":"), compress)


def norm_ip(c: Column | str) -> Column:
    """Canonical address text, or null where the value is none."""

    def pick(text: Column) -> Column:
        one_colon = (F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))) == 1
        bare = F.when(one_colon & ~text.startswith("["), F.split_part(text, F.lit(":"), F.lit(1))).otherwise(text)
        return F.when(text.isin(*NO_ADDRESS), None).when(bare.rlike(IPV4), bare).otherwise(canonical_ipv6(text))

    text = F.trim(as_col(c))
    # plain IPv4 never enters the interpreted branch
    return F.when(text.rlike(IPV4), text).when(text.contains(":"), let(text, pick))


def norm_port(c: Column | str) -> Column:
    port = F.trim(as_col(c).cast("string")).try_cast("int")
    return F.when(port.between(0, 65535), port)


def ipv4_number(c: Column | str) -> Column:
    """IPv4 text as bigint; null for anything else."""
    c = as_col(c)
    octet = lambda i: F.split_part(c, F.lit("."), F.lit(i)).try_cast("bigint")
    value = octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)
    return F.when(is_ipv4(c), value)


def _low_high(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def cidr_contains(ip: Column | str, cidr: str) -> Column:
    """Membership of an IPv4 text in one literal network."""
    low, high = _low_high(cidr)
    return F.coalesce(ipv4_number(ip).between(low, high), F.lit(False))


def is_private(ip: Column | str) -> Column:
    number = ipv4_number(ip)
    test = F.lit(False)
    for cidr in RFC1918:
        low, high = _low_high(cidr)
        test = test | number.between(low, high)
    return F.coalesce(test, F.lit(False))


def is_external(ip: Column | str) -> Column:
    """Anything outside the private ranges, text that is no address included."""
    return ~is_private(ip)


def host_of(url: Column | str) -> Column:
    """Host part, lower case: after ``://`` where there is one, up to the next ``/``, cut at ``:``."""
    url = F.lower(as_col(url))
    rest = F.when(url.contains("://"), F.split_part(url, F.lit("://"), F.lit(2))).otherwise(url)
    return F.split_part(F.split_part(rest, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))


def domain_suffixes(domain: Column | str) -> Column:
    """``a.b.c`` → [a.b.c, b.c, c]: every name a listed domain may match."""

    def named(name: Column) -> Column:
        n = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1
        return F.transform(F.sequence(-n, F.lit(-1)), lambda i: F.call_function("substring_index", name, F.lit("."), i))

    return let(F.lower(F.trim(as_col(domain))), named)
