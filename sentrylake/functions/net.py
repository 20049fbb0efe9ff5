"""IP address expressions. All JVM side: no Python worker is needed, for IPv6 either.

Network membership is a pattern over the address text: the dotted text for IPv4, the 32 hexadecimal
digits for IPv6. Joins use the hexadecimal text (8 digits for IPv4, 32 for IPv6) as a key.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

_GROUP = "[0-9a-f]{1,4}"
_GROUPS = f"(?:{_GROUP}(?::{_GROUP})*)?"
# Eight groups, or fewer than eight around one "::".
IPV6_PATTERN = (
    f"^(?:(?:{_GROUP}:){{7}}{_GROUP}"
    f"|(?!(?::{{0,2}}[0-9a-f]++){{8}}){_GROUPS}::{_GROUPS})$"
)

# Ranges that count as local when no configured zone matches.
LOCAL_RANGES = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16",
    "::1/128", "fc00::/7", "fe80::/10",
)

# IANA special-purpose registries, private (not globally reachable) blocks.
SPECIAL_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "240.0.0.0/4",
)
SPECIAL_V4_EXCEPT = ("192.0.0.9/32", "192.0.0.10/32")
SHARED_V4 = ("100.64.0.0/10",)
SPECIAL_V6 = (
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "fc00::/7", "fe80::/10",
)
SPECIAL_V6_EXCEPT = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28",
    "2001:30::/28",
)


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with ``value`` evaluated once, which keeps the expression short."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ipv4_value(ip: Column | str) -> Column:
    """32-bit value of a dotted IPv4 address, null for anything else (256, leading zeros, names)."""
    c = _c(ip)
    octet = [F.split_part(c, F.lit("."), F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    value = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.when(c.rlike(IPV4_PATTERN), value)


def _ipv6_text(ip: Column) -> Column:
    """Lower-case address without scope, its dotted tail (::ffff:192.0.2.1) as two groups."""
    text = F.regexp_replace(F.lower(ip), "%[^%]+$", "")
    dotted = f":{IPV4_PATTERN[1:-1].replace('(?:', '(')}(?:%.*)?$"
    octets = [F.regexp_extract(ip, dotted, i).try_cast("int") for i in (1, 2, 3, 4)]
    return F.when(
        ip.rlike(dotted),
        F.concat(
            F.regexp_replace(text, "[0-9.]+$", ""), F.format_string("%02x%02x:%02x%02x", *octets)
        ),
    ).otherwise(text)


def ipv6_hex(ip: Column | str) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, null for anything else.

    The colons of "::" are filled up with zero groups, every group is padded on the left, and the
    last four digits of each group are kept.
    """

    def digits(text: Column) -> Column:
        colons = F.length(F.regexp_replace(text, "[^:]", ""))
        filled = F.replace(
            text, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.lit(8) - colons))
        )
        padded = F.replace(F.concat(F.lit(":"), filled), F.lit(":"), F.lit(":0000"))
        kept = F.regexp_replace(padded, ":[0-9a-f]*([0-9a-f]{4})(?=:|$)", "$1")
        return F.when(text.rlike(IPV6_PATTERN), kept)

    c = _c(ip)
    return F.when(c.contains(":"), bind(c, lambda x: bind(_ipv6_text(x), digits)))


def ip_hex(ip: Column | str) -> Column:
    """Canonical key of an address: 8 digits (IPv4), 32 digits (IPv6), null when invalid."""
    c = _c(ip)
    return F.when(c.contains(":"), ipv6_hex(c)).otherwise(
        F.lpad(F.lower(F.hex(ipv4_value(c))), 8, "0")
    )


def hex_prefix(hex_text: Column, plen: Column | int) -> Column:
    """The first ``plen`` bits of a hexadecimal address text, as a comparable key."""
    plen = F.lit(plen) if isinstance(plen, int) else plen
    whole = F.floor(plen / 4).cast("int")
    spare = (plen % 4).cast("int")
    step = F.pow(F.lit(2), F.lit(4) - spare).cast("int")

    def leading(text: Column) -> Column:
        digit = F.conv(F.substr(text, whole + 1, F.lit(1)), 16, 10).cast("int")
        masked = F.lower(F.hex((F.floor(digit / step) * step).cast("bigint")))
        return F.concat(
            F.substr(text, F.lit(1), whole), F.when(spare == 0, F.lit("")).otherwise(masked)
        )

    return bind(hex_text, leading)


def _dotted_pattern(net: ipaddress.IPv4Network) -> str:
    """Pattern of the dotted addresses inside a network."""
    octets = str(net.network_address).split(".")
    whole, spare = divmod(net.prefixlen, 8)
    pattern = "".join(o + r"\." for o in octets[:whole])
    if net.prefixlen == 32:
        return pattern[:-2] + "$"
    if spare:
        first = int(octets[whole])
        values = "|".join(str(v) for v in range(first, first + (1 << (8 - spare))))
        pattern += f"(?:{values})" + (r"\." if whole < 3 else "$")
    return pattern


def _hex_pattern(net: ipaddress.IPv4Network | ipaddress.IPv6Network) -> str:
    """Pattern of the leading hexadecimal digits shared by a network's addresses."""
    digits = f"{int(net.network_address):0{net.max_prefixlen // 4}x}"
    whole, spare = divmod(net.prefixlen, 4)
    pattern = digits[:whole]
    if spare:
        first = int(digits[whole], 16)
        pattern += "[" + "".join(f"{v:x}" for v in range(first, first + (1 << (4 - spare)))) + "]"
    return pattern


def _networks(networks: Iterable[str], version: int) -> list:
    parsed = [ipaddress.ip_network(n, strict=False) for n in networks]
    return [n for n in parsed if n.version == version]


def _matches(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("^(?:" + "|".join(patterns) + ")") if patterns else F.lit(False)


def dotted_in(ip: Column, networks: Iterable[str]) -> Column:
    """True when a valid dotted address lies in one of a short list of networks.

    A network is a pattern over the address text, so a test is one expression node that compiles
    into the generated code of its stage: no parsing, no join, no shuffle.
    """
    return _matches(ip, [_dotted_pattern(n) for n in _networks(networks, 4)])


def hex_in(hex_text: Column, networks: Iterable[str], version: int = 6) -> Column:
    """True when a hexadecimal address text lies in one of a short list of networks."""
    return _matches(hex_text, [_hex_pattern(n) for n in _networks(networks, version)])


def is_ipv4(ip: Column | str) -> Column:
    return _c(ip).rlike(IPV4_PATTERN)


def zone_of(ip: Column | str, zones: Sequence) -> Column:
    """Name of the first configured zone holding ``ip``, else ``private`` or ``external``.

    ``zones`` is the ordered zone list of the site profile (a configuration document), compiled to
    one conditional expression, so the lookup needs neither a join nor a shuffle. Invalid and null
    addresses have no zone.
    """
    c = _c(ip)

    def chain(version: int, test) -> Column:
        out = None
        for zone in zones:
            if _networks(zone.cidrs, version):
                out = (F if out is None else out).when(test(zone.cidrs), F.lit(zone.name))
        out = (F if out is None else out).when(test(LOCAL_RANGES), F.lit("private"))
        return out.otherwise(F.lit("external"))

    def chain6(hex6: Column) -> Column:
        return F.when(hex6.isNotNull(), chain(6, lambda nets: hex_in(hex6, nets)))

    return F.when(is_ipv4(c), chain(4, lambda nets: dotted_in(c, nets))).when(
        c.contains(":"), bind(ipv6_hex(c), chain6)
    )


def is_internal(ip: Column | str, zones: Sequence) -> Column:
    """True when ``ip`` has a zone and that zone is not the outside."""
    return F.coalesce(zone_of(ip, zones) != "external", F.lit(False))


def is_external(ip: Column | str, zones: Sequence) -> Column:
    """True when ``ip`` is a valid address outside every configured and private range."""
    return F.coalesce(zone_of(ip, zones) == "external", F.lit(False))


_MAPPED = "0" * 20 + "ffff"


def is_private_address(ip: Column | str) -> Column:
    """True for special-purpose addresses (not globally reachable); false for invalid text."""

    def special6(hex6: Column) -> Column:
        # A mapped address (::ffff:a.b.c.d) is judged by its IPv4 part.
        low = F.substring(hex6, 25, 8)
        mapped = hex_in(low, SPECIAL_V4, 4) & ~hex_in(low, SPECIAL_V4_EXCEPT, 4)
        plain = hex_in(hex6, SPECIAL_V6) & ~hex_in(hex6, SPECIAL_V6_EXCEPT)
        return F.when(hex6.startswith(_MAPPED), mapped).otherwise(plain)

    c = _c(ip)
    answer = F.when(is_ipv4(c), dotted_in(c, SPECIAL_V4) & ~dotted_in(c, SPECIAL_V4_EXCEPT)).when(
        c.contains(":"), bind(ipv6_hex(c), special6)
    )
    return F.coalesce(answer, F.lit(False))


def is_routable(ip: Column | str) -> Column:
    """True for globally reachable addresses: the gate for any reputation lookup."""
    c = _c(ip)
    valid = F.when(is_ipv4(c), ~dotted_in(c, SHARED_V4)).otherwise(ipv6_hex(c).isNotNull())
    return F.coalesce(valid & ~is_private_address(c), F.lit(False))


def subnet24(ip: Column | str) -> Column:
    """``a.b.c.0/24`` of a four-part dotted address, null for anything else."""
    c = _c(ip)
    return F.when(
        c.rlike(r"^[^.:]*\.[^.:]*\.[^.:]*\.[^.:]*$"),
        F.concat(F.substring_index(c, ".", 3), F.lit(".0/24")),
    )
