"""Address functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"

# Ranges that are never looked up outside.
PRIVATE_V4 = (
    ("10.0.0.0", 8),
    ("172.16.0.0", 12),
    ("192.168.0.0", 16),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
)


def ipv4_number(ip: Column) -> Column:
    """IPv4 text to its number, NULL for anything else."""
    parts = F.split(ip, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).cast("bigint")
    return F.when(ip.rlike(IPV4), number)


_HEX = "[0-9a-f]{1,4}"
# eight groups, or fewer than eight around one '::'
IPV6 = (
    rf"^(?:(?:{_HEX}:){{7}}{_HEX}|(?!(?::*[0-9a-f]+(?![0-9a-f])){{8}})"
    rf"(?:(?:{_HEX}:)*{_HEX})?::(?:(?:{_HEX}:)*{_HEX})?)$"
)


def _ipv6_text(ip: Column) -> Column:
    return F.lower(F.regexp_replace(ip, "%[^%/]+$", ""))


def is_ipv6(ip: Column) -> Column:
    """True for IPv6 text; an IPv4 tail counts as two groups."""
    text = _ipv6_text(ip)
    whole = F.when(
        text.contains("."),
        F.regexp_replace(text, rf"(?<=:)(?:{_OCTET}\.){{3}}{_OCTET}$", "0:0"),
    ).otherwise(text)
    return F.coalesce(ip.contains(":") & whole.rlike(IPV6), F.lit(False))


def ipv6_hex(ip: Column) -> Column:
    """The 128 bits of an address as 32 hexadecimal signs, which sort like the
    numbers; NULL for text that is no IPv6 address."""
    text = _ipv6_text(ip)
    # an IPv4 tail is two groups
    tail = ipv4_number(F.substring_index(text, ":", -1))
    groups = F.concat(
        F.regexp_replace(text, r"[0-9.]+$", ""), F.lower(F.hex(F.shiftright(tail, 16))), F.lit(":"), F.lower(F.hex(tail.bitwiseAND(F.lit(0xFFFF))))
    )
    text = F.when(text.contains("."), groups).otherwise(text)
    halves = F.split(text, "::")

    def cells(part: Column) -> Column:
        return F.filter(F.split(F.coalesce(part, F.lit("")), ":"), lambda x: x != "")

    left, right = cells(F.get(halves, F.lit(0))), cells(F.get(halves, F.lit(1)))
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    every = F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0"))
    return F.when(is_ipv6(ip), F.array_join(every, ""))


def _private_v6(ip: Column) -> Column:
    """Of a valid address: only its last group is 1, or it starts with fc or fd."""
    text = _ipv6_text(ip)
    loop = (F.regexp_replace(text, "[0:.]", "") == "1") & text.endswith("1")
    return loop | text.rlike("^f[cd][0-9a-f]{2}:")


def is_private(ip: Column) -> Column:
    """Private, loopback or link-local; text that is no address counts as private."""
    v4 = F.lit(False)
    for base, bits in PRIVATE_V4:
        # all of these ranges end within the first two octets
        a, b = (int(x) for x in base.split(".")[:2])
        if bits == 8:
            v4 = v4 | ip.startswith(f"{a}.")
        elif bits == 16:
            v4 = v4 | ip.startswith(f"{a}.{b}.")
        else:
            second = F.substring_index(F.substring_index(ip, ".", 2), ".", -1).try_cast("int")
            v4 = v4 | (ip.startswith(f"{a}.") & second.between(b, b + 2 ** (16 - bits) - 1))
    return F.when(ip.rlike(IPV4), v4).when(is_ipv6(ip), _private_v6(ip)).otherwise(F.lit(True))


def address_type(ip: Column) -> Column:
    """STIX object type of an address; text that is no address counts as IPv4."""
    return F.when(is_ipv6(ip), "ipv6-addr").otherwise("ipv4-addr")
