"""Column expressions for counters, flags, addresses and keys."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 1 << 32


def u32_sub(a: Column, b: Column) -> Column:
    """a - b modulo 2^32."""
    return F.pmod(a - b, F.lit(U32))


def u32_at_or_after(a: Column, b: Column) -> Column:
    """Whether a is b or within half the circle after it."""
    return u32_sub(a, b) < U32 // 2


def has_flags(flags: Column, mask: int) -> Column:
    """Whether all bits of ``mask`` are set (1 FIN, 2 SYN, 4 RST, 16 ACK)."""
    return flags.bitwiseAND(F.lit(mask)) == mask


def key(*parts: Column) -> Column:
    """MD5 of the parts joined by |; null parts are empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def ipv4(address: Column) -> Column:
    """A dotted address as a number; null for anything else."""
    octets = [F.regexp_extract(address, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k + 1).try_cast("int") for k in range(4)]
    ok = octets[0].between(0, 255) & octets[1].between(0, 255) & octets[2].between(0, 255) & octets[3].between(0, 255)
    return F.when(ok, sum((o.cast("long") * F.lit(1 << 8 * (3 - k)) for k, o in enumerate(octets)), F.lit(0).cast("long")))


def in_networks(address: Column, networks: list[str]) -> Column:
    """Whether an IPv4 address is in one of the networks, by its number alone; IPv6 networks need :func:`in_networks_any`."""
    number, hit = ipv4(address), F.lit(False)
    for n in map(ipaddress.ip_network, networks):
        if n.version == 4:
            hit = hit | number.between(int(n.network_address), int(n.broadcast_address))
    return F.coalesce(hit, F.lit(False))


def in_networks_any(address: Column, networks: list[str]) -> Column:
    """As :func:`in_networks` for both versions; one Arrow batch at a time, as SQL has no 128-bit numbers."""
    nets = [ipaddress.ip_network(n) for n in networks]

    @F.pandas_udf("boolean")
    def test(column: pd.Series) -> pd.Series:
        def one(text: str | None) -> bool:
            try:
                found = ipaddress.ip_address(text)
            except ValueError:
                return False
            return any(found in n for n in nets if n.version == found.version)

        known = {text: one(text) for text in column.unique()}
        return column.map(known)

    return test(address)


def direction(src: Column, dst: Column, clients: list[str]) -> Column:
    """forward from a client, reverse to one, else unknown."""
    a, b = in_networks(src, clients), in_networks(dst, clients)
    return F.when(a & ~b, "forward").when(b & ~a, "reverse").otherwise("unknown")


def timestamp_reason(t_us: Column, now_us: Column) -> Column:
    """Why a timestamp is set aside: missing, before 2000, over a day in the future; null if it is good."""
    return F.when(t_us.isNull(), "missing").when(t_us < 946684800000000, "before 2000").when(t_us > now_us + 86400000000, "in the future")
