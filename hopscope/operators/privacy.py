"""Redaction and anonymisation of columns."""

from __future__ import annotations

import hashlib
import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(rows: DataFrame, column: str, order: str, kind: str) -> DataFrame:
    """``rows`` with token: kind and a number by first appearance, one per distinct value; null stays null.

    The numbering sorts the distinct values only.
    """
    seen = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    named = seen.withColumn("token", F.concat(F.lit(f"{kind}-"), F.row_number().over(Window.orderBy("_first", column)))).drop("_first")
    return rows.join(named, column, "left")


class AddressMap:
    """A keyed one-to-one map of addresses: two that share their first n bits share exactly n after it.

    The bytes before each byte of an address, under the key, give 256 pseudorandom bits; the byte's own bits walk a
    tree of 255 nodes and each is flipped if its node's bit is set. So a byte is one look-up in a table of 256 values that its
    prefix names, and tables are kept while a batch is mapped.
    """

    def __init__(self, key: bytes):
        self.key, self.tables = hashlib.blake2b(key, person=b"addresses").digest(), {}

    def _table(self, version: int, prefix: bytes) -> bytes:
        found = self.tables.get((version, prefix))
        if found is None:
            flips = int.from_bytes(hashlib.blake2b(prefix, key=self.key, salt=bytes([version, len(prefix)]), digest_size=32).digest(), "big")
            found = bytearray(256)
            for byte in range(256):
                node = 1
                for shift in range(7, -1, -1):
                    bit = byte >> shift & 1
                    found[byte] |= (bit ^ flips >> node & 1) << shift
                    node = node * 2 + bit
            if len(self.tables) >= 65_536:
                self.tables.clear()
            found = self.tables[version, prefix] = bytes(found)
        return found

    def packed(self, raw: bytes) -> bytes:
        """The mapped bytes of an IPv4 or IPv6 address."""
        version = 4 if len(raw) == 4 else 6
        return bytes(self._table(version, raw[:k])[b] for k, b in enumerate(raw))

    def text(self, text: str | None) -> str | None:
        """The mapped address of a text, null for what isn't one."""
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None
        return str(type(address)(self.packed(address.packed)))


def map_address(text: str | None, key: bytes) -> str | None:
    return AddressMap(key).text(text)


def map_hardware(raw: bytes, key: bytes) -> bytes:
    """A keyed hardware address that keeps the group bit; the broadcast address stays."""
    if raw.count(0xFF) == len(raw):
        return raw
    out = bytearray(hashlib.blake2b(raw, key=hashlib.blake2b(key, person=b"hardware").digest(), digest_size=len(raw)).digest())
    out[0] ^= (out[0] ^ raw[0]) & 1
    return bytes(out)


def anonymise_ipv4(column: Column, key: bytes) -> Column:
    """Addresses of both versions mapped by :class:`AddressMap`, each distinct one of an Arrow batch once; odd texts become null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        mapped = AddressMap(key)
        return values.map({v: mapped.text(v) for v in values.unique()})

    return run(column)


def headers_only(payload: Column, covered: Column, header_length: Column) -> Column:
    """The header bytes of a record, null unless they form a covered prefix: nothing uncertain is let through."""
    return F.when(covered >= header_length, F.substring(payload, 1, header_length))


def _carry(total: int) -> int:
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total


def updated_checksum(old: int, before: bytes, after: bytes) -> int:
    """A 16-bit checksum after some of its words changed, by their difference: one that was wrong stays as wrong."""
    total = ~old & 0xFFFF
    for k in range(0, len(before), 2):
        total += (~int.from_bytes(before[k : k + 2], "big") & 0xFFFF) + int.from_bytes(after[k : k + 2], "big")
    return ~_carry(total) & 0xFFFF


def anonymise_record(data: bytes, key: bytes) -> bytes | None:
    """The Ethernet, IPv4 and TCP or UDP headers of a record with mapped addresses and zero payload.

    Hardware addresses get keyed ones that keep the group bit. A record whose headers aren't all there, or that
    is of another kind, is refused (None): nothing uncertain gets out.
    """
    if len(data) < 34 or data[12:14] != b"\x08\x00" or data[14] >> 4 != 4:
        return None
    header = (data[14] & 15) * 4
    body, proto = 14 + header, data[23]
    size = {6: 20, 17: 8}.get(proto)
    if header < 20 or size is None or len(data) < body + size or int.from_bytes(data[20:22], "big") & 0x1FFF:
        return None
    if proto == 6:
        size = (data[body + 12] >> 4) * 4
        if size < 20 or len(data) < body + size:
            return None
    out = bytearray(data[: body + size] + bytes(len(data) - body - size))
    out[:12] = map_hardware(data[:6], key) + map_hardware(data[6:12], key)
    before, mapped = data[26:34], AddressMap(key)
    after = mapped.packed(before[:4]) + mapped.packed(before[4:])
    out[26:34] = after
    out[24:26] = updated_checksum(int.from_bytes(data[24:26], "big"), before, after).to_bytes(2, "big")
    place = body + (16 if proto == 6 else 6)
    old = int.from_bytes(data[place : place + 2], "big")
    if proto == 6 or old:
        gone = data[body + size :]
        payload = gone + b"\0" * (len(gone) % 2)
        out[place : place + 2] = updated_checksum(old, before + payload, after + bytes(len(payload))).to_bytes(2, "big")
    return bytes(out)


def anonymise_records(column: Column, key: bytes) -> Column:
    """:func:`anonymise_record` over a binary column; refused records are null."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else anonymise_record(bytes(v), key))

    return run(column)
