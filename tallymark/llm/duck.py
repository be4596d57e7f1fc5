"""Pieces of DuckDB SQL that several corpus queries' counterparts share."""

from __future__ import annotations

#: CTE `crc(t)`: the 256 steps of the reflected CRC-32, by its polynomial.
CRC_TABLE = "crc(t) AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"


def crc32(text: str) -> str:
    """Unsigned crc32 of a string's UTF-8 bytes, in a query that has the table `crc` among its sources."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda o: ('0x' || o)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295)"
