"""CRC-32 in DuckDB's SQL, which has no such function: a table of 256 remainders, and a fold over a list of bytes."""

from __future__ import annotations

#: A common table with one row, the list ``t``; to be joined where ``crc_of`` is used.
CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_of(text: str) -> str:
    """The unsigned CRC-32 of a text's bytes in UTF-8."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"
