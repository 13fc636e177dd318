"""What the operators' SQL for DuckDB lacks."""

from __future__ import annotations


def crc32_sql(value: str) -> str:
    """Unsigned CRC-32 (reflected, polynomial 0xEDB88320 bit by bit) of the decimal text of an integer."""
    text = f"cast({value} as varchar)"
    shift = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::bigint[], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    return f"xor(list_reduce(list_transform(range(1, strlen({text}) + 1), lambda i: cast(ascii(substr({text}, i, 1)) as bigint)), lambda c, b: {shift}, 4294967295), 4294967295)"
