"""Seeded choices that do not depend on partitioning or on the engine's hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, key: Column) -> Column:
    """Hex string that orders rows pseudo-randomly for a seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def choice(seed: int, key: Column, n: int) -> Column:
    """Stable uniform choice in ``0..n-1`` for a key."""
    head = F.conv(F.substring(order_key(seed, key), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(n)).cast("int")
