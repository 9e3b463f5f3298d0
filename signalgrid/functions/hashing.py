"""Stable hashes used in place of random generators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 2**32


def stable_hash(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by '::', first eight bytes modulo 2**32.

    Strings name columns. Pass decimal numbers as text columns, because Spark prints
    small doubles in scientific notation.
    """
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("::", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.sha2(text, 256), 9, 8), 16, 10).cast("bigint")
