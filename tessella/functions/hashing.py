"""Uniform numbers from a hash: the same for a key whatever the partitioning, and in SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(2**60)


def key_hash(*parts: Column | str) -> Column:
    """60-bit integer from the MD5 of the parts joined by ``|``."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("bigint")


def key_uniform(*parts: Column | str) -> Column:
    """Number in [0, 1)."""
    return key_hash(*parts) / F.lit(SCALE)


def sql_hash(*parts: str) -> str:
    """``key_hash`` in DuckDB's SQL; parts are SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"
