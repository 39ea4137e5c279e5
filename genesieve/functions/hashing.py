"""Reproducible randomness from MD5, so that order and draws can be re-derived in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts: Column | str) -> Column:
    """MD5 of the parts joined by ``|``; strings name columns."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def uniform(digest: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
