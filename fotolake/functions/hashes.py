"""Hashes as the catalog writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """MD5 of the whole content in lower-case hex; NULL when it could not be read."""
    return F.md5(content)


def plain_hash(md5hash: Column) -> Column:
    """A hash kept as a UUID in the form without dashes."""
    return F.lower(F.replace(md5hash, F.lit("-")))
