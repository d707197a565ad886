"""Reconnecting a catalog with files that have moved."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.operators import changes, relink
from fotolake.schemas import Catalog
from fotolake.session import cut_lineage


def apply_relink(
    catalog: Catalog,
    relinked: DataFrame,
    base: str,
    moment: datetime,
    local: bool = False,
    ftypes: DataFrame | None = None,
) -> Catalog:
    """Catalog with the new paths of ``relinked`` (md5hash, old_path, new_path).

    ``base`` is the folder that was scanned. The re-linked photos, and no others, join an
    ``update`` batch at a free second, which is not kept when nothing was re-linked.
    """
    relinked = cut_lineage(relinked.select("md5hash", "old_path", "new_path"))
    key = changes.free_key(catalog.imports, moment)
    batch = changes.batch_row(catalog.imports, base, local, "update", key)
    some = relinked.limit(1).select(F.lit(key).alias("import_date"))
    batch = batch.join(some, "import_date", "left_semi").select(*catalog.imports.columns)
    photo = relink.apply_changes(catalog.photo, relinked, key, ftypes, base, local)
    return catalog.replace(imports=catalog.imports.unionByName(batch), photo=photo)


def reconnect(
    catalog: Catalog,
    scan: DataFrame,
    base: str,
    moment: datetime,
    local: bool = False,
    how: str = "ranked",
) -> Catalog:
    """Give photos the paths where the scan found their files.

    ``ranked`` gives the k-th photo of each hash its k-th file. ``similar`` gives a hash
    with one photo the last path found, one with several photos the most similar paths,
    and renews the type where the scan (then with ``ftype``) has one.
    """
    if how == "ranked":
        found = relink.relink_ranked(catalog.photo, catalog.imports, scan)
        return apply_relink(catalog, found, base, moment, local)
    if how != "similar":
        raise ValueError(f"how must be 'ranked' or 'similar', not {how!r}")
    columns = ["md5hash", "old_path", "new_path"]
    unique = relink.relink_unique(catalog.photo, scan).select(*columns)
    found = unique.unionByName(relink.relink_ambiguous(catalog.photo, scan).select(*columns))
    ftypes = None
    if "ftype" in scan.columns:
        ftypes = scan.groupBy(F.col("path").alias("new_path")).agg(F.max("ftype").alias("ftype"))
    return apply_relink(catalog, found, base, moment, local, ftypes)
