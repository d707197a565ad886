"""Path expressions: Column in, Column out, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's \s also covers the four separator control characters.
_WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Folder part; a root made of slashes only is kept as it is."""
    return F.regexp_extract(path, r"(?s)^(?:.*[^/](?=/)|/*)", 0)


def extension(path: Column) -> Column:
    """Extension with its dot; leading dots of a name do not start one."""
    return F.regexp_extract(basename(path), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def without_extension(path: Column) -> Column:
    return F.substring(path, F.lit(1), F.length(path) - F.length(extension(path)))


def path_parts(path: Column) -> Column:
    return F.struct(
        dirname(path).alias("dirname"),
        basename(path).alias("basename"),
        extension(path).alias("extension"),
    )


def strip_leading_separator(path: Column) -> Column:
    return F.regexp_replace(path, r"^[\\/]", "")


def relative_path(path: Column, base: Column) -> Column:
    """``path`` below ``base``, or ``path`` unchanged when it is elsewhere.

    ``base`` must end at a folder boundary, so ``/old/b1`` is no base of
    ``/old/b10/x``.
    """
    rest = F.substring(path, F.length(base) + 1, F.length(path))
    at_boundary = rest.rlike(r"^([\\/]|$)") | base.rlike(r"[\\/]$")
    inside = F.coalesce(F.startswith(path, base) & at_boundary, F.lit(False))
    return strip_leading_separator(F.when(inside, rest).otherwise(path))


def normalize_separators(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normalize_base(base: Column) -> Column:
    return F.regexp_replace(normalize_separators(base), "/$", "")


def full_path(local: Column, base: Column, path: Column) -> Column:
    return F.when(local, F.concat(base, F.lit("/"), path)).otherwise(path)


def normalize_path(path: Column) -> Column:
    """Collapse ``//``, ``.`` and ``..`` the POSIX way; empty becomes ``.``.

    Give it a plain column: the expression names its input several times.
    """
    root = F.regexp_extract(path, "^(//(?!/)|/)?", 0)  # exactly two slashes stay two
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    # The first element of the kept steps is the root.
    def walk(kept: Column, step: Column) -> Column:
        at_root = F.size(kept) == 1
        climbs = F.when(at_root, F.get(kept, F.lit(0)) == "").otherwise(
            F.element_at(kept, -1) == ".."
        )
        return (
            F.when((step != "..") | climbs, F.concat(kept, F.array(step)))
            .when(at_root, kept)
            .otherwise(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
        )

    def join(kept: Column) -> Column:
        root = F.get(kept, F.lit(0))
        return F.when((F.size(kept) == 1) & (root == ""), ".").otherwise(
            F.concat(root, F.array_join(F.slice(kept, F.lit(2), F.size(kept)), "/"))
        )

    untidy = path.rlike(r"^$|//|(^|/)\.{1,2}(/|$)|./$")
    return F.when(untidy, F.aggregate(steps, F.array(root), walk, join)).otherwise(path)


def flatten_dir(folder: Column, level: int | None) -> Column:
    """Keep the first ``level`` folders; ``None`` keeps all of them."""
    if level is None:
        return folder
    steps = F.split(folder, r"[/\\]")
    keep = F.lit(level) if level >= 0 else F.greatest(F.size(steps) + level, F.lit(0))
    return F.array_join(F.slice(steps, F.lit(1), keep), "/")


def date_subdir(folder: Column, when: Column, split: str | None) -> Column:
    """Append a ``YYYY`` or ``YYYY/Mon`` folder."""
    if split is None:
        return folder
    patterns = {"year": "yyyy", "month": "yyyy/MMM"}
    if split not in patterns:
        raise ValueError(f"split must be one of {sorted(patterns)}, not {split!r}")
    dated = F.concat(folder, F.lit("/"), F.date_format(when, patterns[split]))
    return F.regexp_replace(dated, "^/", "")


def replace_whitespace(path: Column, replacement: str | None) -> Column:
    if replacement is None:
        return path
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(path, _WHITESPACE, literal)


def trailing_path(path: Column, components: int) -> Column:
    """Last ``components`` steps of a path, in lower case."""
    return F.lower(F.substring_index(normalize_separators(path), "/", -components))
