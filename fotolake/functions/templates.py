"""Name templates and regular expressions, compiled on the driver into Columns."""

from __future__ import annotations

import posixpath
import re
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from fotolake.functions.times import strftime

# Tags printed as a date and time, and those printed as True or False.
DATE_TIME_TOKENS = ("dt", "old_dt_orig")
FLAG_TOKENS = ("old_local",)
INTEGER_TOKENS = ("year", "month", "isoyear", "isoweek", "isoday")
DATE_TOKENS = ("timestamp", *INTEGER_TOKENS, "dt")


def java_regex(pattern: str) -> str:
    """Java spelling of a Python pattern; named groups become numbered ones.

    Raises on constructs Java has no equal for.
    """
    names = re.compile(pattern).groupindex
    out, at, in_class = ["(?U)"], 0, False
    while at < len(pattern):
        rest = pattern[at:]
        if rest[0] == "\\":
            piece, size = ("\\z" if rest[:2] == "\\Z" and not in_class else rest[:2]), 2
        elif in_class:
            in_class = rest[0] != "]"
            size = 1
            piece = "\\" + rest[0] if rest[0] in "[&" else rest[0]
        elif rest[0] == "[":
            in_class = True
            head = re.match(r"\[\^?\]?", rest).group()  # a leading ] is itself
            size = len(head)
            piece = head.replace("]", "\\]")
        elif rest.startswith("(?P<"):
            piece, size = "(", rest.index(">") + 1
        elif rest.startswith("(?P="):
            size = rest.index(")") + 1
            piece = f"(?:\\{names[rest[4 : size - 1]]})"
        elif rest.startswith(("(?(", "(?P>", "(?#", "(?u", "(?a", "(?L")):
            raise ValueError(f"pattern {pattern!r} uses {rest[:3]!r}, which is not supported")
        else:
            piece, size = rest[0], 1
        out.append(piece)
        at += size
    return "".join(out)


def _expansion(template: str, pattern: str):
    """Yield text and group numbers of an expansion such as ``\\1_x_\\g<name>``."""
    names = re.compile(pattern).groupindex
    escapes = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}
    for text, number, name, escape in re.findall(
        r"([^\\]+)|\\([0-9]{1,2})|\\g<(\w+)>|\\(.)", template, re.DOTALL
    ):
        if text:
            yield text
        elif number or name:
            yield int(number or name) if (number or name).isdigit() else names[name]
        elif escape in escapes:
            yield escapes[escape]
        else:
            raise ValueError(f"expansion {template!r} has an unknown escape \\{escape}")


def capture(path: Column, match: str, expand: str | None = None) -> Column:
    """Text made of the groups of the first hit; NULL without a hit.

    Groups fill ``expand``, or are joined by ``_``. A group that took no part
    in the hit is empty.
    """
    java = java_regex(match)
    groups = re.compile(match).groups

    def group(index: int) -> Column:
        if index > groups:
            raise ValueError(f"pattern {match!r} has no group {index}")
        return F.regexp_extract(path, java, index)

    if expand is None:
        text = F.concat_ws("_", *[group(i + 1) for i in range(groups)]) if groups else F.lit("")
    else:
        steps = list(_expansion(expand, match))
        text = F.concat(
            F.lit(""), *[group(s) if isinstance(s, int) else F.lit(s) for s in steps]
        )
    return F.when(path.rlike(java), text)


def _render(token: str, value: Column, spec: str) -> Column:
    if token in DATE_TIME_TOKENS:
        return strftime(value, spec or "%Y-%m-%d %H:%M:%S")
    text = F.initcap(value.cast("string")) if token in FLAG_TOKENS else value.cast("string")
    if token in INTEGER_TOKENS:
        number = re.fullmatch(r"(0?)(\d*)d?", spec)
        if number is None:
            raise ValueError(f"format {spec!r} of {{{token}}} is not supported")
        return _at_least(text, int(number[2] or 0), number[1] or " ", left=True)
    side = re.fullmatch(r"([<>]?)(\d*)s?", spec)
    if side is None:
        raise ValueError(f"format {spec!r} of {{{token}}} is not supported")
    return _at_least(text, int(side[2] or 0), " ", left=side[1] == ">")


def _at_least(text: Column, width: int, fill: str, left: bool) -> Column:
    if width == 0:
        return text
    padded = F.lpad(text, width, fill) if left else F.rpad(text, width, fill)
    return F.when(F.length(text) < width, padded).otherwise(text)


def template_tokens(template: str | None) -> set[str]:
    return {name for _, name, _, _ in Formatter().parse(template or "") if name is not None}


def render_name(template: str, tokens: dict[str, Column], old_extension: Column) -> Column:
    """Fill a ``str.format`` template; the old extension is added if it names none.

    Captured text that is NULL is empty; a NULL date makes the name NULL.
    """
    pieces: list[Column] = []
    for text, name, spec, conversion in Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name is None:
            continue
        if name not in tokens or conversion:
            raise ValueError(f"template {template!r} uses an unknown tag {{{name}}}")
        value = tokens[name]
        if name == "regex":
            value = F.coalesce(value, F.lit(""))
        pieces.append(_render(name, value, spec or ""))
    if not posixpath.splitext(template)[1]:
        pieces.append(old_extension)
    return F.concat(*pieces)
