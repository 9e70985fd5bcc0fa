"""Render a fixed text template with ``{column}`` / ``{column:spec}`` slots
as one ``concat`` expression (X12).  Specs: ``.Nf``, ``+.Nf``, ``.N%`` and
none; floats use ``scalar.fixed`` so digits match Python's formatting, and a
NULL float prints as ``nan`` like Python's NaN."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketsig.functions.scalar import fixed, percent, signed_fixed

SLOT = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")


def pieces(template: str) -> list[tuple[str, str | None, str | None]]:
    """Split into (literal, name, spec) triples."""
    out, pos = [], 0
    for m in SLOT.finditer(template):
        out.append((template[pos:m.start()], m.group(1), m.group(2)))
        pos = m.end()
    out.append((template[pos:], None, None))
    return out


def fmt_value(c: Column, spec: str | None) -> Column:
    if not spec:
        return F.coalesce(c.cast("string"), F.lit("None"))
    m = re.fullmatch(r"(\+?)\.(\d+)([f%])", spec)
    if not m:
        raise ValueError(f"unsupported format spec {spec!r}")
    sign, digits, kind = m.group(1), int(m.group(2)), m.group(3)
    if kind == "%":
        v = percent(c, digits)
    elif sign:
        v = signed_fixed(c, digits)
    else:
        v = fixed(c, digits)
    return F.coalesce(v, F.lit("nan" if kind == "f" else "nan%"))


def render(template: str, cols: dict[str, Column] | None = None) -> Column:
    """``cols`` maps slot names to expressions (default: the column of that name)."""
    cols = cols or {}
    parts = []
    for lit, name, spec in pieces(template):
        if lit:
            parts.append(F.lit(lit))
        if name:
            parts.append(fmt_value(cols.get(name, F.col(name)), spec))
    return F.concat(*parts)
