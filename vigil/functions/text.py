"""Render text templates as Spark columns (and as SQL for the oracle).

Templates use Python format syntax: ``{name}`` inserts a value as text,
``{name:.Nf}`` a number with N decimals, ``{name:.N%}`` a ratio as percent
with N decimals, and ``{{`` / ``}}`` are literal braces. Numbers are rounded
HALF_UP to N decimals before formatting, so Spark and the SQL oracle agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\{\{|\}\}|\{([A-Za-z_]\w*)(?::\.(\d+)([f%]))?\}")


def _pieces(template: str):
    """Yield ('lit', text) and ('val', name, digits, kind) pieces."""
    pos, buf = 0, []
    for m in _TOKEN.finditer(template):
        buf.append(template[pos:m.start()])
        tok = m.group(0)
        if tok in ("{{", "}}"):
            buf.append(tok[0])
        else:
            if buf and "".join(buf):
                yield ("lit", "".join(buf))
            buf = []
            yield ("val", m.group(1), None if m.group(2) is None else int(m.group(2)), m.group(3))
        pos = m.end()
    buf.append(template[pos:])
    if "".join(buf):
        yield ("lit", "".join(buf))


def fmt_number(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(x.cast("double"), digits))


def fmt_ratio(x: Column, digits: int) -> Column:
    return F.concat(fmt_number(x.cast("double") * 100.0, digits), F.lit("%"))


def render(template: str, values: dict[str, Column]) -> Column:
    parts = []
    for p in _pieces(template):
        if p[0] == "lit":
            parts.append(F.lit(p[1]))
        else:
            _, name, digits, kind = p
            v = values[name]
            parts.append(v.cast("string") if digits is None else
                         fmt_number(v, digits) if kind == "f" else fmt_ratio(v, digits))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def render_sql(template: str, values: dict[str, str], rounder: Callable[[str, int], str]) -> str:
    """SQL twin of ``render``; ``rounder(expr, digits)`` rounds like Spark."""
    parts = []
    for p in _pieces(template):
        if p[0] == "lit":
            parts.append("'" + p[1].replace("'", "''") + "'")
        else:
            _, name, digits, kind = p
            v = values[name]
            if digits is None:
                parts.append(f"CAST({v} AS VARCHAR)")
            elif kind == "f":
                parts.append(f"printf('%.{digits}f', {rounder(v, digits)})")
            else:
                parts.append(f"printf('%.{digits}f', {rounder(f'({v}) * 100.0', digits)}) || '%'")
    return " || ".join(parts)
