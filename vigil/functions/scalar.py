"""Scalar column functions: status labels and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and display formats.
LOG_LEVELS = ((500, "ERROR"), (400, "WARN"))      # status >= threshold → level; else INFO
DEFAULT_LOG_LEVEL = "INFO"
HEALTH_LEVELS = ("red", "amber", "green")        # >= critical, >= warn, else
BANNER_OK = "HEALTHY"
BANNER_ALERT = "%d ANOMALIES DETECTED"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
OPTION_LABEL = "%s | score=%.3f | %s"


def log_level(status: Column) -> Column:
    """HTTP status → ERROR (>=500) / WARN (>=400) / INFO."""
    expr = F.lit(DEFAULT_LOG_LEVEL)
    for threshold, level in reversed(LOG_LEVELS):
        expr = F.when(status >= threshold, level).otherwise(expr)
    return expr


def ticket_status(resolved_at: Column) -> Column:
    return F.when(resolved_at.isNull(), "open").otherwise("resolved")


def health_color(value: Column, warn: Column, crit: Column) -> Column:
    """Traffic-light level: red at or above critical, amber at or above warn."""
    red, amber, green = HEALTH_LEVELS
    return F.when(value >= crit, red).when(value >= warn, amber).otherwise(green)


def status_banner(flagged: Column) -> Column:
    return F.when(flagged == 0, F.lit(BANNER_OK)).otherwise(F.format_string(BANNER_ALERT, flagged))


def title_case_label(c: Column) -> Column:
    """``replace('_', ' ').title()`` for identifier-like labels."""
    return F.initcap(F.regexp_replace(c, "_", " "))


def fmt_timestamp(c: Column) -> Column:
    return F.date_format(c, TIMESTAMP_FORMAT)


def fmt_fixed(c: Column, digits: int) -> Column:
    """Python's ``f"{x:.{digits}f}"`` (no thousands separator)."""
    return F.format_string(f"%.{digits}f", c)


def fmt_money(c: Column) -> Column:
    """``"${:,.0f}"``."""
    return F.concat(F.lit("$"), F.format_number(F.round(c, 0), 0))


def fmt_percent(c: Column, digits: int = 1) -> Column:
    """``"{:.1%}"``: ratio × 100 with a percent sign."""
    return F.concat(F.format_string(f"%.{digits}f", c * 100.0), F.lit("%"))


def fmt_percent_value(c: Column, digits: int = 1) -> Column:
    """``"{:.1f}%"``: value already in percent."""
    return F.concat(F.format_string(f"%.{digits}f", c), F.lit("%"))


def option_label(ts: Column, score: Column, kind: Column) -> Column:
    """"<ts> | score=<.3f> | <type>" picker labels."""
    return F.format_string(OPTION_LABEL, fmt_timestamp(ts), score, kind)
