"""Severity helpers and fixed level maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Severity order and the level words of the log formats.
ORDER = {"info": 0, "warning": 1, "critical": 2}
WEB_LEVELS = {
    "emerg": "critical", "alert": "critical", "crit": "critical", "error": "warning",
    "warn": "warning", "notice": "info", "info": "info", "debug": "info",
}
DB_LEVELS = {"error": "warning", "warning": "info", "note": "info", "system": "info"}


def rank(severity: Column) -> Column:
    """info 0, warning 1, critical 2; anything else counts as info."""
    return (F.when(severity == "critical", F.lit(ORDER["critical"]))
            .when(severity == "warning", F.lit(ORDER["warning"]))
            .otherwise(F.lit(ORDER["info"])))


def at_least(severity: Column, minimum: Column) -> Column:
    return rank(severity) >= rank(minimum)


def actionable(severity: Column) -> Column:
    return severity.isin("warning", "critical")
