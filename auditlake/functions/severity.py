"""Severity names, order and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order and the weight each severity takes off the score.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
WEIGHTS = {"INFO": 0, "LOW": 1, "MEDIUM": 3, "HIGH": 10, "CRITICAL": 25}


def severity_level(name: str) -> int | None:
    """Driver-side: position of a severity name, None when it is not one."""
    wanted = str(name).strip().upper()
    return SEVERITIES.index(wanted) if wanted in SEVERITIES else None


def parse_severity(name: Column) -> Column:
    """Severity name in any case to its level; NULL when it is not a severity."""
    wanted = F.upper(F.trim(name))
    return label_to(wanted, {s: i for i, s in enumerate(SEVERITIES)}, F.lit(None).cast("int"))


def severity_name(level: Column) -> Column:
    return label_to(level, dict(enumerate(SEVERITIES)), F.lit(None).cast("string"))


def severity_weight(level: Column) -> Column:
    return label_to(level, {i: WEIGHTS[s] for i, s in enumerate(SEVERITIES)}, F.lit(0))


def label_to(value: Column, table: dict, otherwise: Column) -> Column:
    """A small fixed lookup as one CASE expression."""
    chain = None
    for key, target in table.items():
        chain = (F if chain is None else chain).when(value == F.lit(key), F.lit(target))
    return chain.otherwise(otherwise)
