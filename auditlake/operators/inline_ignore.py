"""Inline suppression comments: ``# <marker>[-next-line] [RULE[,RULE…]]``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a rule id in a marker.
RULE_ID = r"(?U)^[A-Za-z]{2,10}\d{2,5}$"


def marker_pattern(marker: str) -> str:
    return (r"(?iUd)\b" + re.escape(marker) + r"(-next-line)?"
            r"(?:\s+([A-Za-z0-9_*,]+(?:\s*,\s*[A-Za-z0-9_*]+)*))?")


def parse_markers(line: Column, marker: str | Column) -> Column:
    """Markers behind a comment start as ``array<struct<next, rules>>``.

    ``rules`` is ``['*']`` for a bare marker and empty when no token is a rule id, so a
    mistyped id suppresses nothing. ``marker`` is the word, or a column with its ``marker_pattern``.
    """
    hash_at, slash_at = F.instr(line, "#"), F.instr(line, "//")
    comment_at = F.when(hash_at == 0, slash_at).when(slash_at == 0, hash_at).otherwise(
        F.least(hash_at, slash_at))
    comment = F.when(comment_at > 0, F.substr(line, comment_at)).otherwise("")
    pattern = marker if isinstance(marker, Column) else F.lit(marker_pattern(marker))
    return F.zip_with(
        F.regexp_extract_all(comment, pattern, F.lit(1)),
        F.regexp_extract_all(comment, pattern, F.lit(2)),
        lambda following, ids: F.struct((following != "").alias("next"),
                                        _rule_ids(ids).alias("rules")))


def _rule_ids(fragment: Column) -> Column:
    tokens = F.filter(F.split(fragment, r"(?U)[,\s]+"), lambda t: t != "")
    return F.when(~F.exists(tokens, lambda t: t != "*"), F.array(F.lit("*"))).otherwise(
        F.transform(F.filter(tokens, lambda t: t.rlike(RULE_ID)), F.upper))


def is_ignored(rule_id: Column, same_line: Column, line_before: Column, marker: str | Column) -> Column:
    """True where a marker on the finding's line, or a next-line marker before it, names it."""
    def names(line, following):
        return F.exists(parse_markers(line, marker), lambda m: (m["next"] == F.lit(following)) & (
            F.array_contains(m["rules"], "*") | F.array_contains(m["rules"], F.upper(rule_id))))
    return names(F.coalesce(same_line, F.lit("")), False) | names(
        F.coalesce(line_before, F.lit("")), True)
