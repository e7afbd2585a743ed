"""Path patterns as regular expressions.

Two dialects exist on purpose: exclude patterns, where ``*`` stays inside one path
segment, and suppression patterns, where ``*`` crosses ``/`` (shell fnmatch).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import posix

_TOKENS = re.compile(r"\*\*/|\*\*|\*|\?|[^*?]+")
# One path-wide and one single-segment meaning per glob token.
_WIDE = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
_SEGMENT = {"**/": "", "**": "[^/]*", "*": "[^/]*", "?": "[^/]"}


def _translate(pattern: str, table: dict[str, str]) -> str:
    return "".join(table.get(token) if token in table else re.escape(token)
                   for token in _TOKENS.findall(pattern))


def exclude_regex(pattern: str) -> str | None:
    """One anchored expression equal to an exclude pattern; None when it never matches."""
    directory = pattern.endswith("/")
    rooted = pattern.startswith("/")
    body = pattern.strip("/")
    if not body:
        return None
    anywhere, below = "(?s:.*/)?", "(?s:/.*)?"
    wide = _translate(body, _WIDE)
    one_segment = None if "/" in body.replace("**/", "") else _translate(body, _SEGMENT)
    branches = [re.escape(body)]
    if directory:
        branches += [re.escape(body) + "(?s:/.*)", wide + below]
        if not rooted and one_segment is not None:
            branches.append(anywhere + one_segment + below)
    else:
        branches.append(wide)
        if not rooted and one_segment is not None:
            branches.append(anywhere + one_segment)
    if not rooted and not set(body) & set("*?/"):
        branches.append(anywhere + re.escape(body) + below)
    return "|".join(branches)


def exclude_pattern(patterns) -> str | None:
    """One expression for all exclude patterns; None when they match nothing."""
    parts = [rx for rx in (exclude_regex(p) for p in patterns) if rx]
    return r"\A(?:" + "|".join(parts) + r")\z" if parts else None


def is_excluded(path: Column, patterns) -> Column:
    """True where ``path`` matches any exclude pattern (one literal expression for all)."""
    whole = exclude_pattern(patterns)
    return F.lit(False) if whole is None else posix(path).rlike(whole)


def shell_translator():
    """The shell-pattern translator, built so that executors receive it by value."""
    def members(text: str) -> str:
        """The inside of a character class; reversed ranges hold nothing."""
        out, at = [], 0
        while at < len(text):
            width = 3 if text[at + 1:at + 2] == "-" and at + 2 < len(text) else 1
            low, high = text[at], text[at + width - 1]
            if low <= high:
                out.append("-".join(re.sub(r"([\\\[\]^&~|-])", r"\\\1", c) for c in ([low, high] if width == 3 else [low])))
            at += width
        return "".join(out)

    def shell_regex(pattern: str) -> str:
        """A shell pattern as an anchored expression: ``*`` and ``?`` also match ``/``."""
        out, i = [], 0
        while i < len(pattern):
            char = pattern[i]
            i += 1
            if char == "*":
                out.append(".*")
            elif char == "?":
                out.append(".")
            elif char == "[":
                # a "]" directly after "[" or "[!" is an ordinary member
                first = i + (pattern[i:i + 1] == "!")
                end = pattern.find("]", first + 1)
                if end < 0:
                    out.append(r"\[")
                    continue
                inside, negated = members(pattern[first:end]), first > i
                # an empty set matches nothing, its negation any character
                out.append(f"[{'^' if negated else ''}{inside}]" if inside else "." if negated else "(?!)")
                i = end + 1
            else:
                out.append(re.escape(char))
        return r"(?s)\A" + "".join(out) + r"\z"
    return shell_regex


def shell_regex_column(patterns: Column | str) -> Column:
    translate = shell_translator()

    def translate_batch(batch: pd.Series) -> pd.Series:
        return batch.map(translate, na_action="ignore")

    return F.pandas_udf(translate_batch, "string")(patterns)
