"""Text helpers whose results follow Python's str semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's line boundaries and white space.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
OTHER_BREAKS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
SPACE = r"[\s\x1c-\x1f]"

# Flags that make java.util.regex agree with Python's re on str patterns.
UNICODE = "(?Ud)"
UNICODE_NOCASE = "(?iUd)"


def decode_utf8(content: Column) -> Column:
    """Bytes to text: invalid sequences become U+FFFD, a leading byte order mark goes."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(text.startswith("\ufeff"), F.substr(text, F.lit(2))).otherwise(text)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (higher-order functions share nothing)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_lines(text: Column) -> Column:
    """Physical lines without their terminators; no extra line after a final terminator.

    Ordinary text takes the JVM's plain split on a newline; only text that holds another
    terminator is split by expression.
    """
    other = any_of([F.contains(text, F.lit(c)) for c in OTHER_BREAKS])
    parts = F.when(other, F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))
    return let(parts, lambda p: F.when(
        F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+", "")


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(posix(path), "/", -1)


def suffix(name: Column) -> Column:
    """Last suffix with its dot; dot files and names ending in a dot have none."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def ext_of(path: Column) -> Column:
    """The extension class used by rule language gates."""
    name = F.lower(basename(path))
    return (F.when(name.startswith(".env"), ".env")
            .when((name == "dockerfile") | name.startswith("dockerfile."), ".dockerfile")
            .otherwise(suffix(name)))


def is_dockerfile(path: Column) -> Column:
    name = F.lower(basename(path))
    return (name == "dockerfile") | name.startswith("dockerfile.")


def sql_text(value: str) -> str:
    """A string literal for SQL expressions.

    The rule expressions are large; as SQL text they reach the JVM in one call each instead
    of one call per operator.
    """
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(sql_text(v) for v in values) + ")"


def any_of(conditions) -> Column:
    """OR of the given conditions; false when there are none."""
    out = F.lit(False)
    for i, condition in enumerate(conditions):
        out = condition if i == 0 else out | condition
    return out
