"""Redaction and the plausibility gates for extracted secret values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import let, sql_text


def redact_sql(value: str) -> str:
    """Head and tail of a value with the middle gone; at most 60 % and 10 characters show."""
    shown = f"least(10, length({value}) * 6 div 10)"
    tail = f"({shown} * 4 div 10)"
    return (f"concat(substr({value}, 1, cast({shown} - {tail} as int)), '…', "
            f"right({value}, cast({tail} as int)))")


def redact(value: Column) -> Column:
    return let(value, lambda v: F.concat(
        F.substr(v, F.lit(1), _shown(v) - _tail(v)), F.lit("…"), F.right(v, _tail(v))))


def _shown(value: Column) -> Column:
    return F.least(F.lit(10), F.floor(F.length(value) * 6 / 10)).cast("int")


def _tail(value: Column) -> Column:
    return F.floor(_shown(value) * 4 / 10).cast("int")


def entropy_sql(value: str) -> str:
    """Shannon entropy of the characters, in bits per character."""
    share = f"((length({value}) - length(replace({value}, ch, ''))) / length({value}))"
    return (f"aggregate(filter(array_distinct(split({value}, '')), ch -> ch <> ''), cast(0 as double), "
            f"(bits, ch) -> bits - {share} * log2({share}))")


def entropy(column: str) -> Column:
    return F.expr(entropy_sql(column))


# Shapes that are never live credentials (whole value, any case).
PLACEHOLDER = (
    r"(?i)\A(?:change[-_ ]?me|changeit|replace[-_ ]?me|placeholder|example|sample|dummy|fake|test"
    r"|password|passwd|secret|token|api[-_]?key|none|null|nil|true|false|undefined|todo|tbd|redacted"
    r"|your[-_ ].*|my[-_ ](?:password|secret|token|api[-_]?key)|insert[-_ ].*|enter[-_ ].*"
    r"|x{3,}|\*{3,}|\.{3,}|-{3,}|0{4,}|<.*>|\$\{.*\}|\$\(.*\)|\$[A-Za-z_][A-Za-z0-9_]*|\{\{.*\}\}"
    r"|\{.*\}|%\(.*\)s|%[A-Za-z_]+%|(?:str|string|bytes|int|bool|optional|list|dict)(?:\[.*\])?)\z"
)


def is_placeholder_sql(value: str) -> str:
    return f"{value} rlike {sql_text(PLACEHOLDER)}"


def mask_assignment_sql(text: str) -> str:
    """Keep ``ENV NAME=`` and the quotes, redact the value; unknown shapes go entirely."""
    shape = sql_text(r"(?Ud)^(\s*(?:ENV|ARG)\s+[A-Za-z0-9_]+\s*=\s*)(.*)$")
    edges = sql_text(r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$")

    def bound(value: str, name: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    quote = ("if(length(val) >= 2 and left(val, 1) in ('\\'', '\"') and left(val, 1) = right(val, 1), "
             "left(val, 1), '')")
    masked = bound(f"substr(val, 1 + length(qt), length(val) - 2 * length(qt))", "body",
                   f"if(body = '', {text}, concat(regexp_extract({text}, {shape}, 1), qt, {redact_sql('body')}, qt))")
    value = f"regexp_replace(regexp_extract({text}, {shape}, 2), {edges}, '')"
    return (f"if({text} rlike {shape}, {bound(value, 'val', bound(quote, 'qt', masked))}, {redact_sql(text)})")
