"""Secret rules: vendor token shapes, contextual values and entropy-gated assignments.

The patterns follow the vendors' published token formats. Every matcher has one capture
group, the secret value; only its redacted form leaves this module.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.masking import entropy_sql, is_placeholder_sql, redact_sql
from auditlake.functions.text import any_of, sql_list, sql_text
from auditlake.operators.catalog import CONFIG

ENTROPY_FLOOR = 3.0


@dataclass(frozen=True)
class SecretRule:
    rule_id: str
    title: str
    severity: str
    cwe: str
    anchors: tuple[str, ...]
    pattern: str
    entropy: bool = False
    unquoted: str | None = None     # second shape, only in configuration files


_QUOTED = r"[A-Za-z0-9_-]*['\"]?\s*(?::=|=>|=|:)\s*['\"]([^'\"\s]{8,})['\"]"
_BARE = r"[A-Za-z0-9_.-]*\s*[=:]\s*([^\s'\"#;(){}<>$]{8,})\s*(?:#.*)?$"
_LINE_START = r"(?i)^[+-]?\s*(?:export\s+)?[A-Za-z0-9_.-]*?"
_PASSWORD = r"(?:passw(?:or)?d|passphrase|pwd|api[-_]?key)"
_TOKEN = r"(?:token|secret|credential|private[-_]?key|access[-_]?key)"
_APP_KEY = r"(?:secret[-_]?key|jwt[-_]?secret|session[-_]?secret|signing[-_]?key|encryption[-_]?key)"

# In priority order: on one line the first rule that extracted a value reports it.
SECRET_RULES = (
    SecretRule("SEC001", "AWS access key id", "CRITICAL", "CWE-798", ("akia",),
               r"(?<![A-Za-z0-9])(AKIA[0-9A-Z]{16})(?![A-Za-z0-9])"),
    SecretRule("SEC002", "GitHub token", "CRITICAL", "CWE-798", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
               r"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36,})"),
    SecretRule("SEC003", "GitHub fine-grained token", "CRITICAL", "CWE-798", ("github_pat_",),
               r"(?<![A-Za-z0-9])(github_pat_[A-Za-z0-9_]{40,})"),
    SecretRule("SEC004", "OpenAI-style API key", "CRITICAL", "CWE-798", ("sk-",),
               r"(?<![A-Za-z0-9_-])(sk-[A-Za-z0-9_-]{20,})"),
    SecretRule("SEC005", "Slack token", "CRITICAL", "CWE-798", ("xox",),
               r"(?<![A-Za-z0-9])(xox[abeoprs]-[A-Za-z0-9-]{10,})"),
    SecretRule("SEC006", "JSON Web Token", "HIGH", "CWE-798", ("eyj",),
               r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    SecretRule("SEC007", "Database URL with a password", "CRITICAL", "CWE-798", ("://",),
               r"(?i)(?:postgres|postgresql|mysql|mariadb|mongodb|redis|rediss|amqp|amqps|mssql)(?:\+[a-z0-9]+)?"
               r"://[^\s:@/'\"]*:([^\s:@/'\"]+)@"),
    SecretRule("SEC008", "Stripe key", "CRITICAL", "CWE-798", ("k_live_", "k_test_"),
               r"(?<![A-Za-z0-9])((?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,})"),
    SecretRule("SEC009", "npm token", "CRITICAL", "CWE-798", ("npm_",),
               r"(?<![A-Za-z0-9])(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    SecretRule("SEC010", "Hugging Face token", "CRITICAL", "CWE-798", ("hf_",),
               r"(?<![A-Za-z0-9])(hf_[A-Za-z0-9]{30,})"),
    SecretRule("SEC011", "PyPI token", "CRITICAL", "CWE-798", ("pypi-",),
               r"(?<![A-Za-z0-9])(pypi-[A-Za-z0-9_-]{50,})"),
    SecretRule("SEC012", "Telegram bot token", "CRITICAL", "CWE-798", (":aa",),
               r"(?<![A-Za-z0-9])([0-9]{8,10}:AA[A-Za-z0-9_-]{33})(?![A-Za-z0-9_-])"),
    SecretRule("SEC013", "Credentials embedded in a URL", "HIGH", "CWE-798", ("://",),
               r"(?i)https?://[^\s:@/'\"]+:([^\s:@/'\"]+)@"),
    SecretRule("SEC016", "AWS secret access key", "CRITICAL", "CWE-798", ("aws",),
               r"(?i)aws[A-Za-z0-9_.-]*secret[A-Za-z0-9_.-]*['\"]?\s*[:=]\s*['\"]?"
               r"([A-Za-z0-9/+=]{40})(?![A-Za-z0-9/+=])"),
    SecretRule("SEC017", "Credential in a URL query string", "HIGH", "CWE-598", ("key=", "token=", "secret=", "password="),
               r"(?i)[?&](?:api[-_]?key|access[-_]?token|auth[-_]?token|client[-_]?secret|token|secret|password)"
               r"=([A-Za-z0-9._~%+/-]{8,})"),
    SecretRule("SEC018", "Hardcoded bearer token", "HIGH", "CWE-798", ("bearer",),
               r"(?i)bearer\s+([A-Za-z0-9._~+/-]{20,}=*)", entropy=True),
    SecretRule("SEC019", "Hardcoded application secret key", "HIGH", "CWE-798", ("secret", "key"),
               "(?i)" + _APP_KEY + _QUOTED, entropy=True,
               unquoted=_LINE_START + _APP_KEY + _BARE),
    SecretRule("SEC014", "Hardcoded password or API key", "HIGH", "CWE-798",
               ("passw", "passphrase", "pwd", "key"),
               "(?i)" + _PASSWORD + _QUOTED, entropy=True,
               unquoted=_LINE_START + _PASSWORD + _BARE),
    SecretRule("SEC015", "Hardcoded token or secret", "HIGH", "CWE-798",
               ("token", "secret", "credential", "key"),
               "(?i)" + _TOKEN + _QUOTED, entropy=True,
               unquoted=_LINE_START + _TOKEN + _BARE),
)


def hints(rules=SECRET_RULES) -> list[str]:
    """Lower-case literals of which every match contains at least one."""
    known = sorted({a for rule in rules for a in rule.anchors})
    # a hint that contains another one adds nothing
    return [h for h in known if not any(o != h and o in h for o in known)]


def any_hint_sql(low: str, rules=SECRET_RULES) -> str:
    """Necessary condition for any secret rule on a lower-cased text."""
    return f"exists(transform(array({low}), low -> exists({_listed(rules)}, h -> contains(low, h))), found -> found)"


def present_hints_sql(low: str, rules=SECRET_RULES) -> str:
    """The hints a lower-cased text holds: few, so that its lines are tested for few."""
    return f"transform(array({low}), low -> filter({_listed(rules)}, h -> contains(low, h)))[0]"


def _listed(rules) -> str:
    # Searched for in an array with ``low`` bound outside: the optimizer puts what makes ``low`` in its place, and it would be
    # lower-cased again for every hint.
    return f"array({', '.join(sql_text(h) for h in hints(rules))})"


def matches_sql(line: str, low: str, ext: str, rules=SECRET_RULES, allow=()) -> str:
    """Secrets on one line as ``array<struct<rule_id, shown, ord>>``, redacted. ``low`` is the line in lower case.

    Each distinct value is reported once per line, by the first rule that extracts it. A rule without an anchor on the line
    does not try its expression.
    """
    none = "cast(array() as array<struct<value:string,ord:int,rule_id:string>>)"
    found = []
    for position, rule in enumerate(rules):
        anchored = " or ".join(f"contains({low}, {sql_text(a)})" for a in rule.anchors)
        for pattern, gate in ((rule.pattern, ""), (rule.unquoted, f"{ext} in {sql_list(CONFIG)} and ")):
            if pattern:
                values = f"filter(regexp_extract_all({line}, {sql_text(pattern)}, 1), v -> {_plausible('v', rule, allow)})"
                found.append(
                    f"if(({anchored}) and {gate}{line} rlike {sql_text(pattern)}, transform({values}, v -> named_struct("
                    f"'value', v, 'ord', {position}, 'rule_id', {sql_text(rule.rule_id)})), {none})")
    # equal values stand next to each other, the strongest rule first
    return (f"flatten(transform(array(array_sort(concat({', '.join(found)}))), ranked -> transform("
            "filter(transform(ranked, (m, i) -> named_struct('m', m, 'again', i > 0 and m.value = "
            "coalesce(get(ranked, i - 1).value, ''))), p -> not p.again), "
            f"p -> named_struct('rule_id', p.m.rule_id, 'shown', {redact_sql('p.m.value')}, 'ord', p.m.ord))))")


def _plausible(value: str, rule: SecretRule, allow) -> str:
    parts = [f"{value} <> ''", f"not {is_placeholder_sql(value)}"]
    if isinstance(allow, str):   # a column with the row's own list, in lower case
        parts.append(f"not exists({allow}, a -> contains(lower({value}), a))")
    else:
        parts += [f"not contains(lower({value}), {sql_text(a.lower())})" for a in allow if a]
    if rule.entropy:
        # CASE keeps the entropy off values that already failed
        return f"case when {' and '.join(parts)} then {entropy_sql(value)} >= {ENTROPY_FLOOR}D else false end"
    return " and ".join(parts)


def allowed_after_redaction(evidence: Column, message: Column, allow) -> Column:
    """The second allow-list pass, over what the finding shows."""
    if isinstance(allow, str):
        return F.exists(allow, lambda a: F.contains(F.lower(evidence), a) | F.contains(F.lower(message), a))
    return any_of([F.contains(F.lower(c), F.lit(a.lower()))
                   for a in allow if a for c in (evidence, message)])
