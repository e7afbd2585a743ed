"""ANSI-SQL building blocks that restate the derived inputs and rules for DuckDB.

RE2 has no look-around, so rules that use it are restated; everything that Spark computes
with arrays inside a row is restated here relationally (recursion, windows, joins).
"""

from __future__ import annotations

from auditlake.functions.masking import PLACEHOLDER
from auditlake.functions.severity import severity_level
from auditlake.operators.catalog import CONFIG, LINE_RULES, advice
from auditlake.operators.secrets import ENTROPY_FLOOR, SECRET_RULES
from auditlake.plans.corpus import DIRECTORIES
from auditlake.plans.samples import SAMPLES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def q_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def q_in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def pick(values, index: str) -> str:
    return f"({q_list(values)})[(({index}) % {len(values)}) + 1]"


def case(column: str, table: dict) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items()) + " END"


def redact(v: str) -> str:
    keep = f"least(10, (length({v}) * 6) // 10)"
    tail = f"(({keep} * 4) // 10)"
    return f"(left({v}, CAST({keep} - {tail} AS BIGINT)) || '…' || CASE WHEN {tail} > 0 THEN right({v}, CAST({tail} AS BIGINT)) ELSE '' END)"


def strip(v: str) -> str:
    return rf"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


def fingerprint(message="message") -> str:
    return f"substr(sha1(rule_id || '|' || path || '|' || CAST(line AS VARCHAR) || '|' || left({message}, 80)), 1, 12)"


def stable(evidence="evidence") -> str:
    return rf"substr(sha1(rule_id || '|' || replace(path, '\', '/') || '|' || left({strip(evidence)}, 120)), 1, 12)"


def ext(path: str) -> str:
    name = f"lower(regexp_extract({path}, '[^/]*$'))"
    return (f"CASE WHEN starts_with({name}, '.env') THEN '.env' "
            f"WHEN {name} = 'dockerfile' OR starts_with({name}, 'dockerfile.') THEN '.dockerfile' "
            rf"ELSE regexp_extract({name}, '^.+(\.[^.]+)$', 1) END")


N = len(SAMPLES)
FILES = f"""
files AS (
  SELECT *, {ext('path')} AS ext FROM (
    SELECT source AS repo, doc_id, doc_id % 3 <> 0 AS tracked,
      'src/d' || doc_id || '/' || {pick([n for n, _ in SAMPLES], 'doc_id')} AS path,
      text || chr(10) || {pick([t for _, t in SAMPLES], 'doc_id')} || chr(10) AS text
    FROM documents))"""

PLACED_NAMES = sorted({n for n, _ in SAMPLES}) + [
    "bundle.min.js", "yarn.lock", "photo.png", "Makefile", "id_rsa", ".env.local", "server.pem", "store.p12",
    "credentials", ".envrc", "dockerfile.prod", "README", "x.map"]
PLACED = f"""
placed AS (
  SELECT *, regexp_extract(path, '[^/]*$') AS name, string_split(path, '/') AS parts, {ext('path')} AS ext FROM (
    SELECT source AS repo, doc_id, n_chars * 400 AS size_bytes, doc_id % 4 <> 0 AS tracked, text,
      {pick(DIRECTORIES, 'doc_id')} || '/d' || doc_id || '/' || {pick(PLACED_NAMES, 'doc_id // 3')} AS path
    FROM documents))"""


def phys(source: str = "files") -> str:
    return f"""
phys AS (
  SELECT repo, path, ext, CAST(generate_subscripts(ls, 1) AS INT) AS line, unnest(ls) AS text, len(ls) AS n FROM (
    SELECT repo, path, ext, CASE WHEN sp[len(sp)] = '' THEN sp[1:len(sp) - 1] ELSE sp END AS ls FROM (
      SELECT repo, path, ext, string_split(text, chr(10)) AS sp FROM {source})))"""


# Logical lines by recursion over line numbers (one step per line, all files at once).
LOGICAL = rf"""
pieces AS (SELECT repo, path, ext, line, n, {strip('text')} AS piece FROM phys),
walk AS (
  SELECT repo, path, ext, line, n, line AS start, piece AS buf, piece FROM pieces WHERE line = 1
  UNION ALL
  SELECT p.repo, p.path, p.ext, p.line, p.n,
    CASE WHEN w.done THEN p.line ELSE w.start END,
    CASE WHEN w.done THEN p.piece ELSE w.buf || ' ' || p.piece END, p.piece
  FROM pieces p JOIN (
    SELECT *, (length(buf) >= 10000 OR NOT (
        length(replace(buf, '(', '')) < length(replace(buf, ')', '')) OR right(piece, 1) IN (',', '('))) AS done
    FROM walk) w ON p.repo = w.repo AND p.path = w.path AND p.line = w.line + 1),
logical AS (
  SELECT repo, path, ext, start AS line, buf AS text FROM walk
  WHERE line = n OR length(buf) >= 10000 OR NOT (
    length(replace(buf, '(', '')) < length(replace(buf, ')', '')) OR right(piece, 1) IN (',', '(')))"""

# Rules restated without look-around: (must match, must not match).
RE2 = {
    "SEC037": (r"(?:^|[^\w.])(?:__import__|importlib\.import_module)\s*\(\s*(?:[^\s'\"]|$)", None),
    "SEC040": (r"chmod\s+(?:-R\s+)?[0-7]{0,3}777(?:[^0-9]|$)|chmod\s+a\+rwx|icacls\s+\S+\s+/grant\s+\S+:F\b|0o777\b", None),
    "SEC046": (r"(?:^|[^\w.])(?:requests|httpx)\.(?:get|post|put|delete|head|patch|request)\s*\(",
               r"(?:requests|httpx)\.(?:get|post|put|delete|head|patch|request)\s*\(.*\btimeout\s*="),
    "SEC057": (r"(?:^|[^\w.])(?:jwt|jsonwebtoken)\.decode\s*\(",
               r"(?:jwt|jsonwebtoken)\.decode\s*\([^)]{0,400}\balgorithms\s*="),
    "SEC078": (r"(?:^|[^\w.>]|[^-]>)(?:system|exec|passthru|shell_exec|popen|proc_open)\s*\(", None),
}


def re2_rule(rule) -> tuple[str, str | None]:
    if rule.rule_id in RE2:
        return RE2[rule.rule_id]
    pattern = rule.pattern.replace(r"(?<![\w.])", r"(?:^|[^\w.])").replace(r"(?<![\w.$])", r"(?:^|[^\w.$])")
    assert "(?<" not in pattern and "(?!" not in pattern, rule.rule_id
    return pattern, rule.negate


def mask_assignment(t: str) -> str:
    shape = r"'^(\s*(?:ENV|ARG)\s+[A-Za-z0-9_]+\s*=\s*)(.*)$'"
    value = strip(f"regexp_extract({t}, {shape}, 2)")
    quoted = f"(length({value}) >= 2 AND left({value}, 1) IN ('''', '\"') AND right({value}, 1) = left({value}, 1))"
    inner = f"CASE WHEN {quoted} THEN substr({value}, 2, length({value}) - 2) ELSE {value} END"
    quote = f"CASE WHEN {quoted} THEN left({value}, 1) ELSE '' END"
    return (f"CASE WHEN NOT regexp_matches({t}, {shape}) THEN {redact(t)} WHEN ({inner}) = '' THEN {t} "
            f"ELSE regexp_extract({t}, {shape}, 1) || {quote} || {redact('(' + inner + ')')} || {quote} END")


def line_hits(rules=LINE_RULES, source: str = "logical") -> str:
    """One branch per rule, so that every pattern is a constant."""
    branches = []
    for rule in rules:
        must, must_not = re2_rule(rule)
        shown = mask_assignment("text") if rule.rule_id == "SEC072" else "text"
        negation = "" if must_not is None else f" AND NOT regexp_matches(text, {q('(?i)' + must_not)})"
        branches.append(
            f"SELECT repo, path, ext, line, {q(rule.rule_id)} AS rule_id, {q(rule.title)} AS title, "
            f"{severity_level(rule.severity)} AS sev, {q(rule.cwe)} AS cwe, {q(rule.confidence)} AS confidence, "
            f"{q(advice(rule.rule_id))} AS fix, {strip(shown)} AS shown FROM {source} "
            f"WHERE ext IN {q_in(sorted(set(rule.langs)))} AND ext <> '.lock' "
            f"AND regexp_matches(text, {q('(?i)' + must)}){negation}")
    return "\nUNION ALL\n".join(branches)


CODE_FINDING = ("repo, rule_id, CAST(sev AS INT) AS sev, title || ': ' || left(shown, 120) AS message, path, line, "
                "left(shown, 160) AS evidence")


def re2_secret(pattern: str) -> str:
    for class_ in ("[A-Za-z0-9]", "[A-Za-z0-9_-]", "[A-Za-z0-9/+=]"):
        outside = "[^" + class_[1:]
        pattern = pattern.replace(f"(?<!{class_})", f"(?:^|{outside})").replace(f"(?!{class_})", f"(?:{outside}|$)")
    assert "(?<" not in pattern and "(?!" not in pattern, pattern
    return pattern


def secret_values(source: str, text: str = "text", keep: str = "repo, path, ext, line") -> str:
    """Plausible secret values with their rule, before same-line precedence."""
    branches = []
    for position, rule in enumerate(SECRET_RULES):
        for pattern, gate in ((rule.pattern, "true"), (rule.unquoted, f"ext IN {q_in(CONFIG)}")):
            if pattern:
                branches.append(
                    f"SELECT {keep}, {position} AS ord, {q(rule.rule_id)} AS rule_id, {q(rule.title)} AS title, "
                    f"{severity_level(rule.severity)} AS sev, {str(rule.entropy).lower()} AS gated, "
                    f"unnest(regexp_extract_all({text}, {q(re2_secret(pattern))}, 1)) AS v "
                    f"FROM {source} WHERE {gate} AND regexp_matches({text}, {q(re2_secret(pattern))})")
    return f"""
raw_values AS ({chr(10).join(b if i == 0 else "UNION ALL " + b for i, b in enumerate(branches))}),
value_bits AS (
  SELECT v, -sum(p * log2(p)) AS bits FROM (
    SELECT v, c, count(*) / any_value(length(v)) AS p FROM (
      SELECT v, unnest(string_split(v, '')) AS c FROM (SELECT DISTINCT v FROM raw_values WHERE gated)) GROUP BY v, c) GROUP BY v),
secret_values AS (
  SELECT r.* FROM raw_values r LEFT JOIN value_bits b ON r.v = b.v
  WHERE r.v <> '' AND NOT regexp_matches(r.v, {q(PLACEHOLDER)}) AND (NOT gated OR bits >= {ENTROPY_FLOOR})
  QUALIFY row_number() OVER (PARTITION BY {", ".join("r." + c.strip() for c in keep.split(","))}, r.v ORDER BY ord) = 1)"""


EVENT_FINDINGS = """
ev AS (
  SELECT *, 'd' || (k % 5) || '/f' || k || '.py' AS path, 'Event ' || event_type || ', key % ' || k AS message FROM (
    SELECT 'u' || (user_id % 10) AS repo, 'EV' || upper(event_type) AS rule_id, event_type,
      'Event ' || event_type AS title,
      CAST(CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS INT) AS sev,
      CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' WHEN 'click' THEN 'LOW' ELSE 'INFO' END AS severity,
      CAST(json_extract(props, '$.k') AS INT) % 10 AS k, CAST(hour(ts) AS INT) AS line,
      'value: ' || CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS evidence,
      'Look <here> & "there".' AS fix, 'CWE-1' AS cwe, 'medium' AS confidence, event_id AS pos
    FROM events))"""
