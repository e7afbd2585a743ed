"""The pass over file text: every per-file rule in one narrow projection.

Plan shape: scan(files) -> project -> explode(findings) -> broadcast catalog. The text is
read once and nothing but findings leaves the row.

1. Anchors: one lower-cased copy of the file and plain substring searches decide which
   rules can fire at all. Most files keep no rule and skip everything below.
2. Lines: files with a code candidate get logical lines, folded in Python only where a
   statement really spans lines.
3. Rules: every surviving rule filters the line arrays with its literal expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.masking import mask_assignment_sql
from auditlake.functions.text import UNICODE, UNICODE_NOCASE, any_of, ext_of, sql_list, sql_text, strip
from auditlake.operators import secrets, state_rules
from auditlake.operators.catalog import DOCKER, FILE_RULES, LINE_RULES, YAML, builtin_size, catalog
from auditlake.operators.inline_ignore import is_ignored
from auditlake.operators.lines import with_logical_lines
from auditlake.operators.settings import ROW, RepoSettings
from auditlake.options import ScanOptions

HIT = "array<struct<rule_id:string,line:int,shown:string,message:string,scanner:string>>"
NONE = f"cast(array() as {HIT})"
EVIDENCE_MAX, MESSAGE_MAX = 160, 120        # fixed values
MASKED_RULES = ("SEC072",)

# Characters that equal an ASCII letter only under Unicode case folding; a file holding
# one skips the anchor shortcut.
_FOLDING = ("\u017f", "\u212a", "\u0130", "\u0131")


def _anchored(rule) -> str:
    hits = " or ".join(f"contains(_low, {sql_text(a)})" for a in rule.anchors)
    return f"ext in {sql_list(rule.langs)} and (_folds_odd or {hits})"


def _mask(rules) -> str:
    """One bit per line rule whose language and anchors occur in the file."""
    bits = [f"if({_anchored(rule)}, {1 << position}L, 0L)" for position, rule in enumerate(rules)]
    return " + ".join(bits) or "0L"


def _hit(rule_id: str, line: str, shown: str, scanner: str, message: str = "''") -> str:
    return (f"named_struct('rule_id', {sql_text(rule_id)}, 'line', {line}, 'shown', {shown}, "
            f"'message', {message}, 'scanner', '{scanner}')")


def _line_rule_hits(position: int, rule) -> str:
    fires = f"l.text rlike {sql_text(UNICODE_NOCASE + rule.pattern)}"
    if rule.negate is not None:
        fires += f" and not l.text rlike {sql_text(UNICODE_NOCASE + rule.negate)}"
    return (f"if(getbit(_code_mask, {position}) = 1, transform(filter(logical, l -> {fires}), "
            f"l -> {_hit(rule.rule_id, 'l.line', 'l.text', 'code')}), {NONE})")


def _file_rule_hits(rule) -> str:
    fires = " and ".join(f"text rlike {sql_text(p)}" for p in rule.patterns)
    return (f"if(case when {_anchored(rule)} then {fires} else false end, "
            f"array({_hit(rule.rule_id, '0', sql_text(''), 'code')}), {NONE})")


def _custom_rule_hits(place: int, rule) -> str:
    gate = "true" if rule.extensions is None else f"ext in {sql_list(rule.extensions)}"
    fires = f"l.text rlike {sql_text(UNICODE + rule.pattern)}"
    return (f"if({gate}, transform(filter(physical, l -> {fires}), "
            f"l -> {_hit(rule.id, 'l.line', 'l.text', f'custom:{place}')}), {NONE})")


def _secret_hits(rules, allow) -> str:
    matches = secrets.matches_sql("l.text", "l.low", "ext", rules, allow)
    lowered = "transform(physical, l -> named_struct('line', l.line, 'text', l.text, 'low', lower(l.text)))"
    return (f"if(size(_hints) > 0, flatten(transform(filter({lowered}, l -> exists(_hints, "
            f"h -> contains(l.low, h))), l -> transform({matches}, m -> named_struct("
            f"'rule_id', m.rule_id, 'line', l.line, 'shown', m.shown, 'message', '', 'scanner', 'secrets')))), {NONE})")


def _state_rule_hits(rule_id: str, exts, wanted: Column, hits: Column) -> Column:
    return F.when(F.when(F.col("ext").isin(*exts), wanted).otherwise(False), F.transform(
        hits, lambda h: F.struct(
            F.lit(rule_id).alias("rule_id"), h["line"].alias("line"), h["shown"].alias("shown"),
            h["message"].alias("message"), F.lit("code").alias("scanner")))
    ).otherwise(F.expr(NONE))


def scan_files(files: DataFrame, options: ScanOptions | RepoSettings | None = None, *,
               line_rules=LINE_RULES, file_rules=FILE_RULES, state_rules_on: bool = True,
               secret_rules=secrets.SECRET_RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Findings of all per-file rules, with ``ignored`` marking inline-suppressed ones.

    ``files`` needs repo, path and text and is taken as already selected (see
    ``sources.files.discover``). With settings per repository, each file is scanned by those of its own. Columns of the
    file named in ``carry`` are kept on its findings.
    """
    options = options or ScanOptions()
    own = isinstance(options, RepoSettings)
    allow = f"{ROW}.allow" if own else [a for a in options.allow_secrets if a]
    if own:
        files = options.attach(files)
    if len(line_rules) > 63:
        raise ValueError("a rule mask holds 63 line rules")

    seen = files.select("repo", "path", "text", *carry, *([ROW] if own else [])).withColumns({
        "ext": ext_of(F.col("path")), "_low": F.lower("text"),
        "_folds_odd": any_of([F.contains(F.col("text"), F.lit(c)) for c in _FOLDING])})
    # Lock files are for the secret rules only.
    is_lock = "lower(path) like '%.lock'"
    masked = seen.withColumns({
        "_code_mask": F.expr(f"if({is_lock}, 0L, {_mask(line_rules)})"),
        "_hints": F.expr(secrets.present_hints_sql("_low", secret_rules) if secret_rules
                         else "cast(array() as array<string>)")})
    lined = with_logical_lines(masked, F.col("_code_mask") != 0)

    code = [F.expr(_line_rule_hits(i, r)) for i, r in enumerate(line_rules)]
    code += [F.expr(_file_rule_hits(r)) for r in file_rules]
    if state_rules_on:
        code.append(_state_rule_hits(
            "SEC041", YAML, F.col("text").rlike(state_rules.UNTRUSTED),
            state_rules.script_injection_hits(F.col("physical"))))
        code.append(_state_rule_hits(
            "SEC070", DOCKER, F.contains(F.col("_low"), F.lit("from")) | F.col("_folds_odd"),
            state_rules.untagged_image_hits(F.col("physical"))))
    if own:
        code += options.custom_hits(_hit, NONE)
    else:
        code += [F.expr(_custom_rule_hits(i, r)) for i, r in enumerate(options.custom_rules)]
    groups = [F.expr(_secret_hits(secret_rules, allow))] if secret_rules else []
    if code:
        groups.append(F.when(F.expr(is_lock), F.expr(NONE)).otherwise(F.concat(*code)))
    hits = lined.withColumn("_hits", F.concat(*groups) if groups else F.expr(NONE))

    # what the findings still need of their repository's settings
    kept = ["repo", "path", *carry, *([F.col(f"{ROW}.allow").alias("allow"), F.col(f"{ROW}.rule_keys").alias("rule_keys")] if own else [])]
    names = ["repo", "path", *carry, *(["allow", "rule_keys"] if own else [])]
    if own or options.inline_suppressions:
        if own:
            marker = F.col(f"{ROW}.marker")
            marked = F.col(f"{ROW}.inline") & (F.contains(F.col("_low"), F.col(f"{ROW}.word")) | F.col("_folds_odd"))
        else:
            marker = options.ignore_marker.lower()
            marked = F.contains(F.col("_low"), F.lit(marker)) | F.col("_folds_odd")
        text_at = lambda n: F.get(F.col("physical")["text"], n)
        ignored = lambda h: F.when(h["line"] > 0, is_ignored(
            h["rule_id"], text_at(h["line"] - 1), text_at(h["line"] - 2), marker)).otherwise(False)
        never = F.transform("_hits", lambda h: F.lit(False))
        flags = F.when(marked, F.transform("_hits", ignored)).otherwise(never)
        rows = (hits.withColumn("_ignored", flags)
                .select(*kept, F.explode_outer(F.arrays_zip("_hits", "_ignored")).alias("h"))
                .select(*names, F.col("h._hits.*"), F.col("h._ignored").alias("ignored")))
    else:
        rows = hits.select(*kept, F.inline_outer("_hits")).withColumn("ignored", F.lit(False))
    # The outer form on purpose: for the plain one Spark infers a "not empty" filter and pushes
    # it, with the whole hit expression inside, below every step above. The empty rows go here.
    return _describe(rows.where(F.col("rule_id").isNotNull()), options, "allow" if own else allow, carry)


def _describe(rows: DataFrame, options: ScanOptions | RepoSettings, allow, carry: tuple[str, ...] = ()) -> DataFrame:
    """Attach the rule metadata and finish message and evidence."""
    # The catalog has one row per rule: its size is fixed by the code and the options. Custom rules are told apart by
    # their place or key, since several may share an id.
    own = isinstance(options, RepoSettings)
    size = builtin_size()
    described = ["title", "sev", "severity", "cwe", "confidence", "fix", "scan_seq", F.col("message").alias("fixed_message")]
    rules = catalog(rows.sparkSession, () if own else options.custom_rules).select(
        F.when(F.col("kind") == "custom", F.concat(F.lit("custom:"), (F.col("scan_seq") - size).cast("string")))
        .otherwise(F.concat(F.lit("builtin:"), "rule_id")).alias("rule_key"), *described)
    custom = F.col("scanner").startswith("custom:")
    keyed = rows.withColumn("rule_key", F.when(custom, F.col("scanner")).otherwise(F.concat(F.lit("builtin:"), "rule_id")))
    if own:
        place = F.array_position("rule_keys", F.substr(F.col("scanner"), F.lit(8))).cast("int") - 1
        joined = keyed.join(options.all_rules(rules, size), "rule_key").withColumn(
            "scan_seq", F.when(custom, F.col("scan_seq") + place).otherwise(F.col("scan_seq")))
    else:
        joined = keyed.join(F.broadcast(rules), "rule_key")
    joined = joined.withColumn("scanner", F.when(custom, "custom").otherwise(F.col("scanner")))
    # one step each: what is used several times must be a column, not an expression
    joined = joined.withColumn("whole", strip(F.col("shown"))).withColumn("shown", F.substring(F.when(
        F.col("rule_id").isin(*MASKED_RULES), F.expr(mask_assignment_sql("whole"))).otherwise(F.col("whole")),
        1, EVIDENCE_MAX))
    message = (F.when(F.col("message") != "", F.col("message"))
               .when(F.col("fixed_message") != "", F.col("fixed_message"))
               .when(F.col("line") == 0, F.col("title"))
               .otherwise(F.concat("title", F.lit(": "), F.substring("shown", 1, MESSAGE_MAX))))
    out = joined.select(
        "repo", "rule_id", "title", "sev", "severity", message.alias("message"), "path", "line",
        F.col("shown").alias("evidence"), "fix", "cwe", "confidence", "scanner",
        F.col("scan_seq").cast("int").alias("scan_seq"), "ignored", *carry, *(["allow"] if own else []))
    if own or allow:
        out = out.where(~((F.col("scanner") == "secrets") & secrets.allowed_after_redaction(
            F.col("evidence"), F.col("message"), allow)))
    return out.drop("allow") if own else out
