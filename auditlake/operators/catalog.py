"""The rule catalog: what each rule looks for, where, and how severe it is.

Ids, titles, severities, CWE numbers, language sets and patterns are fixed values that
define the findings; the ``anchors`` and the advice texts are this package's own. An
anchor is a lower-case literal every match must contain: one cheap substring search over
a whole file decides whether a rule's expression has to run on its lines at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.severity import SEVERITIES, severity_level

# Language sets.
PY = (".py",)
JS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue", ".svelte")
WEB = (".js", ".jsx", ".ts", ".tsx", ".html", ".vue")
SHELL = (".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd")
YAML = (".yml", ".yaml")
CONFIG = (".env", ".ini", ".cfg", ".conf", ".properties", ".toml")
DOCKER = (".dockerfile",)
GO = (".go",)
JAVA = (".java",)
RB = (".rb", ".rake")
PHP = (".php", ".phtml", ".php3", ".php4", ".php5")
CS = (".cs",)
NATIVE = (".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".c++", ".h++")
MARKDOWN = (".md",)

# Extensions a full scan reads: every language set plus text formats that carry secrets.
SCANNED_EXTENSIONS = tuple(sorted({
    *PY, *JS, *WEB, *SHELL, *YAML, *CONFIG, *DOCKER, *GO, *JAVA, *RB, *PHP, *CS, *NATIVE, *MARKDOWN,
    ".json", ".xml", ".txt", ".lock", ".gradle", ".kt", ".swift", ".rs", ".scala", ".sql",
    ".tf", ".tfvars", ".pem", ".key",
}))
SCANNED_NAMES = ("Makefile", "Jenkinsfile")


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    title: str
    severity: str
    cwe: str
    confidence: str
    langs: tuple[str, ...]
    anchors: tuple[str, ...]
    pattern: str
    negate: str | None = None


@dataclass(frozen=True)
class FileRule:
    rule_id: str
    title: str
    severity: str
    cwe: str
    confidence: str
    langs: tuple[str, ...]
    anchors: tuple[str, ...]
    patterns: tuple[str, ...]
    message: str


# The line rules.
LINE_RULES = (
    LineRule("SEC020", "eval() on dynamic input", "HIGH", "CWE-95", "high",
             PY + JS + RB + PHP, ("eval",),
             r"(?<![\w.])eval\s*\("),
    LineRule("SEC021", "exec() / new Function() code execution", "HIGH", "CWE-94", "high",
             PY + JS + RB, ("exec", "function"),
             r"(?<![\w.])(?:exec\s*\(|new\s+Function\s*\()"),
    LineRule("SEC022", "Shell invocation with shell=True", "HIGH", "CWE-78", "high",
             PY + JS + YAML, ("shell",),
             r"shell\s*=\s*True|shell\s*:\s*true"),
    LineRule("SEC023", "Direct OS command execution", "HIGH", "CWE-78", "high",
             PY, ("os.system", "os.popen", "commands.getoutput"),
             r"(?<![\w.])(?:os\.system|os\.popen|commands\.getoutput)\s*\("),
    LineRule("SEC024", "Unsafe deserialization (pickle)", "HIGH", "CWE-502", "high",
             PY, ("pickle.", "marshal."),
             r"(?<![\w.])(?:pickle|cPickle)\.(?:load|loads|Unpickler)\s*\(|marshal\.(?:load|loads)\s*\("),
    LineRule("SEC025", "Unsafe yaml.load()", "HIGH", "CWE-502", "high",
             PY + JS, ("yaml.",),
             r"yaml\.(?:load|full_load)\s*\(",
             negate=r"SafeLoader|safe_load|Loader\s*=\s*Safe"),
    LineRule("SEC026", "Weak hash (MD5/SHA1)", "MEDIUM", "CWE-327", "medium",
             PY + JS, ("hashlib.", "crypto.createhash"),
             r"hashlib\.(?:md5|sha1)\s*\(|crypto\.createHash\(\s*['\"](?:md5|sha1)",
             negate=r"usedforsecurity\s*=\s*False"),
    LineRule("SEC027", "TLS certificate verification disabled", "HIGH", "CWE-295", "high",
             PY + JS, ("verify", "_create_unverified_context", "rejectunauthorized"),
             r"verify\s*=\s*False|_create_unverified_context|rejectUnauthorized\s*:\s*false"),
    LineRule("SEC028", "Debug mode enabled", "MEDIUM", "CWE-489", "medium",
             PY + YAML + CONFIG, ("debug",),
             r"debug\s*=\s*True|debug\s*:\s*true|(?:FLASK|DJANGO|NODE)_DEBUG\s*=\s*1|\bDEBUG\s*=\s*True"),
    LineRule("SEC029", "CORS wildcard origin", "HIGH", "CWE-942", "medium",
             PY + JS + YAML + (".cs", ".go", ".java", ".rb"), ("origin",),
             r"origins?\s*['\"]?\s*[:=]\s*['\"]\*|Access-Control-Allow-Origin['\"]?\s*[,:)]\s*['\"]?\*"),
    LineRule("SEC030", "SQL built by string interpolation", "HIGH", "CWE-89", "high",
             PY + JS, ("select", "insert", "update", "delete", "drop"),
             r"(?:f\"[^\"]*\{[^}]+\}[^\"]*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b"
             r"|f\"[^\"]*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b[^\"]*\{"
             r"|f'[^']*\{[^}]+\}[^']*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b"
             r"|f'[^']*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b[^']*\{"
             r"|['\"](?:SELECT|INSERT INTO|UPDATE|DELETE FROM|DROP TABLE)[^'\"]*['\"]\s*\+"
             r"|\+\s*['\"][^'\"]*(?:SELECT|INSERT INTO|UPDATE|DELETE FROM)\b)"),
    LineRule("SEC031", "DOM XSS sink (innerHTML)", "HIGH", "CWE-79", "high",
             WEB, (".innerhtml", "insertadjacenthtml"),
             r"\.innerHTML\s*=|insertAdjacentHTML\s*\("),
    LineRule("SEC032", "child_process code execution", "HIGH", "CWE-78", "high",
             JS, ("exec",),
             r"child_process.*\b(?:exec|execSync)\s*\(|\b(?:execSync|exec)\s*\(\s*[`'\"]"),
    LineRule("SEC033", "dangerouslySetInnerHTML without sanitization", "HIGH", "CWE-79", "high",
             JS, ("dangerouslysetinnerhtml",),
             r"dangerouslySetInnerHTML"),
    LineRule("SEC034", "Remote script piped to shell", "HIGH", "CWE-494", "high",
             SHELL + MARKDOWN + YAML + DOCKER, ("curl", "wget"),
             r"(?:curl|wget)[^\n|]{0,200}\|\s*(?:sudo\s+)?(?:ba|z|da)?sh\b",
             negate=r"^\s*#"),
    LineRule("SEC035", "XXE-prone XML parsing", "MEDIUM", "CWE-611", "medium",
             PY, (".fromstring", ".parse", "expat."),
             r"(?:xml\.etree\.ElementTree|ET)\.(?:fromstring|parse)\s*\(|expat\.(?:ParserCreate|Parse)\s*\("),
    LineRule("SEC036", "Insecure temporary file (mktemp/tmpnam)", "LOW", "CWE-377", "high",
             PY + NATIVE, ("mktemp", "tmpnam", "tempnam"),
             r"tempfile\.mktemp\s*\(|(?<![\w.])(?:mktemp|tmpnam|tempnam)\s*\("),
    LineRule("SEC037", "Dynamic import of non-literal module", "MEDIUM", "CWE-470", "medium",
             PY, ("__import__", "import_module"),
             r"(?<![\w.])(__import__\s*\((?!\s*['\"])|importlib\.import_module\s*\((?!\s*['\"]))"),
    LineRule("SEC040", "World-writable / full-permission file mode", "MEDIUM", "CWE-732", "medium",
             SHELL + YAML + PY, ("777", "chmod", "icacls"),
             r"chmod\s+(?:-R\s+)?[0-7]{0,3}777(?![0-9])|chmod\s+a\+rwx|icacls\s+\S+\s+/grant\s+\S+:F\b|0o777\b"),
    LineRule("SEC042", "Workflow token permissions: write-all", "MEDIUM", "CWE-250", "high",
             YAML, ("write-all",),
             r"permissions\s*:\s*write-all"),
    LineRule("SEC043", "Open redirect (user input into redirect target)", "MEDIUM", "CWE-601", "medium",
             PY + JS, ("redirect",),
             r"redirect\s*\(\s*request\.(?:args|form|GET|POST)"
             r"|res\.redirect\s*\(\s*(?:req\.(?:query|params|body)|request\.query)"),
    LineRule("SEC044", "Server-side template from dynamic string (SSTI)", "MEDIUM", "CWE-1336", "medium",
             PY, ("render_template_string", "from_string"),
             r"render_template_string\s*\(|from_string\s*\([^)]*(?:\+|request|input|params)"),
    LineRule("SEC045", "Unsafe archive extraction (extractall)", "MEDIUM", "CWE-22", "medium",
             PY, (".extractall",),
             r"\.extractall\s*\(",
             negate=r"\bfilter\s*="),
    LineRule("SEC046", "HTTP call without a timeout", "LOW", "CWE-400", "low",
             PY, ("requests.", "httpx."),
             r"(?<![\w.])(?:requests|httpx)\.(?:get|post|put|delete|head|patch|request)\s*\((?!.*\btimeout\s*=)"),
    LineRule("SEC047", "TLS verification disabled in download (-k / --insecure)", "MEDIUM", "CWE-295", "medium",
             SHELL + YAML + MARKDOWN + DOCKER, ("curl", "wget"),
             r"(?:curl|wget)\s[^|\n]*?(?:-k|--insecure)\b"),
    LineRule("SEC048", "Security check implemented with assert", "HIGH", "CWE-617", "medium",
             PY, ("assert",),
             r"(?<![\w.])assert\s+[^\n#]*(?:is_admin|is_authenticated|is_superuser|has_perm|check_password"
             r"|verify_token|is_authorized|csrf|is_valid_user|logged_in)"),
    LineRule("SEC049", "Deprecated crypto.createCipher / createDecipher", "MEDIUM", "CWE-327", "high",
             JS, ("crypto.create",),
             r"crypto\.create(?:Decipher|Cipher)(?:Sync)?\s*\("),
    LineRule("SEC056", "DOM XSS sink (document.write)", "MEDIUM", "CWE-79", "medium",
             WEB, ("document.write",),
             r"document\.write(?:ln)?\s*\("),
    LineRule("SEC057", "jwt.decode without an explicit algorithms allowlist", "HIGH", "CWE-347", "medium",
             PY + JS, ("jwt.decode", "jsonwebtoken.decode"),
             r"(?<![\w.])(?:jwt|jsonwebtoken)\.decode\s*\((?![^)]{0,400}\balgorithms\s*=)"),
    LineRule("SEC058", "SQL built with fmt.Sprintf (Go)", "HIGH", "CWE-89", "medium",
             GO, ("fmt.sprintf", "db.query", "db.exec"),
             r"fmt\.Sprintf\s*\(\s*[\"`][^\"`]*\b(?:SELECT|INSERT INTO|UPDATE|DELETE FROM|DROP TABLE)\b"
             r"|db\.(?:Query|Exec|QueryRow)\w*\s*\(\s*(?:fmt\.Sprintf|[^\n]*?\+\s*\w)"),
    LineRule("SEC059", "TLS InsecureSkipVerify enabled (Go)", "HIGH", "CWE-295", "high",
             GO, ("insecureskipverify",),
             r"InsecureSkipVerify\s*:\s*true"),
    LineRule("SEC063", "Shell invocation via sh/bash -c (Go/Java/Ruby)", "HIGH", "CWE-78", "high",
             GO + JAVA + RB, ("exec", "system"),
             r"exec\.Command\s*\(\s*\"(?:sh|bash|zsh|cmd|powershell)\"\s*,\s*\"-c\""
             r"|Runtime\.getRuntime\s*\(\s*\)\s*\.exec\s*\(\s*new\s+String\[\]\s*\{\s*\"(?:sh|bash|zsh|cmd|powershell)\"\s*,\s*\"-c\""
             r"|(?<![\w.])(?:system|exec)\s*\(\s*\"(?:sh|bash|zsh|cmd|powershell)\"\s*,\s*\"-c\""),
    LineRule("SEC064", "Runtime.exec / ProcessBuilder shell execution (Java)", "HIGH", "CWE-78", "medium",
             JAVA, ("runtime.getruntime", "processbuilder"),
             r"Runtime\.getRuntime\s*\(\s*\)\s*\.exec\s*\(|new\s+ProcessBuilder\s*\("),
    LineRule("SEC065", "Weak message digest (MD5 / SHA-1) in Java", "MEDIUM", "CWE-327", "medium",
             JAVA, ("messagedigest.getinstance",),
             r"MessageDigest\.getInstance\s*\(\s*\"(?:MD5|SHA-1)\"[^)]*\)"),
    LineRule("SEC066", "Weak cipher algorithm (DES / RC4 / Blowfish) in Java", "HIGH", "CWE-327", "high",
             JAVA, ("cipher.getinstance",),
             r"Cipher\.getInstance\s*\(\s*\"(?:DES|DESede|RC4|RC2|Blowfish|PBEWithMD5And)"),
    LineRule("SEC067", "Java native deserialization (ObjectInputStream)", "HIGH", "CWE-502", "medium",
             JAVA, ("objectinputstream", ".readobject"),
             r"(?<![\w.])new\s+ObjectInputStream\s*\(|\.readObject\s*\("),
    LineRule("SEC068", "Unsafe YAML.load (Ruby Psych)", "HIGH", "CWE-502", "high",
             RB, ("yaml.load",),
             r"(?<![\w.])YAML\.load\s*\(",
             negate=r"safe_load"),
    LineRule("SEC069", "Shell command with interpolation (Ruby)", "HIGH", "CWE-78", "medium",
             RB, ("#{",),
             r"(?<![\w.])(?:system|exec)\s*(?:\([^\n]*?#\{|\s+[\"'][^\n]*?#\{)"
             r"|(?<![\w.])(?:Open3\.(?:capture2?|popen)|IO\.popen)\s*(?:\([^\n]*?#\{|\s+[\"'][^\n]*?#\{)"
             r"|`[^`\n]*#\{"),
    LineRule("SEC071", "Dockerfile base image pinned to :latest", "MEDIUM", "CWE-829", "high",
             DOCKER, (":latest",),
             r"^\s*FROM\s+\S+:latest\b"),
    LineRule("SEC072", "Secret baked into Dockerfile ENV/ARG", "HIGH", "CWE-798", "medium",
             DOCKER, ("env", "arg"),
             r"^\s*(?:ENV|ARG)\s+(?:(?:[A-Za-z0-9]+_)+(?:KEY|TOKEN|SECRET|PASSW(?:OR)?D|PWD|CREDENTIALS?)"
             r"|(?:KEY|TOKEN|SECRET|PASSW(?:OR)?D|CREDENTIALS?)(?:_[A-Za-z0-9]+)*)\s*="),
    LineRule("SEC073", "Container escape vector (privileged / docker.sock mount)", "HIGH", "CWE-250", "medium",
             YAML + DOCKER, ("privileged", "docker.sock"),
             r"privileged\s*:\s*true|docker\.sock"),
    LineRule("SEC075", "Dockerfile ADD from remote URL", "MEDIUM", "CWE-494", "high",
             DOCKER, ("http",),
             r"^\s*ADD\s+https?://"),
    LineRule("SEC076", "Container explicitly running as root", "MEDIUM", "CWE-250", "high",
             DOCKER, ("root",),
             r"^\s*USER\s+root\b"),
    LineRule("SEC077", "Unsafe unserialize() (PHP)", "HIGH", "CWE-502", "medium",
             PHP, ("unserialize",),
             r"(?<![\w.])unserialize\s*\("),
    LineRule("SEC078", "Shell command execution (PHP)", "HIGH", "CWE-78", "medium",
             PHP, ("system", "exec", "passthru", "popen", "proc_open"),
             r"(?<!->)(?<![\w.])(?:system|exec|passthru|shell_exec|popen|proc_open)\s*\("),
    LineRule("SEC079", "Deprecated mysql_query() API (PHP)", "HIGH", "CWE-89", "high",
             PHP, ("mysql_query",),
             r"(?<![\w.])mysql_query\s*\("),
    LineRule("SEC080", "preg_replace() with /e code-execution modifier (PHP)", "HIGH", "CWE-94", "high",
             PHP, ("preg_replace",),
             r"preg_replace\s*\(\s*[\"'][^\"'\n]*/[^\"'\n]*/[a-zA-Z]*e[a-zA-Z]*['\"]"),
    LineRule("SEC081", "extract() on request superglobals (PHP)", "MEDIUM", "CWE-915", "medium",
             PHP, ("extract",),
             r"(?<![\w.])extract\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)\b"),
    LineRule("SEC082", "Weak password hash md5()/sha1() (PHP)", "MEDIUM", "CWE-916", "medium",
             PHP, ("md5", "sha1"),
             r"(?<![\w.$])(?:md5|sha1)\s*\("),
    LineRule("SEC083", "SQL built by string concatenation (C#)", "HIGH", "CWE-89", "medium",
             CS, ("command", "execute"),
             r"(?:SqlCommand|OleDbCommand|MySqlCommand|SqliteCommand)\s*\([^)]*\+"
             r"|(?:ExecuteReader|ExecuteNonQuery|ExecuteScalar)\s*\(\s*[^\n;]*\+"),
    LineRule("SEC084", "Shell launched via Process.Start (C#)", "HIGH", "CWE-78", "high",
             CS, ("process.start", "filename"),
             r"Process\.Start\s*\(\s*(?:@?\"(?:cmd|powershell|bash)|\"cmd\.exe\"|\"powershell\.exe\")"
             r"|FileName\s*=\s*\"(?:cmd\.exe|powershell\.exe|bash)\""),
    LineRule("SEC085", "Weak crypto algorithm (C#)", "HIGH", "CWE-327", "high",
             CS, ("cryptoserviceprovider",),
             r"(?:DESCryptoServiceProvider|RC2CryptoServiceProvider|new\s+MD5CryptoServiceProvider"
             r"|SHA1CryptoServiceProvider)"),
    LineRule("SEC086", "BinaryFormatter / SoapFormatter deserialization (C#)", "HIGH", "CWE-502", "medium",
             CS, ("formatter", "netdatacontractserializer"),
             r"(?:BinaryFormatter|SoapFormatter|NetDataContractSerializer)\b"),
    LineRule("SEC087", "gets() banned function (C/C++)", "HIGH", "CWE-242", "high",
             NATIVE, ("gets",),
             r"(?<![\w.])gets\s*\("),
    LineRule("SEC088", "Unbounded string copy strcpy/strcat (C/C++)", "HIGH", "CWE-120", "high",
             NATIVE, ("strcpy", "strcat"),
             r"(?<![\w.])str(?:cpy|cat)\s*\("),
    LineRule("SEC089", "sprintf() without bounds (C/C++)", "HIGH", "CWE-120", "high",
             NATIVE, ("sprintf",),
             r"(?<![\w.])(?:sprintf|vsprintf)\s*\("),
    LineRule("SEC090", "Shell via system()/popen() (C/C++)", "HIGH", "CWE-78", "medium",
             NATIVE, ("system", "popen"),
             r"(?<![\w.])(?:system|popen)\s*\("),
    LineRule("SEC091", "printf with non-literal format string (C/C++)", "HIGH", "CWE-134", "medium",
             NATIVE, ("printf",),
             r"(?<![\w.])(?:v?printf)\s*\(\s*[A-Za-z_]\w*\s*[,)]"),
)

# Rules over a whole file (all patterns must occur; "m" = ^ and $ per line).
FILE_RULES = (
    FileRule("SEC038", "pull_request_target with checkout (PR-head code execution)", "CRITICAL", "CWE-829", "high",
             YAML, ("pull_request_target",),
             (r"(?imUd)^\s*pull_request_target\s*:", r"(?iUd)uses:\s*\S*actions/checkout"),
             "Workflow combines pull_request_target + actions/checkout — a malicious PR can run code with secrets."),
    FileRule("SEC039", "GitHub Action not pinned to a commit SHA", "MEDIUM", "CWE-829", "medium",
             YAML, ("uses:",),
             (r"(?imUd)uses:\s*(?!actions/|github/)[\w.\-]+/[\w.\-]+@[^\s`]*?(?<!\b[0-9a-f]{40})\s*$",),
             "Action referenced by tag/branch — a compromised upstream can silently change the code you run."),
)

# Rules found by state, repository metadata or external reports.
STATE_RULES = (
    ("SEC041", "Script injection via untrusted context in run:", "HIGH", "CWE-94"),
    ("SEC070", "Dockerfile base image without a pinned tag", "MEDIUM", "CWE-829"),
)
STATIC_RULES = (
    ("SEC050", "Secret-looking file tracked in git (tracked .env/credentials)", "CRITICAL"),
    ("SEC051", "Private key / keystore tracked in git", "CRITICAL"),
    ("SEC052", "Remote URL embeds credentials", "CRITICAL"),
    ("SEC053", ".gitignore does not cover .env files", "LOW"),
    ("SEC054", "Oversized file tracked in git", "MEDIUM"),
    ("SEC055", "Secret present in git history", "CRITICAL"),
    ("SEC060", "Unpinned dependency", "LOW"),
    ("SEC061", "Known vulnerable dependency (pip-audit)", "HIGH"),
    ("SEC062", "Known vulnerable dependency (npm audit)", "HIGH"),
    ("SEC074", "Dockerfile without .dockerignore", "LOW"),
)
# Fixed value: the message takes part in fingerprints.
SEC041_MESSAGE = ("Untrusted GitHub context interpolated into a shell run step — "
                  "a malicious PR/issue title becomes arbitrary code.")

# Advice shown with a finding.
ADVICE = {
    "code-execution": "Do not run text as code; parse the input or dispatch over known names.",
    "shell": "Start the program directly with an argument list and check the arguments.",
    "deserialize": "Read untrusted bytes only in a data format with a schema, such as JSON.",
    "yaml": "Load YAML through the safe loader.",
    "hash": "Use SHA-256 or stronger, or mark a checksum as not security relevant.",
    "password-hash": "Store passwords with a password hash such as bcrypt or argon2.",
    "tls": "Keep certificate checks on and add the missing authority to the trust store.",
    "debug": "Turn debug mode off outside development.",
    "cors": "List the origins that may call instead of '*'.",
    "sql": "Bind values as query parameters.",
    "xss": "Write text nodes, or sanitize the markup first.",
    "pipe": "Download, verify a checksum, then run.",
    "xml": "Parse with external entities switched off.",
    "tempfile": "Create the file atomically (mkstemp or NamedTemporaryFile).",
    "import": "Import only from a fixed list of module names.",
    "mode": "Grant the least permission that works, for example 750 or 640.",
    "permissions": "Declare the least permissions per job.",
    "redirect": "Redirect only to listed targets.",
    "template": "Render named template files, never request text.",
    "archive": "Filter the members before extracting.",
    "timeout": "Pass a timeout.",
    "assert": "Raise explicitly; asserts vanish under -O.",
    "cipher": "Use AES-GCM with a random nonce (createCipheriv in Node).",
    "jwt": "Pass the exact list of accepted algorithms.",
    "native-bounds": "Use the bounded variant (fgets, strlcpy, snprintf) or std::string.",
    "format": "Use a literal format string.",
    "superglobals": "Read the request keys you need one by one.",
    "pin-image": "Pin a version tag or a digest.",
    "bake": "Pass secrets at run time.",
    "privileged": "Run unprivileged and keep the daemon socket out of containers.",
    "remote-add": "Fetch and verify first, then COPY.",
    "root": "Switch to a dedicated user.",
    "workflow": "Keep untrusted pull requests away from jobs that hold secrets.",
    "pin-action": "Pin the action to a full commit id.",
    "script-injection": "Hand the value over in an environment variable and quote it.",
    "secret": "Revoke the value, then load it from a secret store.",
    "untrack": "Untrack the file, ignore it, purge it from history and rotate what it held.",
    "remote": "Use SSH or a credential helper and rotate the password.",
    "gitignore": "Add '.env*' to .gitignore.",
    "large-file": "Keep large artifacts in object storage.",
    "history": "Rotate the credential, then purge it from history.",
    "pin": "Pin a tested version.",
    "upgrade": "Upgrade to a patched release.",
    "dockerignore": "Add a .dockerignore that covers .git, .env* and caches.",
}
ADVICE_OF = {
    "code-execution": ("SEC020", "SEC021", "SEC080"),
    "shell": ("SEC022", "SEC023", "SEC032", "SEC063", "SEC064", "SEC069", "SEC078", "SEC084", "SEC090"),
    "deserialize": ("SEC024", "SEC067", "SEC077", "SEC086"),
    "yaml": ("SEC025", "SEC068"),
    "hash": ("SEC026", "SEC065"),
    "password-hash": ("SEC082",),
    "tls": ("SEC027", "SEC047", "SEC059"),
    "debug": ("SEC028",),
    "cors": ("SEC029",),
    "sql": ("SEC030", "SEC058", "SEC079", "SEC083"),
    "xss": ("SEC031", "SEC033", "SEC056"),
    "pipe": ("SEC034",),
    "xml": ("SEC035",),
    "tempfile": ("SEC036",),
    "import": ("SEC037",),
    "workflow": ("SEC038",),
    "pin-action": ("SEC039",),
    "mode": ("SEC040",),
    "script-injection": ("SEC041",),
    "permissions": ("SEC042",),
    "redirect": ("SEC043",),
    "template": ("SEC044",),
    "archive": ("SEC045",),
    "timeout": ("SEC046",),
    "assert": ("SEC048",),
    "cipher": ("SEC049", "SEC066", "SEC085"),
    "jwt": ("SEC057",),
    "pin-image": ("SEC070", "SEC071"),
    "bake": ("SEC072",),
    "privileged": ("SEC073",),
    "remote-add": ("SEC075",),
    "root": ("SEC076",),
    "superglobals": ("SEC081",),
    "native-bounds": ("SEC087", "SEC088", "SEC089"),
    "format": ("SEC091",),
    "untrack": ("SEC050", "SEC051"),
    "remote": ("SEC052",),
    "gitignore": ("SEC053",),
    "large-file": ("SEC054",),
    "history": ("SEC055",),
    "pin": ("SEC060",),
    "upgrade": ("SEC061", "SEC062"),
    "dockerignore": ("SEC074",),
}
_ADVICE_BY_RULE = {rule: ADVICE[topic] for topic, rules in ADVICE_OF.items() for rule in rules}

CATALOG_SCHEMA = (
    "rule_id string, title string, sev int, severity string, cwe string, confidence string, "
    "fix string, kind string, applies string, pattern string, message string, scan_seq int")


def advice(rule_id: str) -> str:
    return _ADVICE_BY_RULE.get(rule_id, ADVICE["secret"])


def _entries(custom_rules=()) -> list[tuple]:
    # Imported here: the secret rules build on the language sets above.
    from auditlake.operators.secrets import SECRET_RULES

    def entry(rule_id, title, severity, cwe="", confidence="high", kind="", langs=None,
              pattern=None, message="", fix=None):
        return [rule_id, title, severity_level(severity), severity, cwe, confidence,
                advice(rule_id) if fix is None else fix, kind,
                None if langs is None else "  ".join(sorted(set(langs))), pattern, message]

    rows = [entry(r.rule_id, r.title, r.severity, r.cwe, kind="secret", pattern=r.pattern)
            for r in SECRET_RULES]
    rows += [entry(r.rule_id, r.title, r.severity, r.cwe, r.confidence, "code", r.langs, r.pattern)
             for r in LINE_RULES]
    rows += [entry(r.rule_id, r.title, r.severity, r.cwe, r.confidence, "file", r.langs,
                   " && ".join(r.patterns), r.message) for r in FILE_RULES]
    rows += [entry(rule_id, title, severity, cwe, kind="code",
                   message=SEC041_MESSAGE if rule_id == "SEC041" else "")
             for rule_id, title, severity, cwe in STATE_RULES]
    rows += [entry(rule_id, title, severity, kind="static") for rule_id, title, severity in STATIC_RULES]
    rows += [entry(r.id, r.title, r.severity, r.cwe, r.confidence, "custom", r.extensions,
                   r.pattern, r.message, r.fix) for r in custom_rules]
    return [tuple(row) + (position,) for position, row in enumerate(rows)]


def catalog(spark: SparkSession, custom_rules=()) -> DataFrame:
    """Every rule with its metadata; ``scan_seq`` is the order in which rules report."""
    return spark.createDataFrame(_entries(custom_rules), CATALOG_SCHEMA)


def builtin_size() -> int:
    """Number of built-in rules; custom ones report after them."""
    return len(_entries())


def list_rules(spark: SparkSession, custom_rules=()) -> DataFrame:
    return (catalog(spark, custom_rules).select("rule_id", "severity", "title")
            .orderBy("rule_id", "title"))


def explain_rule(spark: SparkSession, rule_id: str, custom_rules=()) -> DataFrame:
    """The one catalog row for ``rule_id`` in any case; an unknown id raises."""
    wanted = rule_id.strip().lower()
    known = {row[0].lower() for row in _entries(custom_rules)}
    if wanted not in known:
        raise ValueError(f"unknown rule {rule_id!r}")
    return (catalog(spark, custom_rules).where(F.lower("rule_id") == wanted)
            .select("rule_id", "title", "severity", "cwe", "confidence", "kind", "applies",
                    "pattern", "fix"))


assert set(r.severity for r in LINE_RULES) <= set(SEVERITIES)
