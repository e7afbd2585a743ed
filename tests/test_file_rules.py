"""Per-file rules: one line in, rule ids out; folding; state; masking; inline markers."""

import random

import pytest

from auditlake.operators.catalog import LINE_RULES
from auditlake.operators.file_scan import scan_files
from auditlake.operators.lines import folder
from auditlake.options import CustomRule, ScanOptions
from auditlake.plans.samples import SAMPLES

CASES = [
    # (rule, file name, firing lines, near misses)
    ("SEC020", "a.py", ["eval(x)", "y = eval (z)", "(eval(x))"], ["model.eval()", "medieval(x)", "évaleval(x)"]),
    ("SEC021", "a.js", ["exec(a)", "new Function('x')"], ["re.exec(a)", "new FunctionList()"]),
    ("SEC022", "a.yml", ["shell: true"], ["shell: bash"]),
    ("SEC025", "a.py", ["yaml.load(f)"], ["yaml.load(f, Loader=SafeLoader)", "yaml.safe_load(f)"]),
    ("SEC028", "a.toml", ["debug = true"], ["debugger = true"]),
    ("SEC028", ".envrc", ["DEBUG=True"], ["DEBUG=False"]),
    ("SEC029", "a.py", ["CORS(origins='*')", "h['Access-Control-Allow-Origin'] = 1 # Access-Control-Allow-Origin: *"],
     ["resources={'/api/*': 1}"]),
    ("SEC030", "a.py", ["q = f\"SELECT a FROM {t}\"", "q = 'DELETE FROM x' + y"], ["q = 'SELECT 1'", "drop(x)"]),
    ("SEC034", "a.sh", ["curl https://x | sh", "wget -qO- x | sudo bash"], ["# curl https://x | sh", "curl x | jq ."]),
    ("SEC037", "a.py", ["__import__(n)", "importlib.import_module(n)"], ["__import__( 'os')", "importlib.import_module(\"os\")"]),
    ("SEC040", "a.sh", ["chmod 0777 x", "chmod -R 777 x", "chmod a+rwx x"], ["chmod 7770 x", "chmod 755 x"]),
    ("SEC046", "a.py", ["requests.get(u)"], ["requests.get(u, timeout=1)", "my.requests.get(u)"]),
    ("SEC057", "a.py", ["jwt.decode(t, k)"], ["jwt.decode(t, k, algorithms=['HS256'])"]),
    ("SEC058", "a.go", ["db.Query(\"SELECT a\" + x)"], ["db.Query(q, x)"]),
    ("SEC068", "a.rb", ["YAML.load(x)"], ["YAML.safe_load(x)", "MyYAML.load(x)"]),
    ("SEC069", "a.rb", ["system(\"ls #{x}\")", "`ls #{x}`"], ["system('ls', x)"]),
    ("SEC071", "Dockerfile", ["FROM a:latest"], ["FROM a:1", "# FROM a:latest"]),
    ("SEC072", "dockerfile.dev", ["ENV API_KEY=abc", "ARG TOKEN=x"], ["ENV KEYBOARD_LAYOUT=us", "ENV PWD=/x", "ENV TOKENIZER_FILE=a"]),
    ("SEC078", "a.php", ["exec($c)", "shell_exec($c)"], ["$pdo->exec($c)"]),
    ("SEC080", "a.php", ["preg_replace('/a/e', $b)"], ["preg_replace('/abcde', $b)"]),
    ("SEC082", "a.php", ["md5($p)"], ["$md5($p)", "my_md5($p)"]),
    ("SEC089", "a.c", ["sprintf(b, f)"], ["snprintf(b, 1, f)"]),
    ("SEC091", "a.cpp", ["printf(fmt)", "printf(fmt, a)"], ["printf(\"%s\", a)"]),
]


def test_line_rule_cases(hits):
    pairs, wanted = [], {}
    for n, (rule, name, firing, clean) in enumerate(CASES):
        for m, (line, fires) in enumerate([(x, True) for x in firing] + [(x, False) for x in clean]):
            path = f"c{n}/{m}/{name}"
            pairs.append((path, line))
            wanted[path] = (rule, fires, line)
    found = hits(*pairs)
    wrong = [(rule, line, fires) for path, (rule, fires, line) in wanted.items()
             if ((rule, 1) in found[path]) != fires]
    assert wrong == []


def test_samples_reach_every_rule(hits):
    found = hits(*[(f"{i}/{name}", text) for i, (name, text) in enumerate(SAMPLES)])
    seen = {rule for rules in found.values() for rule, _ in rules}
    static = {f"SEC0{n}" for n in (50, 51, 52, 53, 54, 55, 60, 61, 62, 74)}
    every = {f"SEC0{n:02d}" for n in range(1, 92)} - static
    assert every - seen == set()


def test_anchors_are_necessary_conditions():
    import re
    for rule in LINE_RULES:
        for name, text in SAMPLES:
            for line in text.split("\n"):
                if re.search(rule.pattern, line, re.IGNORECASE):
                    assert any(a in line.lower() for a in rule.anchors), (rule.rule_id, line)


def test_unicode_edges(hits):
    found = hits(("nbsp.py", "eval\u00a0(x)"), ("accent.py", "éeval(x)"), ("longs.py", "a\u017f\u017fert user.i\u017f_admin"),
                 ("breaks.py", "a\x0bb\x0ceval(1)\u2028eval(2)\r\neval(3)\x85eval(4)"))
    assert ("SEC020", 1) in found["nbsp.py"]
    assert found["accent.py"] == set()
    assert ("SEC048", 1) in found["longs.py"]
    assert {line for rule, line in found["breaks.py"] if rule == "SEC020"} == {3, 4, 5, 6}


def test_fold_cases():
    fold = folder()
    assert fold(["x = f(", "    a,", "    b)"]) == [(1, "x = f( a, b)")]
    assert fold(["a = 1", "b = 2"]) == [(1, "a = 1"), (2, "b = 2")]
    assert fold(["", "  ", "f(", "", ")"]) == [(1, ""), (2, ""), (3, "f(  )")]
    assert fold(["f(", "x"]) == [(1, "f( x")]
    assert [(n, len(t)) for n, t in fold(["x" * 180_000, "y"])] == [(1, 180_000), (2, 1)]
    assert [(n, len(t)) for n, t in fold(["f("] + ["x" * 6000] * 4)] == [(1, 12_004), (4, 6000), (5, 6000)]


def test_fold_decides_rules(hits):
    found = hits(
        ("a.py", "h = hashlib.md5(\n  x,\n  usedforsecurity=False)\n"), ("b.js", "crypto.createHash(\n'md5')"),
        ("c.py", "f(" + "\n" * 3 + "eval(x))"), ("d.py", "x" * 150_000 + " eval(y)"))
    assert found["a.py"] == set()
    assert found["b.js"] == {("SEC026", 1)}
    assert found["c.py"] == {("SEC020", 1)}
    assert found["d.py"] == {("SEC020", 1)}


def test_lock_files_only_get_secrets(hits):
    found = hits(("x.lock", "eval(x)\nk = \"AKIA" + "Z" * 16 + "\""))
    assert found["x.lock"] == {("SEC001", 2)}


def test_masked_assignment(files):
    text = "ENV API_KEY='abcdefghijklmnopqrstuvwxyz'\nenv MY_TOKEN=abcdefghijklmnopqrst\nENV A_SECRET="
    rows = scan_files(files(("Dockerfile", text))).where("rule_id = 'SEC072'").orderBy("line").collect()
    assert [r.evidence for r in rows] == ["ENV API_KEY='abcdef…wxyz'", "env MY…qrst", "ENV A_SECRET="]
    assert all("ghijklmnop" not in r.message for r in rows)


def test_workflow_rules(hits):
    text = ("on:\n  pull_request_target:\njobs:\n  a:\n    steps:\n"
            "      - run: |\n          echo ${{ github.event.x }}\n\n          # ${{ github.head_ref }}\n"
            "        env: ${{ github.head_ref }}\n      - run: echo ${{ github.head_ref }}\n"
            "      - name: run: ${{ github.head_ref }}\n      - uses: actions/checkout@v4\n      - uses: a/b@v1\n")
    # the env line is indented deeper than its step, so it still belongs to the block
    assert hits(("w.yml", text))["w.yml"] == {("SEC038", 0), ("SEC039", 0), ("SEC041", 7), ("SEC041", 10), ("SEC041", 11)}
    pinned = "steps:\n  - uses: a/b@" + "0123456789" * 4 + "\n  - uses: actions/x@v1\n"
    assert hits(("p.yml", pinned))["p.yml"] == set()


def _injection_lines(lines):
    """Line by line, with explicit state: the brute-force reading of the rule."""
    import re
    untrusted = re.compile(r"\$\{\{\s*(github\.event\.[\w.]+|github\.head_ref)\b")
    found, block = [], None
    for number, line in enumerate(lines, 1):
        body = line.strip()
        if body[:1] == "#":
            continue
        margin = len(line) - len(line.lstrip())
        if block is not None and body and margin <= block:
            block = None
        if block is not None and untrusted.search(line):
            found.append(number)
        elif re.match(r"\s*-?\s*run\s*:\s*[|>][-+]?\s*$", line):
            block = margin
        elif re.match(r"\s*-?\s*run\s*:", line) and untrusted.search(line):
            found.append(number)
    return found


def test_script_injection_against_brute_force(hits):
    rng = random.Random(7)
    parts = ["run: |", "- run: >-", "run: echo ${{ github.head_ref }}", "echo ${{ github.event.a }}", "# ${{ github.head_ref }}",
             "", "env: 1", "name: x", "- run: |"]
    texts = [[" " * rng.choice([0, 2, 4, 6]) + rng.choice(parts) for _ in range(rng.randint(1, 14))] for _ in range(400)]
    found = hits(*[(f"{i}.yml", "\n".join(t)) for i, t in enumerate(texts)])
    for i, lines in enumerate(texts):
        assert {n for r, n in found[f"{i}.yml"] if r == "SEC041"} == set(_injection_lines(lines)), lines


def test_untagged_images(hits):
    text = ("FROM golang:1.22 AS Build\nFROM build\nFROM ubuntu AS base\nFROM scratch\nFROM ${IMG}\nFROM a@sha256:1\n"
            "FROM host:5000/x\nFROM foo AS foo\nFROM later\nFROM z:1 AS later\nfrom --platform=linux/amd64 alpine")
    assert {n for r, n in hits(("Dockerfile", text))["Dockerfile"] if r == "SEC070"} == {3, 7, 9, 11}


def test_custom_rules(hits, files):
    rules = [CustomRule("C1", "Corp", "LOW", "corp_[a-z]+", extensions=(".py",)), CustomRule("C2", "All", "HIGH", "^x$", message="fixed")]
    options = ScanOptions(custom_rules=rules)
    found = hits(("a.py", "corp_abc\nCORP_ABC\nx"), ("b.js", "corp_abc\nx"), options=options)
    assert found == {"a.py": {("C1", 1), ("C2", 3)}, "b.js": {("C2", 2)}}
    row = scan_files(files(("a.py", "  corp_abc  ")), options).first()
    assert (row.message, row.evidence, row.scanner, row.severity) == ("Corp: corp_abc", "corp_abc", "custom", "LOW")


@pytest.mark.parametrize("text, left", [
    ("eval(a) # audit-ignore SEC020", set()), ("eval(a) # audit-ignore SEC021", {1}), ("eval(a) # audit-ignore", set()),
    ("eval(a) // AUDIT-IGNORE sec020, SEC030", set()), ("eval('audit-ignore')", {1}), ("eval(a) # audit-ignore SEC020X", {1}),
    ("eval(a) # audit-ignore because we can", {1}), ("# audit-ignore-next-line\neval(a)\neval(b)", {3}),
    ("eval(a) # audit-ignore *", set()), ("eval(\na) # audit-ignore", {1}), ("eval(a) -- audit-ignore", {1}),
])
def test_inline_markers(hits, text, left):
    assert {n for r, n in hits(("a.py", text))["a.py"] if r == "SEC020"} == left


def test_inline_markers_can_be_off_or_renamed(hits):
    text = "eval(a) # audit-ignore\neval(b) # my-ignore"
    lines = lambda options: {n for _, n in hits(("a.py", text), options=options)["a.py"]}
    assert lines(ScanOptions(inline_suppressions=False)) == {1, 2}
    assert lines(ScanOptions(ignore_marker="my-ignore")) == {1}
