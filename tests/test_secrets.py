import math
import random
from collections import Counter

from pyspark.sql import functions as F

from auditlake.functions.masking import entropy, redact
from auditlake.operators.file_scan import scan_files
from auditlake.options import ScanOptions

HIGH = "Ab3xK9mQz7Wp2Ld5" + "Rt8Yv4Nb6Hc1Jf0Gg5Ss2"
CASES = [
    ('ACCESS = "AKIA' + "Z" * 16 + '"', {"SEC001"}), ('T="sk-live-' + "a" * 35 + '"', {"SEC004"}),
    ('password = "abcdefgh' + 'ijklmnop"', {"SEC014"}), ('password = "hunter2' + 'secret99"', {"SEC014"}),
    ('password = "testsecret' + '948572"', {"SEC014"}), ('password = "qrstuvwxyz' + 'abcd"', {"SEC014"}),
    ('password = "aaaaaaaaaaaa"', set()), ("password = get_password()", set()), ('password = "<literal-here>"', set()),
    ('DB_PASSWORD: str = "hunter2' + 'secret99"', set()), ('DB_PASSWORD = "hunter2' + 'secret99"', {"SEC014"}),
    (f'aws_secret_access_key = "{"A" * 40}"', {"SEC016"}), (f'aws_secret_access_key = "{"A" * 39}"', set()),
    ('u = "https://api.example.com/v1?api_key=abcdefgh' + 'ijklmnop"', {"SEC017"}), ('u = "https://api.example.com/v1/items"', set()),
    (f'h = {{"Authorization": "Bearer {HIGH}"}}', {"SEC018"}), ('h = {"Authorization": "Bearer ' + "ab3" * 10 + '"}', set()),
    ('SECRET_KEY = "supersecret' + 'value99"', {"SEC019"}), ('JWT_SECRET = "anothersecret' + 'value"', {"SEC019"}),
    ('SECRET_KEY = "changeme"', set()), ('u = "https://bob:hunt' + 'er2x@example.com"', {"SEC013"}),
    ('token = "' + "24be64439e3e49cf46b2" + 'd7c90f3602a3d0b907ff"', {"SEC015"}),
]


def test_secret_cases(hits):
    found = hits(*[(f"{i}.py", text) for i, (text, _) in enumerate(CASES)])
    wrong = [(text, rules, found[f"{i}.py"]) for i, (text, rules) in enumerate(CASES)
             if {r for r, _ in found[f"{i}.py"]} != rules]
    assert wrong == []


def test_unquoted_values_in_configuration_files_only(hits):
    text = "DB_PASSWORD=Tr0ub4dor" + "3xyz\n"
    found = hits((".env.prod", text), ("a.py", text))
    assert found == {".env.prod": {("SEC014", 1)}, "a.py": set()}


def test_nothing_raw_leaves(files):
    value = "kR8mZq2vXw" + "9TfLp0BnY3"
    rows = scan_files(files(("a.py", f'password = "{value}"'), (".env", f"API_KEY={value}"))).collect()
    assert len(rows) == 2
    assert all(value not in str(row.asDict()) and "…" in row.evidence for row in rows)


def test_allow_list(hits):
    text = 'password = "hunter2' + 'secret99"\napi_key = "kR8mZq2vXw' + '9TfLp0BnY3"'
    rules = lambda allow: hits(("a.py", text), options=ScanOptions(allow_secrets=allow))["a.py"]
    assert rules(["HUNTER2secret99"]) == {("SEC014", 2)}
    assert rules(["hunter2", "kr8m"]) == set()
    assert rules([""]) == {("SEC014", 1), ("SEC014", 2)}


def test_whole_long_lines_are_searched(hits):
    text = "x" * 300_000 + ' password = "hunter2' + 'secret99"'
    assert hits(("a.py", text))["a.py"] == {("SEC014", 1)}


def test_redaction_and_entropy(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("abcXYZ019é_") for _ in range(n)) for n in range(1, 40)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(
        "v", redact(F.col("v")).alias("r"), entropy("v").alias("h")).collect()
    for row in rows:
        n, shown = len(row.v), len(row.r) - 1
        assert shown <= 10 and shown <= 0.6 * n
        if n >= 17:
            assert row.r == row.v[:6] + "…" + row.v[-4:]
        want = -sum(k / n * math.log2(k / n) for k in Counter(row.v).values())
        assert abs(row.h - want) < 1e-9
