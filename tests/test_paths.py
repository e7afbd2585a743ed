import fnmatch

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions.globs import is_excluded, shell_translator
from auditlake.functions.text import decode_utf8, ext_of, split_lines
from auditlake.sources.files import escapes_root

EXCLUDES = [
    ("a/node_modules/x.js", "**/node_modules/", True), ("node_modules/x.js", "node_modules/", True),
    ("sub/build/x.py", "/build/", False), ("build/x.py", "/build/", True), ("sub/build/x.py", "build/", True),
    ("src/vendor/a.js", "vendor/**", False), ("vendor/a/b.js", "vendor/**", True), ("mockapi.py", "api.py", False),
    ("src/api.py", "api.py", True), ("src/api.py", "/api.py", False), ("x/y.min.js", "*.min.js", True),
    ("x/y.min.js", "/*.min.js", False), ("a/b/c.py", "a/*.py", False), ("a/c.py", "a/*.py", True),
    ("a/b/c.py", "a/**/*.py", True), ("a/c.py", "a/**/c.py", True), ("dist", "dist/", True), ("mydist/x", "dist/", False),
    ("A/x.py", "a/", False), ("a.egg-info/x", "*.egg-info/", True), ("x/a.egg-info/y", "*.egg-info/", True),
    ("docs/a1/x", "a?/", True), ("docs/a12/x", "a?/", False), ("x", "", False), ("x", "/", False), ("x", "//", False),
    ("a[1].py", "a[1].py", True), ("a1.py", "a[1].py", False), ("p\\q\\r.py", "p/q/", True), ("a/b", "a/b/", True),
]


def test_exclude_matrix(spark):
    for pattern in sorted({p for _, p, _ in EXCLUDES}):
        rows = [(path, want) for path, p, want in EXCLUDES if p == pattern]
        got = spark.createDataFrame(rows, "path string, want boolean").withColumn(
            "got", is_excluded(F.col("path"), [pattern])).collect()
        assert [(r.path, r.got) for r in got] == [(r.path, r.want) for r in got], pattern


@settings(max_examples=400, deadline=None, derandomize=True)
@given(st.text("ab/.*?[]!-^", max_size=8), st.text("ab/.-[]!^", max_size=8))
def test_shell_patterns_equal_the_standard_library(pattern, path):
    import re
    rx = shell_translator()(pattern).replace(r"\z", r"\Z")
    assert bool(re.match(rx, path)) == fnmatch.fnmatchcase(path, pattern)


def test_extension_classes(spark):
    want = {"a/b.PY": ".py", ".env": ".env", ".envrc": ".env", ".ENV.local": ".env", "Dockerfile": ".dockerfile",
            "x/dockerfile.dev": ".dockerfile", "dockerfiles.md": ".md", ".gitignore": "", "a.": "", "x.tar.gz": ".gz",
            "a\\b.js": ".js"}
    rows = spark.createDataFrame([(p,) for p in want], "p string").select("p", ext_of(F.col("p")).alias("e")).collect()
    assert {r.p: r.e for r in rows} == want


def test_split_lines_equals_python(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb", "a\rb\x0bc\x0cd", "\x1ca\x1db\x1e", "a\x85b c ", "\r\n\r\n", "a\n\r\nb\r"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_lines(F.col("t")).alias("l")).collect()
    assert [(r.t, r.l) for r in rows] == [(r.t, r.t.splitlines()) for r in rows]


def test_decode(spark):
    raw = [b"\xef\xbb\xbfabc", b"a\xffb", "é".encode(), b"\xe2\x82", b""]
    rows = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary").select(decode_utf8(F.col("b")).alias("t")).collect()
    assert [r.t for r in rows] == [b.decode("utf-8-sig", errors="replace") for b in raw]


def test_paths_that_leave_the_root(spark):
    want = {"a/b": False, "../a": True, "a/../b": False, "a/../../b": True, "/a": True, "./a": False, "..": True}
    rows = spark.createDataFrame([(p,) for p in want], "p string").select("p", escapes_root(F.col("p")).alias("e")).collect()
    assert {r.p: r.e for r in rows} == want
