"""Findings of report files of any size: a file is read in blocks by many tasks and cut into its items before any JSON is parsed.

Spark's text source deals a file in blocks and cuts it at closing braces. Whether a block begins inside a string, and inside which
objects and lists, is not known in its task, so a first pass sums a block up for both cases: which containers it closes that
it did not open, which it leaves open, and whether it ends inside a string. The summaries of a file, one small row per block, are
put together in order and give each block the state it begins in. The second pass cuts the items out; an item that runs over
blocks is put together from its fragments. Held at a time are a batch of pieces, one item, or the summaries of one file.

Files are uncompressed UTF-8. An item, and a string without a closing brace, must fit into a cell. Items are parsed, and brackets
matched over the whole file; other faults outside the items, such as a key that stands twice in one object, are not noticed.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import materialize
from auditlake.sources.reports import PARSED, _is, _json_rows, _json_usable, _sarif_rows, _sarif_usable

#: States of at most so many blocks are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_BLOCKS = 100_000
#: Strings, whole or open to the end of the piece, and what cuts a text outside them.
TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"?|[{}\[\],:]', re.S)
STRING_REST = re.compile(r'(?:[^"\\]++|\\.)*+(")?', re.S)
#: The lists that hold items, as open containers: their bracket, for lists with the key they stand under.
ITEM_LISTS = {("{", "[findings"): "findings", ("{", "[runs", "{", "[results"): "sarif"}
RUNS = ("{", "[runs")
OPENED_BY = {"}": "{", "]": "["}
NAMES = {f'"{name}"' for name in ("runs", "results", "findings")}

SUMMARY = ("path string, block long, bytes long, size long, "
           "plain struct<closed:string,opened:array<string>,quoted:boolean,broken:boolean>, "
           "quoted struct<closed:string,opened:array<string>,quoted:boolean,broken:boolean>")
STATE = "path string, block long, stack array<string>, in_string boolean, sound boolean"
# kind: findings or sarif (a fragment of an item), key (name of the outermost object), root (an outermost container), or tally
PART = ("path string, block long, kind string, run long, item long, fresh boolean, starts boolean, ends boolean, last boolean, "
        "text string")
NO_REPORT = "not a findings or SARIF report"


class Walk:
    """Follows the containers of a text through its pieces, from a stack of open ones; pieces end behind a closing brace."""

    def __init__(self, stack=(), quoted: bool = False):
        self.stack, self.quoted, self.closed, self.broken = list(stack), quoted, [], False
        self.key, self.after_colon = "", False

    def tokens(self, piece: str):
        """(mark, start, end) of each structural character outside strings, after it took effect on the stack."""
        at = 0
        if self.quoted:
            rest = STRING_REST.match(piece)
            if rest.group(1) is None:
                return
            self.quoted, at, self.key = False, rest.end(), ""
        for token in TOKEN.finditer(piece, at):
            mark = token.group()
            if mark[0] == '"':
                # a piece ends with a brace, so a string without its end has no quote there
                if len(mark) == 1 or mark[-1] != '"':
                    self.quoted = True
                    return
                self.key, self.after_colon = mark, False
                continue
            before = self.after_colon
            self.after_colon = mark == ":"
            if mark in "{[":
                self.stack.append(mark + (_name(self.key) if before and mark == "[" else ""))
            elif mark in "}]":
                if self.stack:
                    self.broken |= self.stack.pop()[0] != OPENED_BY[mark]
                else:
                    self.closed.append(mark)
            yield mark, token.start(), token.end()


def _name(key: str) -> str:
    """A key as one of the names that matter, else empty."""
    if "\\" in key:
        try:
            key = f'"{json.loads(key)}"'
        except ValueError:
            return ""
    return key[1:-1] if key in NAMES else ""


class Cut(Walk):
    """Cuts the items out of a block that begins in a known state, and counts what numbers them."""

    def __init__(self, stack, quoted: bool):
        super().__init__(stack, quoted)
        self.kind = ITEM_LISTS.get(tuple(stack))
        if self.kind is None:
            # inside an item, the list that holds it is the longest known one the stack begins with
            self.kind = next((k for lead, k in ITEM_LISTS.items() if tuple(stack[:len(lead)]) == lead), None)
        self.depth = 2 if self.kind == "findings" else 4
        self.commas, self.item, self.fresh, self.starts = 0, -1, False, False
        self.text, self.parts = [], []

    def feed(self, piece: str) -> None:
        kept = 0
        for mark, start, end in self.tokens(piece):
            depth = len(self.stack)
            if self.kind is not None:
                if mark == "," and depth == self.depth:
                    self.text.append(piece[kept:start])
                    self._part(ends=True)
                    kept, self.starts = end, True
                    self.item += 1
                elif mark == "]" and depth == self.depth - 1:
                    self.text.append(piece[kept:start])
                    self._part(ends=True, last=True)
                    self.kind = None
            elif mark == "[" and depth in (2, 4):
                self.kind = ITEM_LISTS.get(tuple(self.stack))
                if self.kind is not None:
                    self.depth, kept, self.item, self.fresh, self.starts = depth, end, 0, True, True
            elif mark == "," and depth == 2 and tuple(self.stack) == RUNS:
                self.commas += 1
            elif mark == ":" and depth == 1 and self.stack[0] == "{":
                self._note("key", _name(self.key))
            if depth == 1 and mark in "{[":
                self._note("root", mark)
        if self.kind is not None:
            self.text.append(piece[kept:])

    def end(self) -> None:
        """The block ends: an item may be open, and what was counted goes to the blocks behind."""
        if self.kind is not None:
            self._part(ends=False)
        self.parts.append(("tally", self.commas, self.item + 1 if self.fresh else self.item, self.fresh, False, False, False, ""))

    def _part(self, ends: bool, last: bool = False) -> None:
        self.parts.append((self.kind, self.commas, self.item, self.fresh, self.starts, ends, last, "".join(self.text)))
        self.text = []

    def _note(self, kind: str, text: str) -> None:
        if kind == "root" or text:
            self.parts.append((kind, 0, 0, False, False, False, False, text))


def _blocks(batches):
    """(path, block, first rows of the block, rows as one text) for each run of rows of one block."""
    for rows in batches:
        cuts = (rows["path"].ne(rows["path"].shift()) | rows["block"].ne(rows["block"].shift())).cumsum()
        for _, run in rows.groupby(cuts, sort=False):
            yield run, "}".join(run["value"]) + "}"


def _summaries(batches):
    now, walks, got, size = None, None, 0, 0
    for run, text in _blocks(batches):
        here = (run["path"].iat[0], int(run["block"].iat[0]))
        if here != now:
            if now is not None:
                yield _summary(now, got, size, walks)
            now, walks, got, size = here, (Walk(), Walk(quoted=True)), 0, int(run["size"].iat[0])
        got += int(run["bytes"].sum()) + len(run)
        for walk in walks:
            for _ in walk.tokens(text):
                pass
    if now is not None:
        yield _summary(now, got, size, walks)


def _summary(now, got, size, walks) -> pd.DataFrame:
    both = [{"closed": "".join(w.closed), "opened": w.stack, "quoted": w.quoted, "broken": w.broken} for w in walks]
    return pd.DataFrame({"path": [now[0]], "block": [now[1]], "bytes": [got], "size": [size], "plain": [both[0]], "quoted": [both[1]]})


def _states(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state each block of one file begins in, and whether the brackets of the whole file match."""
    blocks = blocks.sort_values("block")
    stack, quoted, sound, rows = [], False, True, []
    # the text source does not tell whether the last piece had its brace: without it, one brace too many was read
    spare = int(blocks["bytes"].sum()) - int(blocks["size"].iat[0])
    for place, row in enumerate(blocks.itertuples(index=False), 1):
        rows.append((row.path, row.block, list(stack), quoted))
        did = row.quoted if quoted else row.plain
        closed = did["closed"]
        if spare and place == len(blocks) and closed.endswith("}") and len(closed) == len(stack) + 1 and not len(did["opened"]):
            closed = closed[:-1]
        else:
            sound &= spare == 0 or place < len(blocks)
        for mark in closed:
            sound &= bool(stack) and stack.pop()[0] == OPENED_BY[mark]
        stack.extend(did["opened"])
        quoted, sound = did["quoted"], sound and not did["broken"]
    sound &= not stack and not quoted
    out = pd.DataFrame(rows, columns=["path", "block", "stack", "in_string"])
    return out.assign(sound=bool(sound))


def _cuts(batches):
    now, cut = None, None
    for run, text in _blocks(batches):
        here = (run["path"].iat[0], int(run["block"].iat[0]))
        if here != now:
            if now is not None:
                cut.end()
                yield _parts(now, cut)
            now, cut = here, Cut(list(run["stack"].iat[0]), bool(run["in_string"].iat[0]))
        cut.feed(text)
        if cut.parts:
            yield _parts(now, cut)
    if now is not None:
        cut.end()
        yield _parts(now, cut)


def _parts(now, cut: Cut) -> pd.DataFrame:
    out = pd.DataFrame(cut.parts, columns=["kind", "run", "item", "fresh", "starts", "ends", "last", "text"])
    out.insert(0, "block", now[1])
    out.insert(0, "path", now[0])
    cut.parts = []
    return out


def _bases(tallies: pd.DataFrame) -> pd.DataFrame:
    """Runs and items of the open list that lie before each block of one file."""
    run = item = 0
    rows = []
    for row in tallies.sort_values("block").itertuples(index=False):
        rows.append((row.path, row.block, run, item))
        run += row.run
        item = row.item if row.fresh else item + row.item + 1
    return pd.DataFrame(rows, columns=["path", "block", "run_base", "item_base"])


def _one_root(path: Column) -> Column:
    """Local files are named with one slash in some places and with three in others."""
    return F.regexp_replace(path, r"\Afile:/+", "file:/")


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    meta = F.col("_metadata")
    return (spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(paths)
            .select(_one_root(meta["file_path"]).alias("path"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"),
                    F.octet_length("value").cast("long").alias("bytes"), F.make_valid_utf8("value").alias("value")))


def file_stem() -> Column:
    """The name of the file at ``path`` (a URI) without its extension, with the quoting undone that documents are published with."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?\z", 1)
    for _ in range(2):
        stem = F.try_url_decode(F.replace(stem, F.lit("+"), F.lit("%2B")))
    return F.coalesce(stem, F.col("path"))


@dataclass
class ReportFiles:
    findings: DataFrame
    errors: DataFrame


def read_report_files(spark: SparkSession, paths: str | list[str], repo: Column | None = None, strict: bool = True,
                      broadcast_blocks: int = BROADCAST_BLOCKS) -> ReportFiles:
    """Findings of SARIF 2.1.0 and JSON report files, with the rows and the ``pos`` that :func:`load_reports` gives their text.
    Stricter than that, a file with a second value behind its object is no report.

    ``repo`` names a file's repository from its ``path``; by default it is the file's name without extension. Folders are read
    with all below them, names that begin with ``_`` or ``.`` left out. A file that is no report, or none of whose findings can be
    used, raises, or with ``strict=False`` has a row (repo, error) in ``errors`` and none in ``findings``. Blocks follow
    ``spark.sql.files.maxPartitionBytes``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    pieces = _pieces(spark, paths)
    # the names the scan was planned with; files without a byte are among them, but give a scan no row
    files = spark.createDataFrame([(name,) for name in pieces.inputFiles()], "path string").select(_one_root(F.col("path")).alias("path"))
    summaries = pieces.mapInPandas(_summaries, SUMMARY)
    # all of a file's summaries: a row per block
    states = materialize(summaries.groupBy("path").applyInPandas(_states, STATE), "report-states")
    few = states.count() <= broadcast_blocks
    placed = pieces.withColumn("turn", F.monotonically_increasing_id()).join(
        F.broadcast(states) if few else states.hint("merge"), ["path", "block"])
    if not few:
        placed = placed.sortWithinPartitions("path", "block", "turn")
    parts = materialize(placed.select("path", "block", "value", "stack", "in_string").mapInPandas(_cuts, PART), "report-parts")

    bases = parts.where("kind = 'tally'").groupBy("path").applyInPandas(_bases, "path string, block long, run_base long, item_base long")
    items = _items(parts.where("kind in ('findings', 'sarif')"), bases)
    outer = parts.groupBy("path").agg(
        F.count_if(F.col("kind") == "root").alias("roots"),
        F.coalesce(F.bool_or((F.col("kind") == "key") & (F.col("text") == "runs")), F.lit(False)).alias("runs"),
        F.coalesce(F.bool_or((F.col("kind") == "key") & (F.col("text") == "findings")), F.lit(False)).alias("plain"))
    sound = states.groupBy("path").agg(F.bool_and("sound").alias("sound"))
    shape = (files.join(sound, "path", "left").join(outer, "path", "left")
             .withColumn("shape", F.when(F.coalesce(F.col("sound") & (F.col("roots") == 1), F.lit(False)),
                                         F.when(F.col("runs"), "sarif").when(F.col("plain"), "findings")))
             .select("path", (file_stem() if repo is None else repo).alias("repo"), "shape"))
    item = F.col("item")
    parsed = items.select("path", "kind", F.col("run").alias("run_no"), F.col("item").alias("item_no"),
                          F.try_parse_json("text").alias("item"))
    usable = F.when(F.col("kind") == "sarif", _sarif_usable(item)).otherwise(_json_usable(item))
    seen = parsed.groupBy("path", F.col("kind").alias("shape")).agg(
        F.count(F.lit(1)).alias("raw"), F.bool_or(F.coalesce(usable, F.lit(False))).alias("any"))
    faults = parsed.where(item.isNull()).select("path").distinct().withColumn("fault", F.lit(True))
    error = (F.when(F.col("shape").isNull() | F.col("fault"), NO_REPORT)
             .when((F.col("raw") > 0) & ~F.col("any"), F.concat(F.col("raw").cast("string"), F.lit(" findings but none parseable"))))
    judged = materialize(shape.join(seen, ["path", "shape"], "left").join(faults, "path", "left")
                         .select("path", "repo", "shape", error.alias("error")), "report-files")
    errors = judged.where("error is not null").select("repo", "error")
    if strict and (first := errors.orderBy("repo").first()) is not None:
        raise ValueError(f"{first.error}: {first.repo}")
    good = judged.where("error is null").select("path", "repo", F.col("shape").alias("kind"))
    rows = parsed.join(good, ["path", "kind"])
    findings = (_sarif_rows(rows.where("kind = 'sarif'")).unionByName(_json_rows(rows.where("kind = 'findings'")))
                .withColumn("pos", F.col("run_no") * F.lit(1 << 32) + F.col("item_no")).select(*PARSED))
    return ReportFiles(findings, errors)


def _items(fragments: DataFrame, bases: DataFrame) -> DataFrame:
    """Items (path, kind, run, item, text), numbered from the start of their file; those cut by blocks put together."""
    placed = fragments.join(bases, ["path", "block"]).select(
        "path", "block", "kind", "starts", "ends", "last", "text",
        F.when(F.col("kind") == "sarif", F.col("run") + F.col("run_base")).otherwise(0).cast("long").alias("run"),
        # a fragment at the head of a block goes on with the item before it
        F.when(F.col("fresh"), F.col("item")).otherwise(F.col("item_base") + F.col("item")).alias("item"))
    key = ["path", "kind", "run", "item"]
    whole = placed.where("starts and ends").select(*key, "last", "text")
    cut = placed.where("not (starts and ends)").groupBy(*key).agg(
        F.bool_or("last").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    # a list without items ends where its first one would begin
    return whole.unionByName(cut).where(~(F.col("last") & (F.col("item") == 0) & F.col("text").rlike(r"\A\s*\z"))).drop("last")
