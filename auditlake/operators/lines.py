"""Physical and logical lines of a file, as arrays inside the file's own row.

A file's lines never leave its row: rules filter these arrays and only the few lines that
become findings are exploded, so the pass over the text needs no shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import split_lines, strip

FOLD_MAX = 10_000                       # fixed value: characters after which an open statement is no longer joined on
LINES = "array<struct<line:int,text:string>>"


def physical_lines(text: Column) -> Column:
    return F.transform(split_lines(text), lambda l, i: F.struct(
        (i + 1).alias("line"), l.alias("text")))


def continues(line: Column) -> Column:
    """True where a physical line alone leaves a statement open."""
    opened = F.length(F.replace(line, F.lit("("), F.lit("")))
    closed = F.length(F.replace(line, F.lit(")"), F.lit("")))
    # most lines are ruled out by holding no parenthesis and by their last character
    ends = F.when(F.right(line, F.lit(1)).rlike(r"(?U)[,(\s\x1c-\x1f]"), line.rlike(r"(?U)[,(][\s\x1c-\x1f]*$")).otherwise(False)
    return F.when(F.contains(line, F.lit("(")), opened < closed).otherwise(False) | ends


def folder(limit: int = FOLD_MAX):
    """The folding function. Built inside a function so that executors get it by value and
    need no installed copy of this package."""
    def fold(pieces: list[str]) -> list[tuple[int, str]]:
        """Join open statements: (first physical line, whole text). Every character is part of one of them."""
        folded: list[tuple[int, str]] = []
        first, held, depth, size = 1, [], 0, 0
        for number, raw in enumerate(pieces, 1):
            piece = raw.strip()
            if not held:
                first = number
            held.append(piece)
            size += len(piece) + (len(held) > 1)
            depth += piece.count("(") - piece.count(")")
            is_open = depth > 0 or piece.endswith((",", "("))
            if size >= limit or not is_open or number == len(pieces):
                folded.append((first, " ".join(held)))
                held, depth, size = [], 0, 0
        return folded
    return fold


def fold_text():
    """Column function: text to its logical lines, Arrow batch by batch."""
    fold = folder()

    def fold_batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"line": n, "text": s} for n, s in fold(t.splitlines())],
                         na_action="ignore")

    return F.pandas_udf(fold_batch, LINES)


def with_logical_lines(files: DataFrame, needed: Column, exact: bool = False) -> DataFrame:
    """Add ``physical`` and ``logical`` line arrays to rows with ``text``.

    ``logical`` is filled only where ``needed``. Files without an open line stay in the
    JVM; the text of the others goes to Python once, because the end of one statement
    decides where the next begins. Rules match alike with and without outer white space,
    so unfolded lines keep it unless ``exact`` asks for the stripped text. Lines are never cut.
    """
    short = strip if exact else (lambda text: text)
    folds = F.exists("physical", lambda l: continues(l["text"]))
    return (
        files
        .withColumn("physical", physical_lines(F.col("text")))
        .withColumn("_logical_wanted", needed)
        .withColumn("_fold_wanted", F.when(F.col("_logical_wanted"), folds).otherwise(False))
        .withColumn("_folded", fold_text()(F.when(F.col("_fold_wanted"), F.col("text"))))
        .withColumn("logical", F.when(F.col("_fold_wanted"), F.col("_folded"))
                    .when(F.col("_logical_wanted"), F.transform("physical", lambda l: F.struct(
                        l["line"].alias("line"),
                        short(l["text"]).alias("text"))))
                    .otherwise(F.array().cast(LINES)))
        .drop("_logical_wanted", "_fold_wanted", "_folded")
    )


def explode_physical(files: DataFrame) -> DataFrame:
    """One row per physical line."""
    return files.select("repo", "path", F.inline(physical_lines(F.col("text"))))


def explode_logical(files: DataFrame) -> DataFrame:
    """One row per logical line."""
    return (with_logical_lines(files.select("repo", "path", "text"), F.lit(True), exact=True)
            .select("repo", "path", F.inline_outer("logical")).where(F.col("line").isNotNull()))
