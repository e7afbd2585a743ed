"""Rules that need state across the lines of one file (computed inside the file's row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import lstrip, strip

HITS = "array<struct<line:int,shown:string,message:string>>"

# What makes a run step and an untrusted expression, and a FROM instruction.
UNTRUSTED = r"(?Ud)\$\{\{\s*(?:github\.event\.[A-Za-z0-9_.]+|github\.head_ref)\b"
RUN_BLOCK = r"(?Ud)^\s*-?\s*run\s*:\s*[|>][-+]?\s*$"
RUN_KEY = r"(?Ud)^\s*-?\s*run\s*:"
FROM = r"(?iUd)^\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?\s*$"


def script_injection_hits(physical: Column) -> Column:
    """SEC041: untrusted context inside a ``run:`` step, inline or block scalar.

    One left-to-right pass; the state is two scalars, and the hit list grows only on a hit.
    """
    start = F.struct(F.lit(False).alias("inside"), F.lit(-1).alias("indent"),
                     F.array().cast("array<int>").alias("hits"))

    def step(state, entry):
        text = entry["text"]
        bare = strip(text)
        indent = F.length(text) - F.length(lstrip(text))
        inside = state["inside"] & ~((bare != "") & (indent <= state["indent"]))
        untrusted = text.rlike(UNTRUSTED)
        opens = text.rlike(RUN_BLOCK) & ~(inside & untrusted)
        hit = untrusted & (inside | (text.rlike(RUN_KEY) & ~opens))
        return F.when(bare.startswith("#"), state).otherwise(F.struct(
            (inside | opens).alias("inside"),
            F.when(opens, indent).otherwise(state["indent"]).alias("indent"),
            F.when(hit, F.concat(state["hits"], F.array(entry["line"])))
            .otherwise(state["hits"]).alias("hits")))

    lines = F.aggregate(physical, start, step, lambda s: s["hits"])
    return F.transform(lines, lambda n: F.struct(
        n.alias("line"), F.element_at(physical, n)["text"].alias("shown"),
        F.lit("").alias("message")))


def untagged_image_hits(physical: Column) -> Column:
    """SEC070: FROM without tag or digest, unless it names a stage defined up to that line."""
    froms = F.transform(
        F.filter(physical, lambda l: l["text"].rlike(FROM)),
        lambda l: F.struct(l["line"].alias("line"), l["text"].alias("text"),
                           F.regexp_extract(l["text"], FROM, 1).alias("image"),
                           F.lower(F.regexp_extract(l["text"], FROM, 2)).alias("stage")))
    stages = F.filter(froms, lambda f: f["stage"] != "")

    def moving(f):
        image = F.lower(f["image"])
        defined = F.array_position(stages["stage"], image).cast("int")
        is_stage = F.when(defined > 0, F.get(stages["line"], defined - 1) <= f["line"]).otherwise(False)
        return ((image != "scratch") & ~F.contains(image, F.lit("$")) & ~is_stage
                & ~has_tag(f["image"]))

    return F.transform(F.filter(froms, moving), lambda f: F.struct(
        f["line"].alias("line"), f["text"].alias("shown"),
        F.concat(F.lit("FROM "), f["image"], F.lit(
            " resolves to a moving target (implicit :latest) — builds are not reproducible."))
        .alias("message")))


def has_tag(image: Column) -> Column:
    """True where an image reference carries a tag or digest (a port is not a tag)."""
    return F.contains(image, F.lit("@")) | F.contains(
        F.substring_index(image, "/", -1), F.lit(":"))
