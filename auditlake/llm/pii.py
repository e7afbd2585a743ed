"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from auditlake.llm.common import slices, small_batches

#: Kinds in the order in which spans are listed. Spans of the first four are kept whatever their score.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
                              StructField("base", BooleanType()), StructField("score", DoubleType())]))

# Every expression is tried once per place where a match can begin, and gives nothing back once it has matched a run, so that
# a text of megabytes without a break takes time in proportion to its length.
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGIT_RUN = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
INTERNATIONAL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ /-])[0-9]{3,4}[ -]?[0-9]{3,5}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Length of an account number by country, from the public IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Score of a span by its kind: what its form alone says, what a passed checksum or range check adds.
FORM = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.6, "iban": 0.4, "ssn": 0.3, "local_phone": 0.2}
CHECKED = {"card": 0.4, "iban": 0.5, "ssn": 0.1}
#: What one kind of word within WINDOW characters adds or takes; an added span is kept from ACCEPT on.
NEAR, AGAINST, WINDOW, ACCEPT = 0.3, -0.3, 40, 0.5
SUPPORT = {
    "email": ("mail", "email", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "login", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "bic", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "local_phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
OPPOSE = ("version", "isbn", "issn", "order", "invoice", "serial", "build", "part", "section")
WORD_NEAR = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of those before it."""
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def mod_97(account: str) -> bool:
    """Whether an account number without spaces has valid check digits: moved to its end, with letters as 10 to 35, the rest is 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A domain behind an @ with all characters of a local part before it, back to the last address or @."""
    end = low = 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        before = text[max(end, low):at]
        low = at + 1
        local = len(before) - len(before.rstrip(LOCAL_PART))
        if local:
            end = m.end()
            yield at - local, end


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGIT_RUN.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in INTERNATIONAL.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length, single spaces allowed, that pass modulus 97."""
    end = 0
    for m in IBAN_HEAD.finditer(text):
        size = IBAN_LENGTHS.get(m[0][:2])
        if size is None or m.start() < end:
            continue
        taken, at = m[0], m.end()
        while len(taken) < size:
            at += text[at:at + 1] == " "
            char = text[at:at + 1]
            if not (char.isascii() and (char.isdigit() or char.isupper())):
                break
            taken, at = taken + char, at + 1
        after = text[at:at + 1]
        if len(taken) == size and not (after.isascii() and after.isalnum()) and mod_97(taken):
            end = at
            yield m.start(), at


def social_numbers(text: str) -> Iterator[tuple[int, int]]:
    """Area, group and serial in the ranges that are given out."""
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in LOCAL_PHONE.finditer(text):
        if 7 <= len(NOT_DIGIT.sub("", m[0])) <= 12:
            yield m.span()


PROPOSE = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": accounts, "ssn": social_numbers, "local_phone": local_phones}


def score(text: str, kind: str, start: int, end: int) -> float:
    """Form and checks of a proposed span, and the words up to WINDOW characters before and behind it; 0 to 1."""
    words = {w.lower() for w in WORD_NEAR.findall(text[max(0, start - WINDOW):start]) + WORD_NEAR.findall(text[end:end + WINDOW])}
    total = FORM[kind] + CHECKED.get(kind, 0.0) + NEAR * (not words.isdisjoint(SUPPORT[kind])) + AGAINST * (not words.isdisjoint(OPPOSE))
    return round(min(1.0, max(0.0, total)), 3)


def spans_of(text: str | None) -> list[dict]:
    """All spans of one text, in the order of KINDS and then by start."""
    out = []
    for kind in KINDS if text else ():
        base = kind in BASE
        for start, end in PROPOSE[kind](text):
            points = score(text, kind, start, end)
            if base or points >= ACCEPT:
                out.append({"kind": kind, "start": start, "end": end, "base": base, "score": points})
    return out


def find_personal_data(docs: DataFrame, text: str = "text", name: str = "personal_data") -> DataFrame:
    """``docs`` and column ``name``: an array of (kind, start, end, base, score) of the personal data in each whole text.

    Places are counted in code points, the end is exclusive. Spans of one kind do not overlap; those of different kinds may.
    Mail addresses, IP addresses, cards (Luhn) and international phone numbers are base kinds: every span that passes its checks
    is there, its score tells how sure it is. Bank accounts (modulus 97), social security numbers and local phone numbers are
    added where form, checks and words nearby reach ACCEPT. Null and empty texts have an empty array, repeated rows get equal
    ones, an empty table gives no rows; other columns are unchanged, but for one called ``name`` (case ignored), which is
    replaced. A narrow pass: rows are not moved, and a lost task is repeated alone.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower() or c == text])

    def run(batches):
        for part in slices(batches, text):
            found = pa.array([spans_of(t) for t in part.column(text).to_pylist()], pa.list_(pa.struct([
                ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, name])

    return small_batches(kept).mapInArrow(run, StructType([*kept.schema.fields, StructField(name, SPANS)]))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def redact(docs: DataFrame, text: str = "text", spans: str = "personal_data") -> DataFrame:
    """``docs`` with every listed span of ``text`` replaced by its kind in brackets; of overlapping spans the first, then the
    longest, gives the kind and all their characters go. Null texts stay null; ``spans`` is left as it is."""
    ordered = F.array_sort(F.col(f"`{spans}`"), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                           .when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    body = F.col(f"`{text}`")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    folded = F.aggregate(ordered, begin, lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]),
                                                                     F.concat(F.lit("["), s["kind"], F.lit("]")))))
        .otherwise(acc["out"]).alias("out")))
    whole = F.concat(F.array_join(folded["out"], ""), F.substring(body, folded["at"] + 1, F.length(body)))
    return docs.withColumn(text, F.when(F.size(ordered) > 0, whole).otherwise(body))
