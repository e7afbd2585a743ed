"""Alignment of two tokenizers over the same bytes: tokens as intervals, coalesced into groups, linked where they overlap."""

from __future__ import annotations

import os
import re
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from auditlake.llm.common import free_name, slices, small_batches
from auditlake.session import materialize

#: Where the public vocabularies lie; parameters of the operator. Larger files are not read.
A_PATH, B_PATH, MODEL_BYTES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model", 64_000_000
MARKER = "\u2581"
#: Both tokenizers end a token at a space between two of these characters (printable, no kind of white space, no marker),
#: so a text is cut there and every different chunk is encoded and aligned once.
INK = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x21, 0x7E), (0xA1, 0x167F), (0x1681, 0x180D), (0x180F, 0x1FFF), (0x2C00, 0x2FFF), (0x3001, 0xD7FF)))
CUT = re.compile(f"(?<=[{INK}]) (?=[{INK}])")
MEET = re.compile(f"[{INK}] [{INK}]")
#: Characters of chunks that are encoded in one call.
TOGETHER = 1000
#: Bytes of finished chunks a task remembers, twice.
CACHE_BYTES = 48_000_000
#: At most so many pair counts are sent to every task, the most frequent ones; the others are joined.
SENT_PAIRS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 itself, others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def read_bounded(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return data


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the chunks that were aligned last."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        alphabet = byte_alphabet()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(alphabet[c] for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
                        else p.replace(MARKER, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        self.b_space = self.b.piece_to_id(MARKER)
        # a token's id in the text of groups: A's end in a comma or bar, B's in a comma or semicolon
        self.words = [b"%d%s" % (i, mark) for table, marks in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";"))) for i in range(len(table)) for mark in marks]
        self.word_size = np.array([len(w) for w in self.words], dtype=np.int64)
        # a piece with a marker behind other characters could reach over a cut
        self.cuts = not any(MARKER in p.lstrip(MARKER) for p in pieces)
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        """Space and text, cut; every chunk begins with a space."""
        if not self.cuts:
            return [" " + text]
        first, *others = CUT.split(" " + text)
        return [first, *(" " + c for c in others)]

    def align(self, texts: list[str | None]) -> list[list[tuple] | None]:
        """The aligned chunks of each text; None for null and empty texts and those whose tokens do not spell them."""
        split = [self.chunks(t) if t else None for t in texts]
        here: dict[str, tuple | None] = {}
        new = []
        for chunk in dict.fromkeys(c for cs in split if cs for c in cs):
            if chunk in self.young:
                here[chunk] = self.young[chunk]
            elif chunk in self.old:
                here[chunk] = self._keep(chunk, self.old[chunk])
            else:
                new.append(chunk)
        for chunk, found in zip(new, self._align_new(new), strict=True):
            here[chunk] = self._keep(chunk, found)
        if self.held > CACHE_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        out: list[list[tuple] | None] = []
        for cs in split:
            parts = [here[c] for c in cs] if cs else None
            out.append(None if parts is None or None in parts else parts)
        return out

    def _keep(self, chunk: str, found: tuple | None) -> tuple | None:
        self.held += 300 + 2 * len(chunk) + (len(found[3]) + len(found[4]) if found else 0)
        self.young[chunk] = found
        return found

    def _a_ids(self, chunks: list[str]) -> tuple[list[int], np.ndarray]:
        """A's tokens of chunks laid end to end, and where those of each chunk end. Chunks that meet in a cut are encoded together."""
        runs, sizes = [], []
        for chunk in chunks:
            if runs and sizes[-1] < TOGETHER and self.cuts and MEET.match(runs[-1][-1][-1] + chunk[:2]):
                runs[-1].append(chunk)
                sizes[-1] += len(chunk)
            else:
                runs.append([chunk])
                sizes.append(len(chunk))
        found = [e.ids for e in self.a.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=sum(map(len, found)))
        ends = np.cumsum([len(c.encode()) for c in chunks])
        return flat, np.searchsorted(np.cumsum(self.a_size[flat]), ends, side="right")

    def _align_new(self, chunks: list[str]) -> list[tuple | None]:
        """What ``align`` gives for each chunk; None for one that is not spelled by its tokens."""
        if not chunks:
            return []
        a, a_ends = self._a_ids(chunks)
        b_ids = [ids or [self.b_space] for ids in self.b.encode([c[1:] for c in chunks], num_threads=1)]
        b, b_ends = np.fromiter(chain.from_iterable(b_ids), dtype=np.int64, count=sum(map(len, b_ids))), np.cumsum([len(i) for i in b_ids])
        data, ends = "".join(chunks).encode(), np.cumsum([len(c.encode()) for c in chunks])
        whole = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == data == b"".join(map(self.b_bytes.__getitem__, b.tolist()))
        if whole and (np.cumsum(self.a_size[a])[a_ends - 1] == ends).all() and (np.cumsum(self.b_size[b])[b_ends - 1] == ends).all():
            return self._groups(a, a_ends, b, b_ends)
        if len(chunks) == 1:
            return [None]
        # some chunk is not spelled: look for it in halves
        half = len(chunks) // 2
        return self._align_new(chunks[:half]) + self._align_new(chunks[half:])

    def _groups(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> list[tuple]:
        """(A tokens, B tokens, groups, linked pairs as 64-bit numbers, groups as text) of chunks laid end to end."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_start, b_start = a_end - self.a_size[a], b_end - self.b_size[b]
        start, end = np.r_[a_start, b_start], np.r_[a_end, b_end]
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order])
        breaks = np.r_[True, start[order][1:] >= reach[:-1]]  # no earlier token goes on past this start
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(breaks) - 1
        a_group, b_group = group[:len(a)], group[len(a):]
        n_groups = int(group.max()) + 1
        # within a group, a token of A overlaps the tokens of B from the first that ends behind its start to the last before its end
        low, high = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_start, a_end, side="left")
        many = high - low
        token = np.repeat(np.arange(len(a)), many)
        other = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        pairs = (a[token] << 32 | b[other]).astype("<i8").tobytes()
        # ids as text, each with what follows it: A's tokens of a group, then B's
        a_first, b_first = np.searchsorted(a_group, np.arange(n_groups + 1)), np.searchsorted(b_group, np.arange(n_groups + 1))
        a_last, b_last = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        a_last[a_first[1:] - 1] = b_last[b_first[1:] - 1] = 1
        word = np.empty(len(order), dtype=np.int64)
        word[np.arange(len(a)) + b_first[a_group]] = 2 * a + a_last
        word[np.arange(len(b)) + a_first[b_group + 1]] = 2 * (len(self.a_bytes) + b) + b_last
        text = b"".join(map(self.words.__getitem__, word.tolist()))
        places = np.r_[0, np.cumsum(self.word_size[word])]
        n_a, n_b = np.r_[0, a_ends], np.r_[0, b_ends]
        at, links = places[n_a + n_b].tolist(), (8 * np.r_[0, np.cumsum(many)][n_a]).tolist()
        groups = np.diff(np.r_[a_group[n_a[:-1]], n_groups])
        return [(x, y, g, pairs[links[i]:links[i + 1]], text[at[i]:at[i + 1] - 1])
                for i, (x, y, g) in enumerate(zip(np.diff(n_a).tolist(), np.diff(n_b).tolist(), groups.tolist(), strict=True))]


COLUMNS = [StructField("n_a", LongType()), StructField("n_b", LongType()), StructField("n_groups", LongType()), StructField("n_links", LongType()),
           StructField("groups_sha256", StringType()), StructField("pairs", ArrayType(LongType())), StructField("times", ArrayType(IntegerType()))]


def align_tokens(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, text: str = "text", groups: bool = True) -> DataFrame:
    """One struct column ``aligned`` beside the columns of ``docs``: n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, groups.

    A encodes a space and the text by a byte-level vocabulary, B the text by a piece vocabulary that puts the space there itself;
    strings of special tokens are plain text. Groups lie between neighbouring byte places where tokens of both end; ``groups`` is
    their ids as ``a1,a2|b1;a3|b2,b3`` (left out unless asked for), ``groups_sha256`` its digest. ``pairs`` has each linked id pair
    once, as A's id times 2^32 plus B's, ``times`` how many token pairs it stands for. Null and empty texts, and those that the
    tokens of either do not spell byte by byte, have zeros, empty arrays and empty strings. Texts are read whole; one without
    any space is one chunk. Repeated rows get equal values; a column called ``aligned`` is replaced; other columns are unchanged.
    The two files are read by the driver, at most MODEL_BYTES each, and sent to the tasks. Rows are not moved.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "aligned" or c == text])
    files = docs.sparkSession.sparkContext.broadcast((read_bounded(a_path), read_bounded(b_path)))
    fields = [*COLUMNS, *([StructField("groups", StringType())] if groups else [])]
    arrow = pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                       ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), *([("groups", pa.string())] if groups else [])])

    def run(batches):
        aligner = Aligner(*files.value)
        for part in slices(batches, text):
            sums, digests, spelled, pairs, times = [], [], [], [], []
            for found in aligner.align(part.column(text).to_pylist()):
                n_a, n_b, n_groups, linked, written = zip(*found, strict=True) if found else ((), (), (), (), ())
                pair, time = np.unique(np.frombuffer(b"".join(linked), dtype="<i8"), return_counts=True)
                body = b";".join(written)
                sums.append((sum(n_a), sum(n_b), sum(n_groups), int(time.sum())))
                digests.append(sha256(body).hexdigest() if found else "")
                spelled.append(body.decode() if groups else "")
                pairs.append(pair)
                times.append(time.astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, pairs)]).astype(np.int32))
            columns = [*(pa.array([s[k] for s in sums], pa.int64()) for k in range(4)), pa.array(digests, pa.string()),
                       pa.ListArray.from_arrays(ends, pa.array(np.concatenate(pairs), pa.int64())),
                       pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times), pa.int32())), *([pa.array(spelled, pa.string())] if groups else [])]
            made = pa.StructArray.from_arrays(columns, fields=list(arrow))
            yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "aligned"])

    return small_batches(kept).mapInArrow(run, StructType([*kept.schema.fields, StructField("aligned", StructType(fields))]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows of ``aligned`` each id pair is linked, and whether that is its A id's highest count."""
    counts = materialize(aligned.select(F.explode("aligned.pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", 32)).join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``aligned`` and, per row, n_best (links whose pair is its A id's most frequent) and count_sum (the counts of all links).

    The ``sent_pairs`` most frequent pairs, cut at a power of two, are sent to every task, so that no frequent pair is shuffled;
    links of the rarer ones are joined on the pair, and added up per row. Both ways give the same values. ``aligned`` must be
    a written table: rows are numbered in it.
    """
    spark = aligned.sparkSession
    powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pairs")).orderBy(F.desc("power")).collect()
    total, least = 0, None
    for r in powers:
        if total + r.pairs > sent_pairs:
            break
        total, least = total + r.pairs, r.power
    whole = total == sum(r.pairs for r in powers)
    floor = 2 ** min(least, 62) if least is not None else 2 ** 63 - 1
    sent = counts.where(F.col("n") >= floor).toArrow()
    by_pair = np.argsort(sent.column("pair").to_numpy())
    table = spark.sparkContext.broadcast(tuple(sent.column(c).to_numpy()[by_pair] for c in ("pair", "n", "best")))
    row = free_name(aligned, "row")
    kept = StructType([*aligned.schema.fields, StructField(row, LongType()), StructField("n_best", LongType()), StructField("count_sum", LongType()),
                       StructField("rest", ArrayType(LongType())), StructField("rest_times", ArrayType(IntegerType()))])

    def run(batches):
        pair, n, best = table.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            lists = batch.column("aligned").field("pairs")
            times = batch.column("aligned").field("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            here = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(pair, here), max(len(pair) - 1, 0))
            known = pair[at] == here if len(pair) else np.zeros(len(here), dtype=bool)
            sums = np.zeros((2, len(sizes)), dtype=np.int64)
            if known.any():
                np.add.at(sums[0], owner[known], times[known] * best[at[known]])
                np.add.at(sums[1], owner[known], times[known] * n[at[known]])
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(owner[~known], minlength=len(sizes)))].astype(np.int32))
            columns = [pa.array(number + np.arange(len(sizes))), pa.array(sums[0]), pa.array(sums[1]),
                       pa.ListArray.from_arrays(ends, pa.array(here[~known], pa.int64())),
                       pa.ListArray.from_arrays(ends, pa.array(times[~known], pa.int32()))]
            number += len(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, row, "n_best", "count_sum", "rest", "rest_times"])

    scored = aligned.mapInArrow(run, kept)
    if whole:
        return scored.drop(row, "rest", "rest_times")
    scored = materialize(scored, "links")
    rare = counts.where(F.col("n") < floor)
    left = scored.select(row, F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select(
        row, F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    more = left.join(rare, "pair").groupBy(row).agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"),
                                                   F.sum(F.col("times") * F.col("n")).alias("more_count"))
    out = scored.join(more, row, "left")
    return out.select(*[F.col(f"`{c}`") for c in aligned.columns], (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                      (F.col("count_sum") + F.coalesce("more_count", F.lit(0))).alias("count_sum"))


def link_statistics(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The tokens of a text are found once; what is written for the second pass is each row's pairs, not its tokens. Counts are over
    rows, so repeated rows count each. Documents without tokens have zeros and an empty digest; an empty table gives no rows.
    """
    aligned = materialize(align_tokens(docs.select("doc_id", "text"), a_path, b_path, groups=False).drop("text"), "aligned")
    counts = materialize(pair_counts(aligned), "best-pairs")
    out = score_links(aligned, counts)
    return out.select("doc_id", "aligned.n_a", "aligned.n_b", "aligned.n_groups", "aligned.n_links", "n_best", "count_sum", "aligned.groups_sha256")
