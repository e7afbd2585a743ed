"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from auditlake.llm.common import slices, small_batches

#: Where the public vocabulary lies; a parameter of the operator.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Largest model file that is read and broadcast.
MODEL_BYTES = 64_000_000
SPACE = "▁"
#: Numbers of the model format (public protocol): kinds of pieces, and what an unknown character scores below the least piece.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
USER_DISCOUNT = 0.1
#: Chunks up to so many bytes are searched together, column by column; longer ones one by one.
SHORT = 48
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Bytes of chunks and ids a task remembers, twice; what an entry takes besides them.
CACHE_BYTES, ENTRY_BYTES = 24_000_000, 250
#: Starting places of a long chunk whose pieces are looked up together.
STRETCH = 1 << 16


def _fields(data: bytes):
    """(field number, value) of a protocol message: ints for numbers, bytes for fixed and length-delimited values."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else number()
        yield key >> 3, data[at:at + size]
        at += size


@dataclass
class Model:
    """Pieces with scores and kinds, and the settings that matter for encoding."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    prefix: bool = True
    squeeze: bool = False
    unknown: int = 0
    bytes_at: list[int] = field(default_factory=list)

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as file:
            data = file.read(MODEL_BYTES + 1)
        if len(data) > MODEL_BYTES:
            raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
        return cls.parse(data)

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, kinds, prefix, squeeze = [], [], [], True, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 3:
                own = dict(_fields(value))
                prefix, squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
                if own.get(2):
                    raise ValueError("models with a character map are not supported: texts are encoded unchanged")
        kinds = np.array(kinds, dtype=np.int8)
        by_byte = {p: i for i, p in enumerate(pieces) if kinds[i] == BYTE}
        at = [by_byte[f"<0x{b:02X}>"] for b in range(256)] if len(by_byte) == 256 else []
        return cls(pieces, np.array(scores, dtype=np.float32), kinds, prefix, squeeze, int(np.flatnonzero(kinds == UNKNOWN)[0]), at)


class DoubleArray:
    """Trie of byte strings: a state's child by byte b is ``base[state] + b`` if ``check`` of it names the state."""

    @classmethod
    def of(cls, base: np.ndarray, check: np.ndarray, value: np.ndarray) -> DoubleArray:
        made = cls.__new__(cls)
        made.base, made.check, made.value = base, check, value
        return made

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in zip(keys, values, strict=True):
            node = 0
            for byte in key:
                after = children[node].get(byte)
                if after is None:
                    after = children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = after
            ends[node] = value
        room = 2 * len(children) + 1024
        self.base, self.check, self.value = (np.full(room, fill, dtype=np.int32) for fill in (0, -1, -1))
        used, low = bytearray(room), 1
        used[0] = 1
        state, queue = {0: 0}, [0]
        for node in queue:
            mine = state[node]
            self.value[mine] = ends[node]
            if not children[node]:
                continue
            steps = sorted(children[node])
            if len(used) < low + 2 * 65536:
                more = max(len(used), 4 * 65536)
                used.extend(bytes(more))
                self.base, self.check, self.value = (np.r_[x, np.full(more, fill, np.int32)] for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
            free, tries = used.find(0, max(low, steps[0] + 1)), 0
            while any(used[free - steps[0] + b] for b in steps):
                free, tries = used.find(0, free + 1), tries + 1
            if tries > 64:  # the slots before are nearly full: do not search them again
                low = free
            base = free - steps[0]
            self.base[mine] = base
            for b in steps:
                used[base + b] = 1
                self.check[base + b] = mine
                state[children[node][b]] = base + b
                queue.append(children[node][b])
        pad = np.zeros(256, dtype=np.int32)  # any base plus any byte stays inside
        self.base, self.check, self.value = np.r_[self.base, pad], np.r_[self.check, pad - 1], np.r_[self.value, pad - 1]


class Decoder:
    """Texts of pieces."""

    def __init__(self, model: Model):
        spelled = {i: bytes([b]) for b, i in enumerate(model.bytes_at)}
        self.prefix = model.prefix
        self.texts = [b"" if k == CONTROL else spelled[i] if i in spelled else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
                      for i, (p, k) in enumerate(zip(model.pieces, model.kinds.tolist(), strict=True))]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


class Encoder(Decoder):
    """Most probable segmentation of texts into pieces, and back."""

    def __init__(self, model: Model, trie: DoubleArray | None = None):
        super().__init__(model)
        self.model = model
        usable = [i for i, k in enumerate(model.kinds.tolist()) if k in (NORMAL, USER) and model.pieces[i] and "\0" not in model.pieces[i]]
        self.trie = trie or DoubleArray([model.pieces[i].encode() for i in usable], usable)
        scores = model.scores.astype(np.float64)
        plain = scores[model.kinds == NORMAL]
        for i in np.flatnonzero(model.kinds == USER):
            scores[i] = len(model.pieces[i].encode()) * plain.max(initial=0) - USER_DISCOUNT
        self.scores = scores.astype(np.float64)
        self.lost = float(plain.min(initial=0)) - UNKNOWN_PENALTY
        # no piece goes on past a space that follows other characters, so such places split any text for the search
        self.splits = not any(SPACE in model.pieces[i].lstrip(SPACE) for i in usable)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def sendable(self) -> tuple:
        """Everything ``received`` needs, in types that a worker without this package can unpickle."""
        m = self.model
        return ((m.pieces, m.scores, m.kinds, m.prefix, m.squeeze, m.unknown, m.bytes_at), (self.trie.base, self.trie.check, self.trie.value))

    @classmethod
    def received(cls, parts: tuple) -> Encoder:
        return cls(Model(*parts[0]), DoubleArray.of(*parts[1]))

    def chunks(self, text: str) -> list[str]:
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        text = (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)
        return CHUNK.findall(text) if self.splits else [text]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [self.chunks(t or "") for t in texts]
        here: dict[str, bytes] = dict.fromkeys(chain.from_iterable(split), b"")
        # two generations: what was not asked for while one filled up is forgotten with the next
        young, old = self.cache, self.older
        new = []
        for chunk in here:
            ids = young.get(chunk)
            if ids is None:
                ids = old.get(chunk)
                if ids is None:
                    new.append(chunk)
                    continue
                self._keep(chunk, ids)
            here[chunk] = ids
        here.update(zip(new, self._search([c.encode() for c in new]), strict=True))
        for chunk in new:
            self._keep(chunk, here[chunk])
        if self.held > CACHE_BYTES:
            self.cache, self.older, self.held = {}, young, 0
        return [b"".join(map(here.__getitem__, cs)) for cs in split]

    def _keep(self, chunk: str, ids: bytes) -> None:
        self.held += ENTRY_BYTES + 2 * len(chunk) + len(ids)
        self.cache[chunk] = ids

    def _search(self, chunks: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        sizes = np.array([len(c) for c in chunks])
        for low, high in ((0, 8), (8, 14), (14, 24), (24, SHORT)):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(some, len(some) // 4096 + 1):
                for i, ids in zip(part, self._together([chunks[i] for i in part], high), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > SHORT):
            out[i] = self._alone(chunks[i])
        return out

    def _together(self, chunks: list[bytes], width: int) -> list[bytes]:
        """Viterbi search of many short chunks at once, one vector operation per place, length and trie step."""
        n = len(chunks)
        if not n:
            return []
        # one row per place and one column per chunk, so that every step reads and writes one contiguous row
        text = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in chunks), dtype=np.uint8).reshape(n, width).T.astype(np.int32)
        size = np.array([len(c) for c in chunks])
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        begin, piece = np.zeros((width + 1, n), dtype=np.int32), np.full((width + 1, n), -1, dtype=np.int32)
        starts = ((text & 0xC0) != 0x80) & (np.arange(width)[:, None] < size)
        long = np.select([text < 0x80, text < 0xE0, text < 0xF0], [1, 2, 3], 4)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        for s in range(width):
            rows = np.flatnonzero(starts[s])
            if not len(rows):
                continue
            single = np.zeros(n, dtype=bool)
            here, state, length = rows, np.zeros(len(rows), dtype=np.int32), long[s]
            for at in range(s, width):  # no piece holds the zero byte that pads
                after = base.take(state) + text[at].take(here)
                ok = check.take(after) == state
                here, state = here[ok], after[ok]
                if not len(here):
                    break
                found = value.take(state)
                hit = found >= 0
                r, ids = here[hit], found[hit]
                if at < s + 4:
                    single[r[length.take(r) == at + 1 - s]] = True
                score = best[s].take(r) + scores.take(ids)
                better = score > best[at + 1].take(r)
                r = r[better]
                best[at + 1][r], begin[at + 1][r], piece[at + 1][r] = score[better], s, ids[better]
            r = rows[~single[rows]]  # no piece is this one character: it may stay unknown
            end = s + length[r]
            score = best[s][r] + self.lost
            better = score > best[end, r]
            r, end = r[better], end[better]
            best[end, r], begin[end, r], piece[end, r] = score[better], s, self.model.unknown
        # back from the ends, all chunks at once
        at, rows, back = size.astype(np.int32), np.arange(n), []
        lost = np.zeros(n, dtype=bool)
        while len(rows):
            ids = piece[at, rows]
            lost[rows[ids == self.model.unknown]] = True
            back.append((rows, ids))
            at = begin[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        count = np.zeros(n, dtype=np.int64)
        for rows, _ in back:
            count[rows] += 1
        ends = np.cumsum(count)
        flat = np.empty(int(ends[-1]), dtype="<i4")
        for step, (rows, ids) in enumerate(back):
            flat[ends[rows] - 1 - step] = ids
        data, bounds = flat.tobytes(), [0, *(ends * 4).tolist()]
        out = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in np.flatnonzero(lost):  # characters to spell out
            out[i] = self._ids(chunks[i], begin[:, i].tolist(), piece[:, i].tolist())
        return out

    def _alone(self, chunk: bytes) -> bytes:
        """The same search for one long chunk: all pieces at the places of a stretch are looked up together, then weighed in order."""
        n = len(chunk)
        best, begin, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        text = np.frombuffer(chunk + b"\0", dtype=np.uint8).astype(np.int32)
        for low in range(0, n, STRETCH):
            places = low + np.flatnonzero((text[low:min(n, low + STRETCH)] & 0xC0) != 0x80)
            lead = text[places]
            long = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [1, 2, 3], 4)
            start, at, state = places, places, np.zeros(len(places), dtype=np.int32)
            single = np.zeros(n + 1 - low, dtype=bool)
            size = np.zeros(n + 1 - low, dtype=np.int32)
            size[places - low] = long
            parts = []
            while len(start):  # no piece holds the zero byte behind the end
                after = base.take(state) + text.take(at)
                ok = check.take(after) == state
                start, at, state = start[ok], at[ok] + 1, after[ok]
                found = value.take(state)
                hit = found >= 0
                parts.append((start[hit], at[hit], found[hit]))
                single[start[hit & (at - start == size[start - low])] - low] = True
            lost = ~single[places - low]  # no piece is this one character: it may stay unknown
            parts.append((places[lost], (places + long)[lost], np.full(int(lost.sum()), self.model.unknown)))
            begins, ends, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            points = np.where(ids == self.model.unknown, self.lost, scores.take(ids))
            order = np.lexsort((ends, begins))
            for s, e, i, p in zip(begins[order].tolist(), ends[order].tolist(), ids[order].tolist(), points[order].tolist(), strict=True):
                score = best[s] + p
                if score > best[e]:
                    best[e], begin[e], piece[e] = score, s, i
        return self._ids(chunk, begin, piece)

    def _ids(self, chunk: bytes, begin: list[int], piece: list[int]) -> bytes:
        """Pieces from the end back to the start; unknown characters as their bytes where the model has byte pieces."""
        at, ids, spelled = len(chunk), [], self.model.bytes_at
        while at:
            if piece[at] == self.model.unknown and spelled:
                ids.extend(spelled[b] for b in reversed(chunk[begin[at]:at]))
            else:
                ids.append(piece[at])
            at = begin[at]
        ids.reverse()
        return np.array(ids, dtype="<i4").tobytes()


def encode(docs: DataFrame, model_path: str = MODEL_PATH, text: str = "text", name: str = "tokens", decodes: str | None = None) -> DataFrame:
    """``docs`` and column ``name``: the ids (array<int>) of each text's most probable segmentation.

    Each text gets the segmentation with the greatest sum of piece scores, as in unigram models; of equal sums the one
    whose last piece is longest. Spaces become whitespace markers, with one in front; characters without a piece are
    spelled by byte pieces, or are unknown where the model has none. Texts are searched whole, however long, with or without
    spaces. Null and empty texts have no ids. The model file is read by the driver and at most MODEL_BYTES are sent to executors,
    with its trie. Other columns are unchanged, repeated rows get equal ids, an empty table gives no rows. With ``decodes``, a
    boolean column of that name says whether decoding the ids gives the text again (null counting as empty, markers as spaces).
    """
    model = docs.sparkSession.sparkContext.broadcast(Encoder(Model.read(model_path)).sendable())
    added = [StructField(name, ArrayType(IntegerType())), *([StructField(decodes, BooleanType())] if decodes else [])]

    def run(batches):
        encoder = Encoder.received(model.value)
        for part in slices(batches, text):
            texts = part.column(text).to_pylist()
            ids = encoder.encode(texts)
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))]
            if decodes:
                columns.append(pa.array([encoder.decode(np.frombuffer(i, dtype="<i4").tolist()) == round_trip(t or "") for t, i in zip(texts, ids, strict=True)]))
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *(f.name for f in added)])

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, *added]))


def decode(rows: DataFrame, model_path: str = MODEL_PATH, tokens: str = "tokens", name: str = "decoded") -> DataFrame:
    """``rows`` and column ``name``: the text of the ids (null: empty). Whitespace markers become spaces, without the one in
    front; byte pieces are put together as UTF-8, replacing what is not. Ids outside the vocabulary raise IndexError."""
    made = Decoder(Model.read(model_path))
    pieces = rows.sparkSession.sparkContext.broadcast((made.texts, made.prefix))

    def run(batches):
        decoder = Decoder.__new__(Decoder)
        decoder.texts, decoder.prefix = pieces.value
        for batch in batches:
            column = batch.column(tokens)
            texts = pa.array([decoder.decode(ids.values.to_pylist() if ids.is_valid else []) for ids in column], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, name])

    return small_batches(rows).mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())]))


def round_trip(text: str) -> str:
    """What decoding gives for an encoded text: the text itself, but that a whitespace marker in it comes back as a space."""
    return text.replace(SPACE, " ")
