"""Embedding near-duplicates: inverted lists, product-quantised residuals, exact cosine rerank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditlake.llm.common import Sent, components, small_side
from auditlake.session import materialize

#: Vectors the model is fitted on at most; it holds at most MAX_LISTS centroids. Both bound what is collected and broadcast.
SAMPLE = 16_384
MAX_LISTS = 4_096
SUBSPACES, CODES = 8, 64
#: Vectors of one list, and queries to it, that one task compares at a time.
TILE = 3_000
#: Levels of a component in a sketch, which has two components to a byte.
LEVELS = 16


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centers**2).sum(1) - 2 * (part @ centers.T), axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    dice = np.random.default_rng(3)
    centers = x[dice.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = _nearest(x, centers)
        count = np.bincount(home, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def _sketches(x: np.ndarray) -> list[bytes]:
    """Of unit vectors: step and length of the rounding error in single precision, then the components' levels."""
    step = (np.abs(x).max(axis=1) / (LEVELS / 2)).astype("<f4")
    level = np.clip(np.floor(x / step[:, None].astype(np.float64)) + LEVELS / 2, 0, LEVELS - 1).astype(np.uint8)
    blur = np.linalg.norm(x - (level - (LEVELS - 1) / 2) * step[:, None].astype(np.float64), axis=1)
    blur = np.nextafter(blur.astype("<f4"), np.float32(np.inf))
    level = np.pad(level, ((0, 0), (0, level.shape[1] % 2)))
    packed = level[:, ::2] | level[:, 1::2] << 4
    return [a.tobytes() + b.tobytes() + c.tobytes() for a, b, c in zip(step, blur, packed, strict=True)]


def _unsketched(column, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(rounded vectors, how far the true ones are from them at most)."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    step, blur = np.ascontiguousarray(raw[:, :8]).view("<f4").T
    level = np.stack([raw[:, 8:] & 15, raw[:, 8:] >> 4], axis=2).reshape(len(raw), -1)[:, :dimensions]
    return (level - np.float32((LEVELS - 1) / 2)) * step[:, None], blur


class Quantiser:
    """Coarse centroids, a codebook per subspace of the residuals, and how far past a border lists are probed."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float):
        x = _unit(sample)
        self.radius = radius
        self.centers = np.unique(_kmeans(x, max(1, min(lists, MAX_LISTS, len(x) // 8 or 1))), axis=0)
        self.parts = [p for p in np.array_split(np.arange(x.shape[1]), SUBSPACES) if len(p)]
        residual = x - self.centers[_nearest(x, self.centers)]
        self.books = [_kmeans(residual[:, p], CODES) for p in self.parts]
        # The distances of two vectors in different lists to the border between these add up to at most their own distance:
        # one of a pair within the radius lies within half of it, whatever the data, and finds the other.
        self.slack = radius / 2

    def assign(self, x: np.ndarray):
        """(home list, lists to probe, codes, length of the quantisation error) of unit vectors."""
        square = (x**2).sum(1)[:, None] + (self.centers**2).sum(1) - 2 * (x @ self.centers.T)
        home = square.argmin(axis=1)
        own, length = self.centers[home], (self.centers**2).sum(1)
        gap = np.sqrt(np.maximum(0, length[home][:, None] + length - 2 * (own @ self.centers.T)))
        # distance to the border, times twice the gap, which rounding may have changed where centroids nearly coincide
        reached = square - square[np.arange(len(x)), home][:, None] <= 2 * self.slack * (gap + 1e-7) + 1e-12
        reached[np.arange(len(x)), home] = True
        residual = x - self.centers[home]
        codes = np.stack([_nearest(residual[:, p], book) for p, book in zip(self.parts, self.books, strict=True)], axis=1)
        error = residual - np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)
        return home, [np.flatnonzero(row) for row in reached], codes.astype(np.uint8), np.linalg.norm(error, axis=1)

    def possible(self, queries: np.ndarray, home: int, codes: np.ndarray, errors: np.ndarray, blur=0.0) -> np.ndarray:
        """Whether (entry, query) may be within the radius by the table-lookup distance; ``blur`` is the queries' own error."""
        residual = queries - self.centers[home]
        total = np.zeros((len(codes), len(queries)), dtype=np.float32)
        for s, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            table = (residual[:, p]**2).sum(1) + (book**2).sum(1)[:, None] - 2 * (book @ residual[:, p].T)
            total += table.astype(np.float32)[codes[:, s]]
        # the triangle inequality bounds the true distance from below by the looked-up one less the errors
        bound = self.radius + errors[:, None] + np.broadcast_to(blur, len(queries)) + 1e-4
        return total <= (bound * bound).astype(np.float32)

    def candidates(self, queries: np.ndarray, home: int, codes: np.ndarray, errors: np.ndarray):
        """Pairs (query, entry) whose table-lookup distance leaves a true distance within the radius possible."""
        return np.nonzero(self.possible(queries, home, codes, errors).T)


class Models:
    """A quantiser per dimension; the lists of all are numbered through."""

    def __init__(self, models: list[Quantiser]):
        self.models = models
        self.first = np.cumsum([0, *(len(m.centers) for m in models)])
        self.of = {m.centers.shape[1]: k for k, m in enumerate(models)}

    def assign(self, vectors: list[np.ndarray]):
        """Per vector: home list, lists to probe, codes, length of the quantisation error, sketch."""
        out: list = [None] * len(vectors)
        sizes = np.array([len(v) for v in vectors])
        for d in np.unique(sizes):
            at, k = np.flatnonzero(sizes == d), self.of[int(d)]
            x = _unit(np.stack([vectors[i] for i in at]))
            home, probes, codes, error = self.models[k].assign(x)
            for i, *row in zip(at, home, probes, codes, error, _sketches(x), strict=True):
                out[i] = (row[0] + self.first[k], row[1] + self.first[k], *row[2:])
        return list(zip(*out, strict=True))

    def list(self, number: int) -> tuple[Quantiser, int, int]:
        """(quantiser, list in it, number of its first list) of a list."""
        k = int(np.searchsorted(self.first, number, side="right")) - 1
        return self.models[k], int(number - self.first[k]), int(self.first[k])


def _floats(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)


def _codes(entries: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(entries.column("codes").to_pylist()), dtype=np.uint8).reshape(len(entries), -1)


def _screen(models: Models, queries: pa.Table, entries: pa.Table) -> pa.Table:
    """The queries and entries of one tile that look-up and sketches leave a partner: id, asks, and the tile."""
    tile = {k: (queries if len(queries) else entries).column(k)[0].as_py() for k in ("home", "part", "turn")}
    asks, answers = np.zeros(len(queries), dtype=bool), np.zeros(len(entries), dtype=bool)
    ids, mates = queries.column("asker").to_numpy(), entries.column("rep").to_numpy()
    if len(ids) and len(mates):
        model, home, _ = models.list(tile["home"])
        inside = queries.column("own").to_numpy() == tile["home"]
        (q, q_blur), (e, e_blur) = (_unsketched(c, model.centers.shape[1]) for c in (queries.column("asked"), entries.column("sketch")))
        codes, errors, length = _codes(entries), entries.column("error").to_numpy(), (e**2).sum(1)[:, None]
        for at in range(0, len(q), 500):
            part, blur = q[at:at + 500], q_blur[at:at + 500]
            near = model.possible(part, home, codes, errors, blur)
            if near.any():
                reach = np.float32(model.radius + 1e-3) + e_blur[:, None] + blur
                near &= length + (part**2).sum(1) - 2 * (e @ part.T) <= reach * reach
                # of a pair in one list, the smaller id asks
                near &= np.where(inside[at:at + 500], ids[at:at + 500] < mates[:, None], True)
                asks[at:at + 500] = near.any(axis=0)
                answers |= near.any(axis=1)
    found = np.r_[ids[asks], mates[answers]]
    return pa.table({"id": pa.array(found, pa.int64()), "asks": pa.array(np.arange(len(found)) < asks.sum()),
                     **{k: pa.array(np.full(len(found), v, dtype=np.int32)) for k, v in tile.items()}})


def _tile(models: Models, threshold: float, kind: str, queries: pa.Table, entries: pa.Table) -> pa.Table:
    """Links of one tile, summed: per vector the linked rows, and a spanning forest of the links.

    A pair counts for both its ends in one tile: where either would find the other, in that in which the smaller id asks."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    if not len(queries) or not len(entries):
        return none
    model, home, first = models.list(entries.column("home")[0].as_py())
    q, e = _floats(queries.column("asked"), kind), _floats(entries.column("vector"), kind)
    uq, ue = _unit(q), _unit(e)
    codes, errors = _codes(entries), entries.column("error").to_numpy()
    ids, mates, own = queries.column("id").to_numpy(), entries.column("rep").to_numpy(), queries.column("own").to_numpy() - first
    probes = entries.column("probes").combine_chunks()
    asks_back = np.zeros((len(e), len(model.centers)), dtype=bool)
    asks_back[np.repeat(np.arange(len(e)), probes.value_lengths().to_numpy()), probes.flatten().to_numpy() - first] = True
    sizes = queries.column("asker_n").to_numpy(), entries.column("n").to_numpy()
    counts = np.zeros(len(q), dtype=np.int64), np.zeros(len(e), dtype=np.int64)
    left, right = [], []
    for at in range(0, len(q), 500):
        i, j = model.candidates(uq[at:at + 500], home, codes, errors)
        i = i + at
        keep = (ids[i] < mates[j]) | ((ids[i] > mates[j]) & ~asks_back[j, own[i]])
        i, j = i[keep], j[keep]
        cosine = np.concatenate([np.einsum("ij,ij->i", uq[a], ue[b]) for a, b in zip(np.array_split(i, len(i) // 65536 + 1), np.array_split(j, len(i) // 65536 + 1), strict=True)])
        i, j = i[cosine >= threshold], j[cosine >= threshold]
        np.add.at(counts[0], i, sizes[1][j])
        np.add.at(counts[1], j, sizes[0][i])
        left.append(ids[i])
        right.append(mates[j])
    left, right = np.concatenate(left), np.concatenate(right)
    kept = _forest(left, right)
    ends, linked = np.r_[ids, mates], np.concatenate(counts)
    some = np.flatnonzero(linked)
    return pa.table({"a": pa.array(np.r_[ends[some], left[kept]]), "b": pa.array([None] * len(some) + right[kept].tolist(), pa.int64()),
                     "n": pa.array(linked[some].tolist() + [None] * len(kept), pa.int64())})


def _forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    root: dict[int, int] = {}
    kept = []
    for i, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        while root.setdefault(y, y) != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def link_vectors(vectors: DataFrame, threshold: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors link at a cosine of ``threshold`` or more, in double precision; n_links counts the other rows linked
    directly, component_id is the smallest vec_id reachable by links, and kept says that it is the row's own.

    Equal vectors are one class that is searched once. Classes go to inverted lists around centroids fitted on at most
    ``sample`` of them (all are indexed); residuals are product-quantised. A class probes every list whose border is
    within half of a near-duplicate's distance, so one of each pair finds the other whatever the sample holds. Probed lists
    get sketches of half a byte a component; distances are looked up in tables, and only classes that look-up and sketches
    leave a partner are sent whole and reranked by the exact cosine. Lists and their queries are cut into tiles of about
    TILE by TILE, so a list with a third of all rows is many tasks; a tile returns sums per vector and a spanning forest,
    never all its pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and neither do rows
    without vec_id. Only vectors of one dimension link; each dimension has lists of its own, with its share of the sample.
    Repeated rows are vectors of their own. Further columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sound = ("vec_id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) "
             "AND exists(v, x -> x <> 0)")
    good = rows.where(F.coalesce(F.expr(sound), F.lit(False)))
    classes = materialize(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    sizes = {r.d: r.n for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # in the order of a hash, so dimensions have about their shares; the sample decides how lists are cut, not what links
    fit = classes.select("v").orderBy(F.xxhash64("rep"), "rep").limit(sample).toPandas()["v"]
    radius = float(np.sqrt(2 - 2 * threshold)) if threshold < 1 else 1e-6
    samples: dict[int, list] = {d: [] for d in sorted(sizes)}
    for v in fit:
        samples[len(v)].append(v)
    lists = {d: min(int(np.sqrt(n)), max(1, MAX_LISTS * n // sum(sizes.values()))) for d, n in sizes.items()}
    model = Models([Quantiser(np.stack(part or [np.eye(1, d)[0]]), lists[d], radius) for d, part in samples.items()])
    # single-precision components travel as such and are exact in double precision, too
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    shared = Sent(vectors.sparkSession, model)

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                column = part.column("v")
                flat = np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy())[:-1])
                home, probes, codes, error, sketches = shared.value.assign(flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("n"), pa.array([r.astype(kind).tobytes() for r in flat], pa.binary()),
                     pa.array(sketches, pa.binary()), pa.array(home, pa.int32()),
                     pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                    names=["rep", "n", "vector", "sketch", "home", "probes", "codes", "error"])

    # spread first: comparing with all centroids is the work of this step, and the classes may lie in a few small files
    spread = classes.repartition(classes.sparkSession.sparkContext.defaultParallelism, "rep")
    placed = materialize(spread.mapInArrow(assign, "rep long, n long, vector binary, sketch binary, home int, probes array<int>, codes binary, error double"), "vector-lists")
    entries = placed.select("rep", "sketch", "home", "codes", "error")
    queries = placed.select(F.col("rep").alias("asker"), F.col("home").alias("own"), F.col("sketch").alias("asked"), F.explode("probes").alias("home"))
    tiles = placed.groupBy("home").agg(F.expr(f"CAST(ceil(count(*) / {TILE}) AS INT)").alias("parts")).join(
        queries.groupBy("home").agg(F.expr(f"CAST(ceil(count(*) / {TILE}) AS INT)").alias("turns")), "home")
    tiles = small_side(materialize(tiles, "tiles"), F.lit(48))  # at most MAX_LISTS rows
    entries = entries.join(tiles, "home").select(
        "*", F.expr("CAST(pmod(xxhash64(rep), parts) AS INT)").alias("part"), F.explode(F.expr("sequence(0, turns - 1)")).alias("turn"))
    queries = queries.join(tiles, "home").select(
        "*", F.expr("CAST(pmod(xxhash64(asker), turns) AS INT)").alias("turn"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    key = ["home", "part", "turn"]
    hits = queries.drop("parts", "turns").groupBy(*key).cogroup(entries.drop("parts", "turns").groupBy(*key)).applyInArrow(
        lambda q, e: _screen(shared.value, q, e), "id long, asks boolean, home int, part int, turn int")
    hits = materialize(hits, "tile-hits")
    asked = hits.where("asks").drop("asks").join(placed.select(
        F.col("rep").alias("id"), F.col("home").alias("own"), F.col("vector").alias("asked"), F.col("n").alias("asker_n")), "id")
    answers = hits.where("NOT asks").select(F.col("id").alias("rep"), *[F.col(k).alias(k) for k in key]).join(
        placed.select("rep", "vector", "n", "probes", "codes", "error"), "rep")
    found = asked.groupBy(*key).cogroup(answers.groupBy(*key)).applyInArrow(
        lambda q, e: _tile(shared.value, threshold, kind, q, e), "a long, b long, n long")
    found = materialize(found, "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    facts = classes.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        F.col("v").alias("of"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.join(facts, (F.col("v") == F.col("of")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
