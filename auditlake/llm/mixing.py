"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from auditlake.llm.common import WORD, free_name, small_side
from auditlake.session import materialize

BLOCK_WORDS = 1024
MIN_BLOCKS = 256
BUCKET_ROWS = 50_000
ROUNDS = 24
#: Runs of a shard's local shuffle that are dealt to tasks: 2 to this power.
RUN_BITS = 16


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, ... ``cycle``, repeating, for sources by code point, null last. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.select("source", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("long").alias("weight"))


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """Adds ``target`` (words) to sources (source, weight, source_size): all words shared by weight, none above ``most`` times
    its source; what exceeds is shared again among the others. Only sums of the table come to the driver; they are integers,
    so the result does not depend on their order."""
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / weights if weights else 0.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("source_size") * most
        capped, free, left = sources.agg(F.sum(F.when(above, F.col("source_size") * most)), F.sum(F.when(~above, F.col("weight"))),
                                         F.count(F.when(above, 1))).first()
        raised = ((total or 0) - (capped or 0)) / free if free else level
        if not left or raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), (F.col("source_size") * most).cast("double")))


def _draw(population: str, marked: str, draws: str, dice: str) -> str:
    """SQL: hypergeometric draw by inversion, over all values within 9 standard deviations and 10 of the mode."""
    low = f"greatest(0L, {draws} - ({population} - {marked}))"
    high = f"least({marked}, {draws})"
    mode = f"CAST(floor(({marked} + 1.0D) * ({draws} + 1.0D) / ({population} + 2.0D)) AS BIGINT)"
    spread = (f"CAST(ceil(9 * sqrt({draws} * ({marked} / {population}) * (1 - {marked} / {population}) * "
              f"(({population} - {draws}) / greatest(1.0D, {population} - 1.0D)))) AS BIGINT) + 10L")
    values = f"sequence(greatest({low}, {mode} - ({spread})), greatest(greatest({low}, {mode} - ({spread})), least({high}, {mode} + {spread})))"
    ratio = (f"(({marked} - v) * 1.0D * ({draws} - v) / ((v + 1.0D) * greatest(1.0D, {population} - {marked} - {draws} + v + 1.0D)))")
    total = (f"aggregate({values}, named_struct('w', 1.0D, 's', 0.0D), "
             f"(a, v) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w)).s")
    return (f"IF({population} <= 0 OR {marked} <= 0 OR {draws} <= 0, 0L, "
            f"aggregate({values}, named_struct('w', 1.0D, 's', 0.0D, 'x', {low}, 'goal', {dice} * {total}), "
            f"(a, v) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w, 'x', IF(a.s <= a.goal, v, a.x), 'goal', a.goal)).x)")


def split_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """Splitting tree: (shard, rank, quota), the quotas of every source adding up to its ``quota`` exactly.

    A node holds the block quotas of all sources. Its left child gets half of its blocks, drawn without replacement: one
    hypergeometric draw after the other, each given what the earlier ones left. The right child gets the rest. The tree
    has one row per node; sources are rows of the weights table, a setting, and not data. ``shards`` is a power of two.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    tree = sources.agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("q")).where("size(q) > 0").selectExpr(
        "1L AS node", "transform(q, x -> x.rank) AS ranks", "transform(q, x -> x.quota) AS quotas")
    dice = f"(pmod(xxhash64(node, size(acc.taken), {seed}), 9007199254740992L) / 9007199254740992.0D)"
    draw = _draw("acc.n", "q", "acc.k", dice)
    step = (f"transform(array({draw}), d -> named_struct('n', acc.n - q, 'k', acc.k - d, 'taken', concat(acc.taken, array(d))))[0]")
    fold = (f"aggregate(quotas, named_struct('n', aggregate(quotas, 0L, (s, x) -> s + x), 'k', aggregate(quotas, 0L, (s, x) -> s + x) div 2, "
            f"'taken', CAST(array() AS ARRAY<BIGINT>)), (acc, q) -> {step}).taken")
    for _ in range(shards.bit_length() - 1):
        tree = tree.selectExpr("node", "ranks", "quotas", f"{fold} AS taken").selectExpr(
            "ranks", "inline(array(named_struct('node', 2 * node, 'quotas', taken), "
            "named_struct('node', 2 * node + 1, 'quotas', zip_with(quotas, taken, (a, b) -> a - b))))")
    return tree.selectExpr(f"CAST(node - {shards} AS INT) AS shard", "inline(arrays_zip(ranks, quotas))").toDF("shard", "rank", "quota")


def _place(block: str, epoch: str, rank: str, blocks: str, seed: str) -> str:
    """SQL: place of a block in the epoch's permutation of its source's blocks (swap-or-not shuffle, a bijection)."""
    partner = f"pmod(pmod(xxhash64({rank}, {epoch}, r, {seed}), {blocks}) - x, {blocks})"
    return (f"aggregate(sequence(0, {ROUNDS - 1}), {block}, (x, r) -> "
            f"IF((xxhash64(greatest(x, {partner}), {rank}, {epoch}, r, {seed}) & 1L) = 1L, {partner}, x))")


def plan(docs: DataFrame, weights=ranked_weights, most: int = 3, shards: int = 16, seed: int = 11) -> DataFrame:
    """``docs`` with what the mix takes of each row: columns size, source_size, target and pieces, all free of name clashes.

    ``docs`` needs doc_id, source and a long column ``size`` (words). ``weights`` maps a table (source, source_size) to
    (source, weight). The words of a source, its rows in a seeded order, are cut into blocks of equal length; a source's
    quota is the number of block draws nearest to its target. Every block is drawn once per full round over the source,
    and the rest are the first blocks of a permutation. Draws are numbered through all rounds, and output shard k takes
    the run of draws that the splitting tree gave it, so shards draw disjoint blocks. ``pieces`` lists (epoch, shard, turn,
    first, n): words first to first + n - 1 of the row, and the piece's turn in the local shuffle of its shard. No word is
    taken more than ``most`` times.

    Running positions are added up in buckets of about 50,000 rows, so a source with a third of all rows is spread.
    Sizes of 0 take nothing; a null source is a source; repeated rows are rows of their own. Empty tables give no rows.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sizes = materialize(sizes, "sources")
    given = weights(sizes.select("source", "source_size"))
    sources = sizes.join(given.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = targets(materialize(sources.withColumn("rank", F.row_number().over(order)), "weights"), most)
    sources = sources.selectExpr(
        "*", f"greatest(1L, least({BLOCK_WORDS}L, source_size div {MIN_BLOCKS})) AS block_words").selectExpr(
        "*", "(source_size + block_words - 1) div block_words AS blocks").selectExpr(
        "*", f"IF(source_size = 0, 0L, least({most} * blocks, CAST(round(target / nullif(source_size, 0) * blocks) AS BIGINT))) AS quota",
        f"CAST((rows + {BUCKET_ROWS} - 1) div {BUCKET_ROWS} AS BIGINT) AS buckets", f"{seed} AS seed")
    sources = materialize(sources, "quotas")
    parts = materialize(split_quotas(sources, shards, seed), "shards")
    cuts = parts.withColumn("upto", F.sum("quota").over(Window.partitionBy("rank").orderBy("shard")))
    cuts = cuts.groupBy("rank").agg(F.sort_array(F.collect_list("upto")).alias("cuts"))
    sources = materialize(sources.join(cuts, "rank").drop("rows", "weight"), "mix")

    names = {c: free_name(docs, "mix_" + c) for c in sources.columns}
    side = small_side(sources.withColumnsRenamed(names), F.lit(200 + 16 * shards))
    rows = docs.join(side, docs["source"].eqNullSafe(side[names["source"]])).drop(names["source"])
    bucket, begin, before = (free_name(docs, "mix_" + c) for c in ("bucket", "begin", "before"))
    rows = rows.withColumn(bucket, F.expr(f"pmod(xxhash64(doc_id, {seed} + 1), {names['buckets']})"))
    key = [names["rank"], bucket]
    # sums per bucket come from the narrow columns alone and are as few as the buckets
    narrow = rows.select(*key, "size").groupBy(*key).agg(F.sum("size").alias("words"))
    offsets = narrow.withColumn(before, F.sum("words").over(Window.partitionBy(names["rank"]).orderBy(bucket)) - F.col("words")).drop("words")
    offsets = small_side(materialize(offsets, "bucket-offsets"), F.lit(48))
    within = Window.partitionBy(*key).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(begin, F.sum("size").over(within) - F.col("size")).join(offsets, key)

    inputs = ", ".join(f"'{c}', {names[c]}" for c in ("rank", "blocks", "block_words", "quota", "cuts", "seed"))
    state = free_name(docs, "mix_state")
    rows = rows.withColumn(state, F.expr(f"named_struct({inputs}, 'at', {before} + {begin})"))
    m = {c: f"{state}.{c}" for c in ("rank", "blocks", "block_words", "quota", "cuts", "seed", "at")}
    draw = f"(e * {m['blocks']} + {_place('b', 'e', m['rank'], m['blocks'], m['seed'])})"
    piece = (f"transform(sequence({m['at']} div {m['block_words']}, ({m['at']} + size - 1) div {m['block_words']}), b -> "
             f"transform(array({draw}), p -> named_struct('epoch', CAST(e AS INT), 'draw', p, "
             f"'first', greatest({m['at']}, b * {m['block_words']}) - {m['at']}, "
             f"'n', least({m['at']} + size, (b + 1) * {m['block_words']}) - greatest({m['at']}, b * {m['block_words']})))[0])")
    pieces = (f"IF(size = 0 OR {m['quota']} = 0, array(), filter(flatten(transform(sequence(0L, ({m['quota']} - 1) div {m['blocks']}), e -> {piece})), "
              f"x -> x.draw < {m['quota']}))")
    shown = (f"transform({pieces}, x -> named_struct('epoch', x.epoch, 'shard', size(filter({m['cuts']}, c -> c <= x.draw)), "
             f"'turn', xxhash64(x.draw, {m['rank']}, {m['seed']}), 'first', x.first, 'n', x.n))")
    extra = {c: free_name(docs, c) for c in ("source_size", "target", "pieces")}
    return rows.select(*docs.columns, F.col(names["source_size"]).alias(extra["source_size"]), F.col(names["target"]).alias(extra["target"]),
                       F.expr(shown).alias(extra["pieces"]))


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    sizes = materialize(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    return plan(sizes, **options).selectExpr("doc_id", "size", "source_size", "target", "aggregate(pieces, 0L, (s, p) -> s + p.n) AS taken")


def mix(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row per document and round that takes words of it.

    A row whose words are all taken keeps its text; otherwise its text is the taken words, joined by one space. Rows lie in
    the order of the local shuffle of the output shard that takes their first piece. ``n_chars`` follows a changed text.
    """
    size, text = free_name(docs, "size"), "text"
    if size != "size":  # plan() reads a column of that name: put the caller's aside
        docs = docs.withColumnRenamed("size", size)
    rows = plan(docs.withColumn("size", word_count()), shards=shards, **options)
    pieces = rows.columns[-1]
    taken, round_, part, words = (free_name(rows, c) for c in ("mix_taken", "mix_round", "mix_part", "mix_words"))
    rows = rows.withColumn(round_, F.explode(F.expr(f"array_distinct(transform({pieces}, p -> p.epoch))")))
    rows = rows.withColumn(part, F.expr(f"array_sort(filter({pieces}, p -> p.epoch = {round_}), (a, b) -> IF(a.first < b.first, -1, 1))"))
    rows = rows.withColumn(taken, F.expr(f"aggregate({part}, 0L, (s, p) -> s + p.n)"))
    some = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    rows = rows.withColumn(words, F.when(F.col(taken) < F.col("size"), some))
    cut = f"array_join(flatten(transform({part}, p -> slice({words}, CAST(p.first AS INT) + 1, CAST(p.n AS INT)))), ' ')"
    rows = rows.withColumn(text, F.expr(f"IF({words} IS NULL, {text}, {cut})"))
    shard, turn = free_name(rows, "mix_shard"), free_name(rows, "mix_turn")
    rows = rows.withColumn(shard, F.expr(f"{part}[0].shard")).withColumn(turn, F.expr(f"{part}[0].turn"))
    # turns are hashes, so their leading bits cut a shard's shuffle into even runs: as many tasks as the session has shuffle partitions
    rows = rows.repartition(F.col(shard), F.shiftright(turn, 64 - RUN_BITS)).sortWithinPartitions(shard, turn)
    back = {size: "size"} if size != "size" else {}
    return rows.select(*[(F.when(F.col(words).isNull(), F.col(c)).otherwise(F.length(text).cast(docs.schema[c].dataType)).alias(c) if c == "n_chars"
                          else F.col(c).alias(back.get(c, c))) for c in docs.columns])
