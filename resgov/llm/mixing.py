"""Mixing sources to target weights: pivotal dependent rounding, native.

Every document of a source is due the same fraction of copies,
target / source size.  Whole copies are certain; the fractions left over are
rounded dependently: two documents are paired, and mass (in words) moves from
one to the other, in a random direction with odds that keep both expectations,
until one of them is integral; the other goes on.  Words due are the same
before and after each step, so a source's taken words end within one document
of its target; documents of the last fold then make up for that one.  Blocks of a few hundred documents are settled each by one
fold, their residuals are regrouped and settled in turn: a reduction tree
whose depth is the logarithm of the largest source, split over all tasks.

Randomness is a hash of the two documents and the seed, so reruns agree.
Everything is DataFrame and SQL functions.

Defined results: null text has size 0 and takes 0; a null source is a source
of its own, ordered last; repeated rows share their copies evenly; an empty
table gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import free_name, prepared, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BLOCK = 200
RANK_PARTS = 64
NUMBERS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Add rank (0, 1, ...) by code point of source, null last, without one task sorting all."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = written(sources.repartitionByRange(RANK_PARTS, *order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "part").withColumn("rank", (F.col("offset") + within - 1).cast("long")).drop("part", "offset")


def with_targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add rank and target to (source, source_size, ...): water filling under caps of most * source_size."""
    marked = written(ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")), "weights")
    cap = F.col("source_size") * F.lit(float(most))
    total = float(marked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, last = 0.0, -1.0
    while level != last:  # each pass caps at least one source more, or is the last
        last = level
        under = ~(cap <= F.col("weight") * F.lit(level))
        due, weight = marked.agg(F.sum(F.when(~under, cap)), F.sum(F.when(under, F.col("weight")))).first()
        level = (total - (due or 0.0)) / weight if weight else last
    return marked.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def settled_blocks(items: DataFrame, level: int, seed: int, block: Column) -> DataFrame:
    """One fold a block of (rank, doc_id, a, p), largest a first: its settled items and the one item left over."""
    grouped = (items.withColumn("block", block).groupBy("rank", "block")
               .agg(F.sort_array(F.collect_list(F.struct((-F.col("a")).alias("first"), F.xxhash64("doc_id", "a", F.lit(seed + level)).alias("h"), "doc_id", "a", "p"))).alias("items")))
    draw = f"(shiftrightunsigned(xxhash64(s.doc_id, s.a, x.doc_id, x.a, {seed}), 11) / 9007199254740992D)"
    up, down = "least((1 - s.p) * s.a, x.p * x.a)", "least(s.p * s.a, (1 - x.p) * x.a)"

    def step(keep: str, p: str, out: str, copy: int) -> str:
        return (f"named_struct('doc_id', {keep}.doc_id, 'a', {keep}.a, 'p', greatest(0D, least(1D, {p})), "
                f"'done', array_append(s.done, named_struct('doc_id', {out}.doc_id, 'a', {out}.a, 'copy', {copy})))")

    fold = f"""aggregate(slice(items, 2, size(items)),
        named_struct('doc_id', items[0].doc_id, 'a', items[0].a, 'p', items[0].p, 'done', cast(array() as array<struct<doc_id: bigint, a: bigint, copy: int>>)),
        (s, x) -> CASE
          WHEN {draw} * ({up} + {down}) < {down} THEN
            CASE WHEN (1 - s.p) * s.a <= x.p * x.a THEN {step('x', f'x.p - {up} / x.a', 's', 1)}
                 ELSE {step('s', f's.p + {up} / s.a', 'x', 0)} END
          WHEN s.p * s.a <= (1 - x.p) * x.a THEN {step('x', f'x.p + {down} / x.a', 's', 0)}
          ELSE {step('s', f's.p - {down} / s.a', 'x', 1)} END)"""
    return grouped.select("rank", F.expr(fold).alias("r"))


def trimmed(blocks: DataFrame, seed: int) -> DataFrame:
    """(rank, doc_id, a, copy) of each source's last fold.

    Its one item left over is drawn by its probability, which may leave the source
    a large document off its target.  Settled documents of the fold, largest first,
    then change sides wherever that brings the words taken nearer to the target.
    """
    last = F.expr(f"if(shiftrightunsigned(xxhash64(r.doc_id, r.a, {seed}), 11) / 9007199254740992D < r.p, 1, 0)")
    ordered = F.expr("sort_array(transform(r.done, d -> named_struct('less', -d.a, 'doc_id', d.doc_id, 'a', d.a, 'copy', d.copy)))")
    fold = """aggregate(ordered, named_struct('off', (copy - r.p) * r.a, 'done', cast(array() as array<struct<doc_id: bigint, a: bigint, copy: int>>)),
        (s, x) -> named_struct(
          'off', CASE WHEN abs(s.off + (1 - 2 * x.copy) * x.a) < abs(s.off) THEN s.off + (1 - 2 * x.copy) * x.a ELSE s.off END,
          'done', array_append(s.done, named_struct('doc_id', x.doc_id, 'a', x.a,
            'copy', CASE WHEN abs(s.off + (1 - 2 * x.copy) * x.a) < abs(s.off) THEN 1 - x.copy ELSE x.copy END))))"""
    whole = blocks.withColumns({"copy": last, "ordered": ordered}).withColumn("t", F.expr(fold))
    one = F.struct(F.col("r.doc_id").alias("doc_id"), F.col("r.a").alias("a"), F.col("copy").alias("copy"))
    return whole.select("rank", F.explode(F.array_append("t.done", one)).alias("d")).select("rank", "d.doc_id", "d.a", "d.copy")


def rounded(items: DataFrame, seed: int) -> DataFrame:
    """(rank, doc_id, a, copy): each item (rank, doc_id, a, p), 0 < p < 1, rounded to 0 or 1.

    A large document is left over by its block, as small ones turn integral
    first.  So one block of each large source is held back: in the last fold
    the residuals meet these documents, largest first, and the item that is
    rounded alone in the end tends to be small.
    """
    def counted(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("rank").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "rank")

    def place(level: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", "a", F.lit(seed + 101 * level)), F.col("blocks"))

    columns = ["rank", "doc_id", "a", "p"]
    rest = written(counted(items).withColumn("place", place(0)), "due")
    last, done, level = [rest.where("blocks = 1 or place = 0").select(columns)], [], 1
    rest = written(counted(rest.where("blocks > 1 and place > 0").select(columns)), "open")
    while rest.limit(1).count():
        last.append(rest.where("blocks = 1").select(columns))
        blocks = written(settled_blocks(rest.where("blocks > 1"), level, seed, place(level)), "blocks")
        done.append(blocks.select("rank", F.explode("r.done").alias("d")).select("rank", "d.doc_id", "d.a", "d.copy"))
        rest = written(counted(blocks.select("rank", "r.doc_id", "r.a", "r.p")), "open")
        level += 1
    pool = last[0]
    for part in last[1:]:
        pool = pool.unionByName(part)
    blocks = written(settled_blocks(pool, level, seed, F.lit(0)), "blocks")
    out = trimmed(blocks, seed)
    for part in done:
        out = out.unionByName(part)
    return out


def shares(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """Per distinct (doc_id, source, size): source_size, target, rows (how many there are) and all (the copies they share)."""
    prepared(docs.sparkSession)
    units = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = written(with_targets(sources, share, most, weights), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    due = units.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("due", rate * F.col("rows")).drop("of")
    due = due.withColumn("whole", F.floor("due")).withColumn("p", F.col("due") - F.col("whole"))
    open_items = due.where("size > 0 and p > 0").select("rank", "doc_id", F.col("size").alias("a"), "p")
    extra = rounded(open_items, seed).withColumnRenamed("rank", "of").withColumnRenamed("doc_id", "id")
    joined = due.join(extra, (F.col("rank") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("a")), "left")
    total = (F.when(F.col("size") > 0, F.col("whole") + F.coalesce("copy", F.lit(0))).otherwise(F.lit(0))).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", "rows", total.alias("all"))


def copies_of(nth: Column) -> Column:
    """Copies of the nth (from 1) of ``rows`` equal rows that share ``all`` copies evenly."""
    return (F.floor(F.col("all") / F.col("rows")) + (nth <= F.col("all") % F.col("rows")).cast("long")).cast("long")


def numbered(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Each row once for 1, 2, ... ``count``, in steps of NUMBERS so that no array grows with the count."""
    step = free_name("step", rows.columns)
    runs = rows.withColumn(step, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / NUMBERS))))
    first, last = F.col(step) * NUMBERS + 1, F.least(F.col(count), (F.col(step) + 1) * NUMBERS)
    return runs.withColumn(name, F.explode(F.sequence(first, last))).drop(step)


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """Per document row: doc_id, source, size, source_size, target, nth (among repeats of the row), copies."""
    rows = numbered(shares(docs, share, most, weights, seed), "rows", "nth")
    return rows.select("doc_id", "source", "size", "source_size", "target", "nth", copies_of(F.col("nth")).alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (no words: as it is due, never).

    The row travels as one struct, so its columns may have any names.  Equal rows need numbers only where their copies
    do not come out even; they are numbered within the partitions of a written table, after those of the partitions
    before, so that no task holds all repeats.
    """
    plan = shares(docs, **options).where("all > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("words"), "rows", "all")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc"), F.col("source").alias("src"), word_count(F.col("text")).alias("n"))
    same = F.col("doc").eqNullSafe(F.col("id")) & F.col("src").eqNullSafe(F.col("of")) & (F.col("n") == F.col("words"))
    met = held.join(plan, same).drop("id", "of", "words")
    even = met.where("all % rows = 0").withColumn("copies", F.expr("all div rows"))
    odd = written(met.where("all % rows > 0").withColumn("at", F.monotonically_increasing_id()), "repeats").withColumn("part", F.shiftright("at", 33))
    group = ["doc", "src", "n"]
    parts = odd.groupBy(*group, "part").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(*[F.col(c).alias(f"{c}_") for c in group], F.col("part").alias("part_"), before.alias("before"))
    alike = F.col("part") == F.col("part_")
    for c in group:
        alike = alike & F.col(c).eqNullSafe(F.col(f"{c}_"))
    nth = F.row_number().over(Window.partitionBy(*group, "part").orderBy("at")) + F.col("before")
    uneven = odd.join(offsets, alike).withColumn("copies", copies_of(nth))
    taken = even.select("row", "copies").unionByName(uneven.select("row", "copies")).where("copies > 0")
    return numbered(taken, "copies", "copy").select("row.*")
