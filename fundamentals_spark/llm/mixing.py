"""Mixing sources to target weights, with DataFrame functions only.

The words of each source are laid end to end and packed into blocks of a fixed length. The output is a row of shards; each
shard draws its counts by source from a multinomial. A source's slots, numbered through all shards, go through a
pseudorandom permutation of its block numbers, one permutation for each pass over the source, and blocks are joined by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundamentals_spark.llm.common import WORD, materialize

BLOCK_WORDS = 512
SHARD_SLOTS = 1024
ROUNDS = 16
#: Each of the two levels of the running sum deals a source's rows to this many parts.
FAN = 256
#: A table of sources is broadcast up to so many rows (about 1 MB); beyond that the joins shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """Targets of sources from (source, source_size): weights 1, 2, 3 repeating by code point, null last.

    The targets share 100 % of all sizes by weight; a target stops at ``cap`` times its source's size and the excess goes
    to the others by weight until none is above. Water filling in closed form: in order of cap over weight, the level for
    those not yet capped is (all - caps so far) / (weights left). One row per source passes through one task.
    """
    total = W.partitionBy()
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    t = sizes.withColumn("w", (F.lit(1) + (rank - 1) % 3).cast("double"))
    t = t.withColumns({"all": F.sum("source_size").over(total).cast("double"), "top": F.col("source_size") * F.lit(cap)})
    order = W.orderBy((F.col("top") / F.col("w")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumns({"caps": F.coalesce(F.sum("top").over(before), F.lit(0.0)), "left": F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))})
    t = t.withColumn("level", (F.col("all") - F.col("caps")) / F.col("left"))
    t = t.withColumn("full", F.max((F.col("level") * F.col("w") < F.col("top")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) == 0)
    level = F.max(F.when(~F.col("full"), F.struct(-F.col("caps"), F.col("level")))).over(total)["level"]
    return t.withColumn("target", F.when(F.col("full"), F.col("top")).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("w"))).select("source", "source_size", "w", "target")


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Swap-or-not shuffle: a pseudorandom permutation of 0 .. n-1 for any n, as one Column."""

    def step(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - acc, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(acc, other)), F.lit(2)) == 1, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def _beside(small: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(small) if few else small


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17, cap: float = 3.0) -> DataFrame:
    """Per row: id_col, size, source_size, target, taken (words the mix takes, repeats counted).

    A null text has size 0 and a null source is a source of its own, last in order. Rows of size 0 take nothing. Repeated
    rows are documents of their own. Each source takes its target rounded to whole words: whole passes over its
    permuted blocks, then a last pass that ends inside a block. So no row exceeds ``ceil(cap)`` times its size, and the
    result depends on the rows and the seed alone. An empty table gives an empty table.
    """
    mixed = _mixed(df, id_col, text_col, source_col, block_words, shard_slots, seed, cap)
    return mixed.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken")


def slot_plan(targets: DataFrame, block_words: int, shard_slots: int, seed: int, few: bool = True) -> DataFrame:
    """Slots of the mix: (source, k, pass, block, words before it in its pass), from the multinomial draws of all shards.

    Shards draw with the targets as probabilities. A source whose draws pass its quota is cut there, in shard order; what
    is then missing goes to a closing shard, so that quotas hold exactly.
    """
    s = targets.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    s = s.withColumns({"quota": F.round("target").cast("long"), "last_words": F.col("source_size") - (F.col("blocks") - 1) * block_words})
    s = s.withColumn("passes", F.floor(F.col("quota") / F.col("source_size")).cast("long"))
    # words beyond whole passes; the slots for them are counted as if all blocks were whole, plus one for the short block
    s = s.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    s = s.withColumn("need", F.col("passes") * F.col("blocks") + F.least(F.col("blocks"), F.when(F.col("rest") > 0, F.ceil(F.col("rest") / block_words) + 1).otherwise(F.lit(0)).cast("long")))
    s = s.filter("need > 0").withColumn("name", F.struct("source"))
    # every source owns a range of the numbers below the sum of all needs; a number finds its source through buckets of
    # equal width, as many as there are sources, each with the ranges that touch it
    ranges = s.select("name", (F.sum("need").over(W.orderBy("need", "name").rowsBetween(W.unboundedPreceding, 0)) - F.col("need")).alias("lo"), "need")
    plan = s.agg(F.sum("need").alias("slots"), F.count(F.lit(1)).alias("sources")).filter("slots > 0")
    plan = plan.withColumn("width", F.ceil(F.col("slots") / F.col("sources")).cast("long")).drop("sources")
    ranges = ranges.crossJoin(F.broadcast(plan)).select("name", "lo", (F.col("lo") + F.col("need")).alias("hi"), F.explode(F.sequence(F.expr("lo div width"), F.expr("(lo + need - 1) div width"))).alias("bucket"))
    shards = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / shard_slots))).alias("shard"))
    # the multinomial: every slot of a shard draws its source
    n_here = F.least(F.lit(shard_slots).cast("long"), F.col("slots") - F.col("shard") * shard_slots)
    drawn = shards.repartition("shard").select("shard", "width", "slots", F.explode(F.sequence(F.lit(1).cast("long"), n_here)).alias("slot"))
    drawn = drawn.select("shard", "width", F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.col("slots")).alias("u")).withColumn("bucket", F.expr("u div width"))
    drawn = drawn.join(_beside(ranges, few), "bucket").filter("lo <= u and u < hi")
    counts = drawn.groupBy("name", "shard").agg(F.count(F.lit(1)).alias("c"))
    run = W.partitionBy("name").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("off", F.coalesce(F.sum("c").over(run), F.lit(0)))
    drawn_all = counts.groupBy("name").agg(F.sum("c").alias("got"))
    quotas = s.select("name", "blocks", "passes", "rest", "last_words", "need")
    closing = quotas.join(_beside(drawn_all, few), "name", "left").select("name", F.coalesce("got", F.lit(0)).alias("off"), (F.col("need") - F.coalesce("got", F.lit(0))).alias("c")).filter("c > 0")
    shard_runs = counts.select("name", "off", "c").unionByName(closing)
    runs = shard_runs.join(_beside(quotas, few), "name").withColumn("c", F.least("c", F.col("need") - F.col("off"))).filter("c > 0")
    pieces = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / shard_slots))).alias("piece")).repartition("name", "off", "piece")
    k = pieces.select("*", F.explode(F.sequence(F.col("off") + F.col("piece") * shard_slots, F.least(F.col("off") + F.col("c"), F.col("off") + (F.col("piece") + 1) * shard_slots) - 1)).alias("k"))
    k = k.withColumns({"pass": F.floor(F.col("k") / F.col("blocks")).cast("long"), "i": F.pmod(F.col("k"), F.col("blocks"))})
    return k.select("name", "blocks", "passes", "rest", "last_words", "k", "pass", "i", permuted(F.col("i"), F.col("blocks"), F.xxhash64(F.lit(seed), "name", "pass")).alias("block"))


def word_counts(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _mixed(df, id_col, text_col, source_col, block_words, shard_slots, seed, cap):
    # the texts are read once; what follows needs three numbers a row
    d = materialize(word_counts(df, id_col, text_col, source_col))
    targets = materialize(source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), cap))
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    d = d.withColumns({"name": F.struct("source"), "p1": F.pmod(F.xxhash64("doc_id"), F.lit(FAN)), "p2": F.pmod(F.xxhash64("doc_id", "size"), F.lit(FAN))})  # rows of one hot id differ in size
    # running word offsets in a source, on three levels, so that no source passes through one task
    parts = d.groupBy("name", "p1", "p2").agg(F.sum("size").alias("words"))
    before = W.unboundedPreceding, -1
    second = parts.withColumn("off2", F.coalesce(F.sum("words").over(W.partitionBy("name", "p1").orderBy("p2").rowsBetween(*before)), F.lit(0)))
    first = parts.groupBy("name", "p1").agg(F.sum("words").alias("words1"))
    first = first.select("name", "p1", F.coalesce(F.sum("words1").over(W.partitionBy("name").orderBy("p1").rowsBetween(*before)), F.lit(0)).alias("off1"))
    offs = second.select("name", "p1", "p2", "off2").join(first, ["name", "p1"]).select("name", "p1", "p2", (F.col("off1") + F.col("off2")).alias("off"))
    own = W.partitionBy("name", "p1", "p2").orderBy("doc_id", "size")
    d = d.withColumn("off3", F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    d = d.join(offs, ["name", "p1", "p2"]).join(_beside(targets.select(F.struct("source").alias("name"), "source_size", "target"), few), "name")
    d = d.select("name", "doc_id", "size", "source_size", "target", (F.col("off") + F.col("off3")).alias("start"))
    over = d.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))).alias("block"))
    over = over.withColumns({"lo": F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0).cast("long")), "hi": F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words).cast("long"))})

    slots = slot_plan(targets, block_words, shard_slots, seed, few)
    # where the short last block stands in the last pass decides how many words lie before a slot
    short = slots.filter((F.col("pass") == F.col("passes")) & (F.col("block") == F.col("blocks") - 1)).select("name", F.col("i").alias("short_at"))
    slots = slots.join(_beside(short, few), "name", "left")
    gone = F.col("i") * block_words - F.when(F.col("short_at") < F.col("i"), block_words - F.col("last_words")).otherwise(0)
    slots = slots.withColumns({"whole": (F.col("pass") < F.col("passes")).cast("long"), "cut": F.when(F.col("pass") == F.col("passes"), F.least(F.greatest(F.col("rest") - gone, F.lit(0)), F.lit(block_words))).otherwise(0).cast("long")})
    uses = slots.groupBy("name", "block").agg(F.sum("whole").alias("whole"), F.sum("cut").alias("cut"))
    joined = over.join(uses, ["name", "block"], "left")
    words = F.coalesce(F.col("whole"), F.lit(0)) * (F.col("hi") - F.col("lo")) + F.greatest(F.least(F.col("hi"), F.coalesce(F.col("cut"), F.lit(0))) - F.col("lo"), F.lit(0))
    joined = joined.withColumns({"words": words})
    # rows with words differ in (name, start); rows without words need no sum
    out = joined.filter("size > 0").groupBy("name", "start", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken")).select("name", "start", "doc_id", "size", "source_size", "target", "taken")
    none = d.filter("size = 0").select("name", "start", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return out.unionByName(none).select("name", "doc_id", "size", "source_size", "target", "taken")


def even_copies(mixed: DataFrame) -> DataFrame:
    """Adds ``copies`` to rows of (name, doc_id, size, taken): whole copies whose words meet what each source takes.

    Systematic rounding: along a source's rows in order of size, the running sum of the parts of copies (in units of 2**-30)
    gives a copy wherever it passes a half. A row gets its taken / size rounded up or down, and as sizes only grow along
    the sum, a source's words miss its taken words by at most its longest row. The sum goes over levels as the offsets do.
    """
    one = 1 << 30
    d = materialize(mixed.withColumn("x", F.expr(f"if(size > 0, ((taken % size) * {one}) div size, 0L)")))
    part = d.filter("x > 0").withColumns({"bits": F.length(F.bin("size")), "high": F.expr("shiftright(size, greatest(length(bin(size)) - 10, 0))"), "p": F.pmod(F.xxhash64("doc_id"), F.lit(FAN))})
    levels, offs = ["bits", "high", "size", "p"], None
    for n in range(1, len(levels) + 1):
        upper = ["name", *levels[: n - 1]]
        order = W.partitionBy(*upper).orderBy(levels[n - 1]).rowsBetween(W.unboundedPreceding, -1)
        sums = part.groupBy(*upper, levels[n - 1]).agg(F.sum("x").alias("s")).withColumn("o", F.coalesce(F.sum("s").over(order), F.lit(0)))
        sums = sums if offs is None else sums.join(offs, upper).withColumn("o", F.col("o") + F.col("off"))
        offs = sums.select(*upper, levels[n - 1], F.col("o").alias("off"))
    own = W.partitionBy("name", *levels).orderBy("doc_id", "x").rowsBetween(W.unboundedPreceding, 0)
    part = part.withColumn("own", F.sum("x").over(own)).join(offs, ["name", *levels]).withColumn("end", F.col("off") + F.col("own") + one // 2)
    part = part.withColumn("up", F.expr(f"end div {one} - (end - x) div {one}"))
    out = part.select(*d.columns, "up").unionByName(d.filter("x = 0").withColumn("up", F.lit(0).cast("long")))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("taken div size") + F.col("up")).cast("int")
    return out.withColumn("copies", copies).drop("x", "up")


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rounding: str = "nearest", **options) -> DataFrame:
    """Rows of ``df`` as often as the mix takes them: taken over size, rounded to whole copies; rows of size 0 stay once.

    ``nearest`` rounds each row by itself: where a source takes less than half of its words, its long rows all go, so the
    words kept miss the target. ``even`` rounds along each source (``even_copies``), so that they meet it to one row.
    Rows with equal (id, source, size) share their copies in any order, so the outcome depends on the rows alone.
    """
    if rounding == "even":
        settings = {"block_words": BLOCK_WORDS, "shard_slots": SHARD_SLOTS, "seed": 17, "cap": 3.0} | options
        mixed = even_copies(_mixed(df.select(id_col, text_col, source_col), id_col, text_col, source_col, **settings))
        return mixed.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken", "copies")
    mixed = mix_sources(df.select(id_col, text_col, source_col), id_col, text_col, source_col, **options)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    return mixed.withColumn("copies", copies)
