"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Targets are found by water-filling over the (small) table of sources. The mix's words are cut into equal
blocks, which sources get by highest quotients; a block is so small (`block_words` at most) that the smallest
target has a hundred of them, or a word. A source's words are so many whole passes over it, and a rest. Of
the rest's whole blocks each shard of the source gets an integer quota by highest quotients; the odd words
that are left are dealt to the shards with room. Within a shard, blocks are taken in a seeded order, and the
last of them is cut to the words still owed. A document's taken words are the passes times its size and its
part of the chosen blocks. All of it is DataFrame code.

Rows: null and empty texts have size 0 and nothing is taken of them; a null source is a source of its own,
the last one. Repeated rows, and rows that agree in id, source and size, are rows of their own: they are
counted first and dealt apart by their number. An empty table, or one without words, takes nothing. Texts of
any length are read whole; a long one may lie in many blocks. The result does not depend on partitioning:
order within a shard is by a seeded hash, then id, size and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvloom.llm.shared import checkpointed, parts

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SALTS = 64
#: No more shards than this in all (and one for each source), so that a window over a source's shards stays small.
MOST_SHARDS = 1 << 16
#: Equal rows are dealt on in chunks of so many.
CHUNK = 1 << 16


def sainte_lague(table: DataFrame, group: list[str], value: str, seats: str, order: list[str], out: str) -> DataFrame:
    """table with the column `out`: of its group's `seats`, those that go to this row by highest quotients.

    The quotients are value / (2k + 1). Seats that any such allocation must give are counted by rounding at
    a divisor that is surely too large; what is left, at most one for each row of the group, goes to the
    highest of the next quotients (ties: by `order`), of which no row needs more than a surely too small
    divisor gives it. So no list of all blocks is ever made. Rows without value get none.
    """
    over = Window.partitionBy(*group)
    t = table.withColumn("_v", F.col(value).cast("double")).withColumn("_sum", F.sum("_v").over(over))
    t = t.withColumn("_m", F.count("*").over(over)).withColumn("_seats", F.col(seats).cast("double"))
    share = F.col("_v") / F.col("_sum")
    sure = F.floor(share * F.greatest(F.col("_seats") - F.col("_m") / 2, F.lit(0.0)) * (1 - 1e-12) + 0.5 - 1e-9)
    most = F.ceil(share * (F.col("_seats") + F.col("_m") / 2) + 0.5 + 1e-6)
    t = t.withColumn("_sure", F.when(F.col("_sum") > 0, F.greatest(sure, F.lit(0))).otherwise(0).cast("long"))
    t = t.withColumn("_most", F.when((F.col("_sum") > 0) & (F.col("_v") > 0), most).otherwise(0).cast("long"))
    t = t.withColumn("_left", F.col("_seats").cast("long") - F.sum("_sure").over(over))
    tries = t.where("_most > _sure AND _left > 0").select(*group, *order, "_v", "_left", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_k"))
    rank = F.row_number().over(over.orderBy(F.desc(F.col("_v") / (2 * F.col("_k") + 1)), *order))
    won = tries.withColumn("_rank", rank).where("_rank <= _left").groupBy(*group, *order).agg(F.count("*").alias("_won"))
    return t.join(won, [*group, *order], "left").withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0))).drop(
        "_v", "_sum", "_m", "_seats", "_sure", "_most", "_left", "_won"
    )


def targets(sizes: DataFrame, factor: float, most_passes: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source_key, source_size, target) of sizes(source_key, size, copies) by water-filling; sources by code point, null last, weigh `weights` in turn.

    The sources are a mix's definition: a short table, and the only one that is seen as a whole.
    """
    all_rows = Window.partitionBy(F.lit(0))
    t = sizes.groupBy("source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    place = F.row_number().over(all_rows.orderBy("source_key")) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = t.withColumn("_w", F.element_at(cycle, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("_cap", F.col("source_size") * F.lit(float(most_passes)))
    t = t.withColumn("_total", F.sum("source_size").over(all_rows) * F.lit(float(factor)))
    # Sources fill up in order of cap by weight: one is at its cap if the level without those before it reaches it.
    up = all_rows.orderBy(F.col("_cap") / F.col("_w"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    on = all_rows.orderBy(F.col("_cap") / F.col("_w"), "source_key").rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(up), F.lit(0.0))) / F.sum("_w").over(on)
    t = t.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("_w") >= F.col("_cap"))
    free = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "source_key", "_level"))).over(all_rows)["_level"]
    return t.withColumn("_free", free).select(
        "source_key", "source_size",
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_free") * F.col("_w")).alias("target"),
    )


def source_key(source: Column) -> Column:
    """A key without nulls that sorts as the source does, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def owed_words(sources: DataFrame, block_words: int, most_passes: int) -> DataFrame:
    """sources with `owed`: the words of the blocks that each source gets by highest quotients."""
    all_rows = Window.partitionBy(F.lit(0))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(all_rows)
    t = sources.withColumn("grain", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.coalesce(least, F.lit(0.0)) / 100))).cast("long"))
    t = t.withColumn("blocks", F.round(F.sum("target").over(all_rows) / F.col("grain")).cast("long")).withColumn("g", F.lit(0))
    t = sainte_lague(t, ["g"], "target", "blocks", ["source_key"], "quota")
    owed = F.least(F.col("quota") * F.col("grain"), F.col("source_size") * most_passes)
    return t.select("source_key", "source_size", "target", owed.alias("owed"))


def shard_words_owed(shards: DataFrame, block_words: int, seed: int) -> DataFrame:
    """shards(source_key, shard, shard_size, source_size, owed) with passes, and `words`: those owed beyond the whole passes."""
    source = Window.partitionBy("source_key")
    passes = F.floor(F.col("owed") / F.greatest("source_size", F.lit(1))).cast("long")
    t = shards.withColumn("passes", passes).withColumn("rest", F.col("owed") - F.col("passes") * F.col("source_size"))
    t = sainte_lague(t.withColumn("whole", F.floor(F.col("rest") / block_words)), ["source_key"], "shard_size", "whole", ["shard"], "quota")
    t = t.withColumn("got", F.least(F.col("quota") * block_words, F.col("shard_size")))
    t = t.withColumn("room", F.col("shard_size") - F.col("got")).withColumn("odd", F.col("rest") - F.sum("got").over(source))
    # Odd words go to the shards with room, in a seeded order.
    before = source.orderBy(F.xxhash64(F.lit(seed), "source_key", "shard"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("odd") - F.coalesce(F.sum("room").over(before), F.lit(0))
    t = t.withColumn("words", F.col("got") + F.greatest(F.lit(0), F.least("room", left)))
    return t.select("source_key", "shard", "shard_size", "passes", F.greatest("words", F.lit(0)).cast("long").alias("words"))


def mix(
    docs: DataFrame, *, factor: float = 1.5, most_passes: int = 2, block_words: int = 64, shard_words: int = 1 << 19, seed: int = 42,
    weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """id, size, source_size, target and taken of every row.

    The mix has `factor` times all words; no source, and no document, is taken more than `most_passes` times.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), source_key(F.col(source_col)).alias("source_key"), size.alias("size"))
    rows = checkpointed(rows.groupBy("id", "source_key", "size").agg(F.count("*").alias("copies")))
    sources = checkpointed(owed_words(targets(rows, factor, most_passes, weights), block_words, most_passes))
    per_shard = F.greatest(F.lit(shard_words), F.ceil(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / MOST_SHARDS))
    sources = sources.withColumn("shards", F.ceil(F.col("source_size") / per_shard).cast("long"))
    # Equal rows in chunks, then one by one. The few sources are repeated for each salt, so that the rows of a hot one meet it in many tasks.
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK)))
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = rows.withColumn("chunk", chunk).withColumn("salt", F.pmod(F.xxhash64("id", "size", "chunk"), F.lit(SALTS)).cast("int")).join(salted, ["source_key", "salt"])
    number = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least("copies", (F.col("chunk") + 1) * CHUNK) - 1))
    placed = placed.withColumn("copy", number).select("source_key", "id", "size", "source_size", "target", "owed", "shards", F.xxhash64(F.lit(seed), "id", "size", "copy").alias("h"), "copy")
    # A hot source is dealt to as many shards as its size asks for; a row's shard and place follow from a seeded hash.
    placed = checkpointed(placed.withColumn("shard", F.when(F.col("size") > 0, F.pmod(F.xxhash64(F.lit(seed), "h"), F.greatest("shards", F.lit(1))))).drop("shards"))
    full = placed.where("size > 0")
    shards = full.groupBy("source_key", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("owed").alias("owed"))
    shards = checkpointed(shard_words_owed(shards, block_words, seed))
    some = shards.where("words > 0 AND words < shard_size")
    blocks = some.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shard_size") - 1) / block_words))))
    blocks = blocks.withColumn("long", F.least(F.lit(block_words), F.col("shard_size") - F.col("block") * block_words))
    seeded = Window.partitionBy("source_key", "shard").orderBy(F.xxhash64(F.lit(seed), "source_key", "shard", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    give = F.least(F.col("long"), F.col("words") - F.coalesce(F.sum("long").over(seeded), F.lit(0)))
    chosen = blocks.withColumn("give", give).where("give > 0").select("source_key", "shard", "block", "give")
    order = Window.partitionBy("source_key", "shard").orderBy("h", "id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    laid = full.repartition(parts(docs.sparkSession), "source_key", "shard")  # else a hot source stays in one task
    laid = laid.withColumn("e", F.sum("size").over(order)).withColumn("s", F.col("e") - F.col("size")).join(some.select("source_key", "shard", "passes"), ["source_key", "shard"])
    cut = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("s") / block_words), F.floor((F.col("e") - 1) / block_words))))
    part = F.least("e", F.col("block") * block_words + F.coalesce("give", F.lit(0))) - F.greatest("s", F.col("block") * block_words)
    partly = (
        cut.join(chosen, ["source_key", "shard", "block"], "left")
        .groupBy("source_key", "shard", "s", "id", "size", "source_size", "target", "passes")
        .agg(F.sum(F.greatest(F.lit(0), part)).alias("extra"))
        .select("id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"))
    )
    wholly = full.join(shards.where("words <= 0 OR words >= shard_size"), ["source_key", "shard"])
    wholly = wholly.select("id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.when(F.col("words") > 0, 1).otherwise(0))).alias("taken"))
    empty = placed.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return partly.union(wholly).union(empty).withColumnRenamed("id", id_col)
