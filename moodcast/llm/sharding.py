"""Shards by jump consistent hashing, as DataFrame expressions only.

A key's shard follows from the key and the number of shards alone, without a
ring table. With one more shard, a key either stays or moves into the new one,
and 1 / (n + 1) of the keys move.

The generator's 64-bit state is a decimal, so that the wrap-around product
needs no overflowing integers. A key jumps at most once to each shard, so
``shards`` steps always suffice; after 64 of them practically every row is
done, and the rest are carried on exactly.

Numbers within a shard run without gaps in the order of a hash, over
(shard, block of the hash) groups: the counts of the blocks (at most
shards x 4096 rows) give each block's first number, so no task orders a whole
shard.

Defined cases: a null key is a key of its own and all its rows share a shard;
repeated rows are numbered each; a null text counts as none; an empty table
gives an empty result; columns of the input whose names clash with the added
ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULTIPLIER = 2862933555777941757
FIRST_STEPS = 64
BLOCK_DIGITS = 3   # hexadecimal digits of the hash that make a block

_WRAP = "cast(18446744073709551616 as decimal(20,0))"


def key_state(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as the generator's first state."""
    digest = F.md5(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")


def jump_shard(key: Column, shards: int) -> Column:
    """Jump consistent hash of ``key`` into 0 .. shards - 1 (int)."""
    if shards < 1:
        raise ValueError("at least one shard")

    def step(s: Column, _: Column) -> Column:
        state = F.pmod(s["state"] * F.expr(f"cast({MULTIPLIER} as decimal(19,0))") + 1, F.expr(_WRAP)).cast("decimal(20,0)")
        # the upper 31 bits; the quotient is exact in a double below 2^53
        high = F.floor(state / F.expr("cast(8589934592 as decimal(10,0))")).cast("long")
        jump = F.floor((s["jump"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1).cast("double"))).cast("long")
        return F.when(s["jump"] >= shards, s).otherwise(
            F.struct(s["jump"].alias("at"), jump.alias("jump"), state.alias("state")))

    def walk(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("jump"),
                     key_state(key).alias("state"))
    first = walk(start, min(shards, FIRST_STEPS))
    if shards > FIRST_STEPS:
        first = F.when(first["jump"] >= shards, first).otherwise(walk(first, shards))
    return first["at"].cast("int")


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", spread: str | None = "text") -> DataFrame:
    """``docs`` with ``shard``, ``slot`` (gapless from 0 in the shard) and ``grown_shard``.

    ``grown_shard`` is the shard with one more shard. Slots follow a hash of the
    key and of ``spread``, a column that tells rows of one key apart, so that
    many rows of one key do not meet in one block.
    """
    tag = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")),
                            *([F.crc32(F.coalesce(F.col(spread).cast("string"), F.lit("")))] if spread else [])))
    placed = (docs.withColumn("shard", jump_shard(F.col(key), shards))
              .withColumn("grown_shard", jump_shard(F.col(key), shards + 1))
              .withColumn("__tag", tag)
              .withColumn("__block", F.substring("__tag", 1, BLOCK_DIGITS)))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = (placed.groupBy(F.col("shard").alias("__s"), F.col("__block").alias("__b")).agg(F.count("*").alias("__n"))
             .withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    # at most shards x 16^BLOCK_DIGITS rows
    joined = placed.join(F.broadcast(first) if shards <= 256 else first,
                         (F.col("shard") == F.col("__s")) & (F.col("__block") == F.col("__b")))
    within = F.row_number().over(Window.partitionBy("shard", "__block").orderBy("__tag", key))
    return joined.withColumn("slot", F.col("__first") + within - 1).drop("__tag", "__block", "__s", "__b", "__first")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard (``shard=<n>``), its rows in order of ``slot`` within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
