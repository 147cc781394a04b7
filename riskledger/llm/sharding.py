"""Stable shards by jump consistent hashing, with DataFrame functions only.

Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm" (2014): a linear
congruential generator seeded with the key jumps from shard to shard; the last place before the
shard count is the key's shard. No table of shards is kept, and one more shard takes 1/(n+1) of
the keys and moves no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskledger.llm.frames import carried

#: Multiplier of the published generator.
MULTIPLIER = 2862933555777941757

_LOW = (1 << 32) - 1
_M_LOW, _M_HIGH = MULTIPLIER & _LOW, MULTIPLIER >> 32


def key_of(df: DataFrame, columns: list[str]) -> Column:
    """The 64-bit key: one integer column itself, else a hash of the columns. Null counts as 0."""
    if len(columns) == 1 and isinstance(df.schema[columns[0]].dataType, T.IntegralType):
        return F.coalesce(F.col(columns[0]).cast("long"), F.lit(0).cast("long"))
    return F.xxhash64(*columns)


def _times_low(x: Column, m: int) -> Column:
    """``x * m`` modulo 2**32 for two 32-bit values, without leaving 64-bit integers."""
    upper = (x * F.lit(m >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (x * F.lit(m & 0xFFFF) + F.shiftleft(upper, 16)).bitwiseAND(F.lit(_LOW))


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """One step of the generator on a 64-bit state kept as two 32-bit halves."""
    part = low * F.lit(_M_LOW >> 16)
    total = low * F.lit(_M_LOW & 0xFFFF) + F.shiftleft(part.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(part, 16)
    top = (carry + _times_low(high, _M_LOW) + _times_low(low, _M_HIGH)).bitwiseAND(F.lit(_LOW))
    return top, total.bitwiseAND(F.lit(_LOW))


def _halves(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_LOW))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards - 1`` of a 64-bit key.

    A jump goes at least one place on, so ``shards`` folds always end it; most keys need
    log(shards), and the fold does nothing once the end is reached.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    high, low = _halves(key)

    def jump(s: Column, _: Column) -> Column:
        top, bottom = _next_state(s["high"], s["low"])
        # (b + 1) * (2**31 / ((state >> 33) + 1)), as published, in floating point
        draw = (F.shiftright(top, 1) + F.lit(1)).cast("double")
        to = F.floor((s["next"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long")
        moved = F.struct(s["next"].alias("at"), to.alias("next"), top.alias("high"), bottom.alias("low"))
        return F.when(s["next"] < F.lit(shards), moved).otherwise(s)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"), high.alias("high"), low.alias("low"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda s: s["at"].cast("int"))


def assign_shards(df: DataFrame, columns: list[str], shards: int, shard: str = "shard") -> DataFrame:
    """``df`` with its shard. Narrow: no shuffle, so texts stay where they are.

    Equal keys share a shard; a null integer key counts as 0; an empty table stays empty; an
    input column of the name ``shard`` is replaced.
    """
    return df.withColumn(shard, jump_shard(key_of(df, columns), shards))


def number_slots(df: DataFrame, columns: list[str], order: list[str], shard: str = "shard", slot: str = "slot", parts: int = 256) -> DataFrame:
    """``df`` with gapless numbers from 0 in each shard.

    A shard is cut into ``parts`` by the first draw of the generator, each part is numbered by
    itself in the order of ``order`` and moved by the rows of the parts before it. No task holds a
    whole shard; the offsets are at most shards x parts lines. Rows alike in ``order`` are
    numbered in any order.
    """
    top, _ = _next_state(*_halves(key_of(df, columns)))
    cut = df.select(F.col(shard).alias("shard"), F.pmod(F.shiftright(top, 1), F.lit(parts)).cast("int").alias("part"), carried(df))
    sizes = cut.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "part").orderBy(*[F.col("row").getField(c).asc_nulls_first() for c in order])
    numbered = cut.withColumn("inside", F.row_number().over(inside).cast("long"))
    # shards x parts lines of three numbers: bounded by the two parameters
    joined = numbered.join(F.broadcast(offsets), ["shard", "part"])
    return joined.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c != slot], (F.col("before") + F.col("inside") - 1).alias(slot))


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """Write one folder per shard."""
    df.write.mode("overwrite").partitionBy(shard).parquet(path)
