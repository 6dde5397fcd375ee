"""Distinct counts from multiresolution bitmaps.

A value's 60-bit hash chooses a level (geometric: level i takes a share of 2^-(i+1)) and one bit of
that level's bitmap. Bitmaps are rows of 32-bit words, so making and merging them are hash
aggregations with bit_or that combine on the map side; a group never costs more than
LEVELS * bits / 32 words, whatever it holds. The estimate adds up linear counting over all levels
from the first unsaturated one on, scaled by the share that these levels see; its relative error does
not depend on the number of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.runtime import durable, small_side

#: Bits of a level's bitmap (a power of two up to 2^16), and of a word, which is one row.
BITS, WORD = 4096, 32
LEVELS = 44
#: A level counts as saturated above this share of set bits.
FULL = 0.8
#: The stated bound is this many standard errors, and one value more, as collisions come in whole values. A result
#: has thousands of counts, so that three standard errors would be passed by some of them.
SIGMAS = 4.0
#: The name under which a null group is counted.
NULL = "(null)"


def sketch(df: DataFrame, value: str, groups: Sequence[str], bits: int = BITS) -> DataFrame:
    """One row for each (groups, level, word) that has a bit set: the mergeable partial result. Nulls are no values.

    The hash is the head of the value's MD5, so that any engine can repeat it.
    """
    width = bits.bit_length() - 1
    hash_ = F.conv(F.substring(F.md5(F.col(f"`{value}`").cast("string")), 1, 15), 16, 10).cast("bigint")
    rows = df.filter(F.col(f"`{value}`").isNotNull()).select(*groups, hash_.alias("__h"))
    rows = rows.select(*groups, F.shiftright("__h", width).alias("__g"), F.col("__h").bitwiseAND(F.lit(bits - 1)).alias("__slot"))
    placed = rows.select(
        *groups,
        F.least(F.expr("bit_count((__g & -__g) - 1)"), F.lit(LEVELS - 1)).alias("level"),
        F.floor(F.col("__slot") / WORD).cast("int").alias("word"),
        F.expr(f"shiftleft(1L, cast(__slot % {WORD} as int))").alias("bit"),
    )
    return merge(placed, groups)


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups, by OR."""
    return sketches.groupBy(*groups, "level", "word").agg(F.bit_or("bit").alias("bit"))


def estimate(sketches: DataFrame, groups: Sequence[str], bits: int = BITS) -> DataFrame:
    """groups, n (estimated distinct values), bound (relative error that ``SIGMAS`` standard errors and one value allow)."""
    ones = sketches.groupBy(*groups, "level").agg(F.sum(F.bit_count("bit")).alias("ones"))
    levels = ones.groupBy(*groups).agg(F.collect_list(F.struct("level", "ones")).alias("x"))  # LEVELS rows at most
    full = FULL * bits
    base = f"coalesce(array_max(transform(filter(x, l -> l.ones > {full}), l -> l.level)), -1) + 1"
    based = levels.withColumn("base", F.least(F.expr(base), F.lit(LEVELS - 1)))
    seen = based.withColumn("x", F.expr("filter(x, l -> l.level >= base)"))
    add = lambda e: F.expr(f"aggregate(x, 0D, (a, l) -> a + {e})")
    load = f"-ln(1 - least(l.ones, {bits - 1}) / {bits}D)"
    n = seen.withColumn("part", add(f"{bits} * {load}")).withColumn("var", add(f"{bits} * (exp({load}) - ({load}) - 1)")).withColumn("scale", F.expr("pow(2D, base)"))
    rel = F.sqrt(F.col("var") + F.col("part") * (1 - 1 / F.col("scale"))) / F.greatest(F.col("part"), F.lit(1.0))
    count = F.col("part") * F.col("scale")
    return n.select(*groups, F.round(count).cast("long").alias("n"), (SIGMAS * rel + 1 / F.greatest(count, F.lit(1.0))).alias("bound"))


def cells(df: DataFrame, value: str, day: str, op: str, bits: int = BITS) -> DataFrame:
    """The partial results for every count below: one bitmap for each (day, op), null ops as ``NULL``."""
    rows = df.select(F.col(f"`{value}`").alias("v"), F.col(f"`{day}`").alias("day"), F.coalesce(F.col(f"`{op}`"), F.lit(NULL)).alias("op"))
    return sketch(rows, "v", ["day", "op"], bits)


def combinations_of(parts: DataFrame) -> DataFrame:
    """(ops, op): every combination of two or more of the ops that occur in ``parts``, joined by +, and its members.

    The list has 2^k combinations of k ops and is made by the executors; more than 62 ops cannot be listed.
    """
    names = sorted(r[0] for r in parts.select("op").distinct().limit(63).collect())
    if len(names) > 62:
        raise ValueError("there are 2^63 combinations; fold rare ops into one before")
    every = parts.sparkSession.range(1 << len(names)).filter("bit_count(id) > 1")
    member = F.filter(F.array(*[F.when(F.col("id").bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    return every.select(member.alias("members")).select(F.array_join("members", "+").alias("ops"), F.explode("members").alias("op"))


def distinct_by_day_and_ops(df: DataFrame, value: str, day: str, op: str, bits: int = BITS) -> DataFrame:
    """Distinct values by day, by op, by day and op, and by combination of ops, over all days and for each day.

    Result: scope (day, op, day_op, ops, day_ops), day, ops (joined by +), n, bound; all from one sketch
    for each (day, op), merged by OR. Combinations are those of the ops that have values, whatever
    their spelling. A null op counts as the op "(null)", a null day is a day of its own, and a row
    without value belongs to no count. An empty table gives no rows.
    """
    parts = durable(cells(df, value, day, op, bits))
    null = lambda t: F.lit(None).cast(t)
    kind = lambda scope, day, ops: F.struct(F.lit(scope).alias("scope"), day.alias("day"), ops.alias("ops"))
    d, o, no_day, no_ops = F.col("day"), F.col("op"), null(dict(parts.dtypes)["day"]), null("string")
    single = parts.withColumn("r", F.explode(F.array(kind("day", d, no_ops), kind("op", no_day, o), kind("day_op", d, o))))
    joined = parts.join(small_side(combinations_of(parts)), "op")
    several = joined.withColumn("r", F.explode(F.array(kind("ops", no_day, F.col("ops")), kind("day_ops", d, F.col("ops")))))
    keys = ["scope", "day", "ops"]
    routed = single.select("r.*", "level", "word", "bit").union(several.select("r.*", "level", "word", "bit"))
    return estimate(merge(routed, keys), keys, bits)
