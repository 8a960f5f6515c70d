"""Sharding by jump consistent hashing (Lamping and Veach), in DataFrame expressions only.

A 64-bit linear congruential generator seeded with the key decides at which shard counts the key moves. The state is
held as two unsigned 32-bit halves, and products are taken on 16-bit limbs, so nothing overflows and the result is the
same with ANSI mode on or off. Appending one shard moves rows into the new shard only; there is no ring table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Fixed value: multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
N_SHARDS = 24
#: Numbering works on (shard, slice) groups, so that a shard is never sorted in one task.
SLICES = 1024
_M32 = (1 << 32) - 1
_HI, _LO = MULTIPLIER >> 32, MULTIPLIER & _M32


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, (key * MULTIPLIER + 1) mod 2**64."""
    m32, m16 = F.lit(_M32), F.lit(0xFFFF)
    low = lo.bitwiseAND(m16) * F.lit(_LO) + F.lit(1)
    high = F.shiftrightunsigned(lo, 16) * F.lit(_LO)
    part = low + F.shiftleft(high.bitwiseAND(m16), 16)
    carry = F.shiftrightunsigned(part, 32) + F.shiftrightunsigned(high, 16)
    upper = hi.bitwiseAND(m16) * F.lit(_LO) + F.shiftleft((F.shiftrightunsigned(hi, 16) * F.lit(_LO)).bitwiseAND(m16), 16)
    new_hi = (carry + (lo * F.lit(_HI)).bitwiseAND(m32) + upper.bitwiseAND(m32)).bitwiseAND(m32)
    return new_hi, part.bitwiseAND(m32)


def jump_hash(key: Column, n: int) -> Column:
    """struct(shard, grown): shard of key among n shards, and among n + 1. Null keys count as 0.

    Each jump goes to a strictly larger shard, so n + 1 steps always reach the end; finished rows pass through unchanged.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        then = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(
            hi.alias("hi"), lo.alias("lo"), then.alias("j"),
            F.when(s["j"] < n, s["j"]).otherwise(s["shard"]).alias("shard"), s["j"].alias("grown"),
        )
        return F.when(s["j"] < n + 1, moved).otherwise(s)

    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_M32)).alias("lo"),
        zero.alias("j"), none.alias("shard"), none.alias("grown"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(n + 2)), start, jump, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def slice_of(key: Column, slices: int) -> Column:
    """A slice for numbering: high bits of the generator's first state, which say little about the shard."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    hi, _ = _step(F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_M32)))
    return F.pmod(F.shiftrightunsigned(hi, 1), F.lit(slices)).cast("int")


def assign_shards(docs: DataFrame, n: int = N_SHARDS, key: str = "doc_id", text: str = "text", slices: int = SLICES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots run from 0 without gaps inside each shard, in the order (slice, key, text_crc32, size), where a slice is a hash
    of the key. Only n * slices counts are summed up and broadcast (at most 24 576 rows of three numbers by default,
    whatever the input), and the texts are never shuffled. Rows with equal keys share a shard and get different
    slots; repeated rows are interchangeable. Null text has size 8 and CRC 0, a null key goes where 0 goes.
    An empty table gives no rows; columns beyond key and text are ignored.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("at", jump_hash(F.col("doc_id"), n)).withColumn("slice", slice_of(F.col("doc_id"), slices))

    counts = placed(docs.select(F.col(key).alias("doc_id"))).groupBy(F.col("at.shard").alias("shard"), "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first"))
    order = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    numbered = placed(rows).select("doc_id", "size", "text_crc32", F.col("at.shard").alias("shard"), F.col("at.grown").alias("grown_shard"), "slice")
    numbered = numbered.withColumn("nth", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(first), ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("nth")).alias("slot"), "grown_shard"
    )


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


#: The same in SQL: the generator on 128-bit numbers, and CRC-32 by a table that a recursion makes.
OP5_SQL = """
WITH RECURSIVE ids AS (
  SELECT DISTINCT doc_id, CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS key FROM documents
), jumps AS (
  SELECT doc_id, key, 0::BIGINT AS j FROM ids
  UNION ALL
  SELECT doc_id, next, CAST(floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((next // 8589934592) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT doc_id, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jumps WHERE j < 25)
), places AS (
  SELECT doc_id, CAST(max(j) FILTER (j < 24) AS INTEGER) AS shard, CAST(max(j) FILTER (j < 25) AS INTEGER) AS grown_shard FROM jumps GROUP BY doc_id
), steps AS (
  SELECT i, 0 AS k, i AS c FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), codes AS (
  SELECT list(c ORDER BY i) AS l FROM steps WHERE k = 8
), rows AS (
  SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(text)), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, l[xor(a & 255, b) + 1])), 4294967295) AS text_crc32
  FROM (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents), codes
)
SELECT r.doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ((key * 2862933555777941757 + 1) % 18446744073709551616 // 8589934592) % 1024, r.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown_shard
FROM rows r JOIN places p ON r.doc_id IS NOT DISTINCT FROM p.doc_id JOIN ids i ON r.doc_id IS NOT DISTINCT FROM i.doc_id
"""
