"""Sharding by rendezvous hashing of stable record keys, in DataFrame functions alone.

Every shard draws a number from the key and itself; the highest draw takes the row. A further shard only takes
rows for itself, all others stay. With weights a shard draws ln(u) / weight. Slots number a shard's rows from 0
without gaps in the order of (hash of the key, key): rows are counted by shard and hash prefix first, so that no
task ever numbers a whole shard.

Defined cases: a null key hashes as the text "null"; null text has no bytes and the crc32 of the empty text;
repeated rows share a shard and get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 48


def _draw(key: Column, salt: str) -> Column:
    """48 bits of MD5; the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(salt))), 1, HASH_BITS // 4), 16, 10).cast("long")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest draw; the lower number wins a tie."""
    equal = len(set(weights)) == 1

    def drawn(s: int, w: float) -> Column:
        draw = _draw(key, f":{s}")
        score = draw if equal else F.log((draw + 1) / F.lit(float(2**HASH_BITS))) / F.lit(float(w))
        return F.struct(score.alias("score"), F.lit(-s).alias("minus"))

    draws = [drawn(s, w) for s, w in enumerate(weights)]
    best = F.greatest(*draws) if len(draws) > 1 else draws[0]
    return -best["minus"]


def place(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, rows_a_group: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    weights = list(weights or [1.0] * shards)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    parts = max(0, (max(1, docs.count()) // rows_a_group // shards).bit_length())
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, [*weights, weights[0]]).alias("grown_shard"),
        _draw(key, "").alias("h"),
    ).withColumn("part", F.shiftright("h", HASH_BITS - parts))
    counts = keyed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("h", "doc_id", "text_crc32", "size")) - 1
    rows = keyed.withColumn("within", within).join(before, ["shard", "part"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), "grown_shard")
