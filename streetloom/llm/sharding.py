"""Weighted rendezvous sharding [native]: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, gapless, materialize, with_row_key


def _score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u), u in (0, 1) from the first 52 bits of md5('key:shard')."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.lit(float(weight)) / F.ln((bits + 0.5) / float(1 << 52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard of each key: the highest score wins, the smaller shard on a tie. A null key counts as ''."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    best = F.greatest(*(F.struct(_score(key, i, w).alias("s"), F.lit(-i).alias("n")) for i, w in enumerate(weights)))
    return (-best["n"]).cast("int")


def shard_rows(docs: DataFrame, weights: list[float] | int = 8, grown_weight: float = 1.0) -> DataFrame:
    """Each document's shard by its doc_id, by weighted rendezvous hashing, and where it goes with one more shard.

    Law `key`: doc_id and the shards decide alone, so a new shard only takes rows, none move between old shards.
    Null text: 0 bytes, crc32 0, size 1. Null doc_id: key ''. Rows of one doc_id share a shard; repeated rows each
    have a slot. Slots are numbered without gaps in each shard. Empty table: no rows. Other columns are ignored.
    """
    weights = [1.0] * weights if isinstance(weights, int) else [float(w) for w in weights]
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_row_key(docs, "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", rendezvous(F.col("doc_id"), weights).alias("shard"), rendezvous(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"), F.lit("key").alias("law"))
    rows = materialize(rows, "shards")
    return gapless(rows, ["shard"], ["doc_id", FILE, ROW], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
