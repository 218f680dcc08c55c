"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read

#: A prime; the table has this many slots however many rows there are, so its broadcast is bounded.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Which shard owns each slot, as a position in shards.

    Each shard's preference order is the arithmetic progression (offset + k * skip) mod size, a
    permutation as size is prime.  Shards take turns, in order of their names, and each claims the
    first free slot it prefers, until none is free; so shares differ by one slot at most, and a
    shard that leaves or joins moves few slots beyond its own share.
    """
    if not shards:
        raise ValueError("no shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime, and as many as the shards at least")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    offset = {i: _number(shards[i], "offset") % size for i in turns}
    skip = {i: 1 + _number(shards[i], "skip") % (size - 1) for i in turns}
    place = dict(offset)
    owner = np.full(size, -1, dtype=np.int32)
    free = size
    while free:
        for i in turns:
            while owner[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % size
            owner[place[i]] = i
            free -= 1
            if not free:
                break
    return owner


def shard(
    df: DataFrame, key_col: str, shards: list[str], size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard"
) -> DataFrame:
    """df with the slot of each row's key and the shard that owns it.

    The key is hashed as text; a null key has a fixed slot of its own hash.  Equal keys share a slot.
    Existing columns of these names are replaced.  The table is broadcast: at most `size` rows, which
    does not grow with the data.
    """
    owner = lookup_table(shards, size)
    spark = df.sparkSession
    slot, place = free_name(df.columns, "slot"), free_name(df.columns, "place")
    rows = [(i, shards[k]) for i, k in enumerate(owner.tolist())]
    table = spark.createDataFrame(rows, f"{slot} int, {place} string")
    hashed = F.xxhash64(F.coalesce(F.concat(F.lit("k"), F.col(f"`{key_col}`").cast("string")), F.lit("null")))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    out = df.withColumn(slot, F.pmod(hashed, F.lit(size)).cast("int"))
    return out.join(F.broadcast(table), slot).select(
        *kept, F.col(slot).alias(slot_col), F.col(place).alias(shard_col)
    )


#: Production parameters of the query.
SHARDS = [f"shard-{i:03d}" for i in range(256)]


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of each document's id; repeated rows share one, an empty table gives none."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return shard(docs, "doc_id", SHARDS)
