"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: an offset and a
skip drawn from its name. Shards take turns, each claiming its first slot still free, until
the table is full; so shares differ by one slot at most (or follow the weights), and adding
a shard moves few slots. A key goes to slot hash(key) mod size, then to that slot's shard.

Defined results: keys are read as text; a null key counts as the empty text; equal keys
share a shard; an empty table gives an empty result. The table has ``size`` rows whatever
the data, which bounds what is broadcast.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import free_name

SHARDS = 128
#: A prime, over a hundred slots a shard.
SIZE = 16381


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


@lru_cache(maxsize=16)
def lookup_table(names: tuple[str, ...], size: int = SIZE, weights: tuple[int, ...] | None = None) -> tuple[int, ...]:
    """The shard number of each slot. weights: turns that a shard gets in each round."""
    weights = weights or (1,) * len(names)
    if not _prime(size) or size < len(names):
        raise ValueError(f"the table's size must be a prime of at least {len(names)}: {size}")
    if not names or len(set(names)) < len(names) or len(weights) != len(names) or min(weights) < 0 or not any(weights):
        raise ValueError("shards need different names and a weight each, not all 0")
    draw = [hashlib.sha256(n.encode()).digest() for n in names]
    place = [int.from_bytes(d[:8], "big") % size for d in draw]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 2 else 1 for d in draw]
    slots, free = [-1] * size, size
    while True:
        for shard, turns in enumerate(weights):
            for _ in range(turns):
                while slots[place[shard]] >= 0:
                    place[shard] = (place[shard] + skip[shard]) % size
                slots[place[shard]] = shard
                free -= 1
                if not free:
                    return tuple(slots)


def shard_names(count: int = SHARDS) -> tuple[str, ...]:
    return tuple(f"shard-{i:05d}" for i in range(count))


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The first 60 bits of the MD5 of the key's text, modulo size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def slots_frame(spark: SparkSession, names: tuple[str, ...], size: int = SIZE, weights: tuple[int, ...] | None = None) -> DataFrame:
    """slot and shard as rows, from one array literal."""
    shards = json.dumps(lookup_table(names, size, weights))
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(shards), "array<int>")).alias("slot", "shard"))


def assign_shards(docs: DataFrame, key: str = "doc_id", names: tuple[str, ...] = shard_names(), size: int = SIZE, weights: tuple[int, ...] | None = None) -> DataFrame:
    """docs with slot and shard; no shuffle: the table of `size` rows is broadcast."""
    slot, shard = free_name(docs, "slot"), free_name(docs, "shard")
    slots = slots_frame(docs.sparkSession, names, size, weights).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    return docs.withColumn(slot, slot_of(F.col(key), size)).join(F.broadcast(slots), slot)


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", names: tuple[str, ...] = shard_names(), size: int = SIZE, files: int = 1) -> None:
    """A folder per shard with `files` files each; rows of one key are dealt over the files
    of their shard too, so a key with many rows doesn't land in one task. The folders are
    named shard=n, or _shard=n where docs has a column shard of its own."""
    out, shard = assign_shards(docs, key, names, size), free_name(docs, "shard")
    salt = F.pmod(F.xxhash64(*docs.columns), F.lit(files)) if files > 1 else F.lit(0)
    out.repartition(len(names) * files, shard, salt).write.partitionBy(shard).parquet(path)
