"""Shard placement by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own (a start and a step from its name's hash);
the shards take turns to claim their next free slot. Shards get equal shares to within one slot, and a change of the
shard list moves few slots. The table has a fixed size, is broadcast, and places a row in constant time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, SHARDS = 65_537, 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _preference(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard."""
    if not is_prime(slots):
        raise ValueError(f"{slots} is not prime, so a step might not visit every slot")
    if not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("between one and `slots` distinct shards are needed")
    owner, taken = [-1] * slots, 0
    at, step = map(list, zip(*(_preference(x, slots) for x in shards), strict=True))
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            taken += 1
            if taken == slots:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its MD5 sum, modulo the table's size."""
    return (F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots).cast("int")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def place(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``docs`` with the columns slot (int) and shard (string); columns of these names are replaced.

    A row's key is its doc_id; a row without one is placed by its text, a row without both like an empty text. Repeated
    rows share a shard; a very long text matters only where it is the key. Only the lookup table, of ``slots`` rows, is broadcast; documents aren't shuffled.
    """
    names = shards or shard_names()
    table = docs.sparkSession.createDataFrame([(k, names[i]) for k, i in enumerate(lookup_table(names, slots))], "slot int, shard string")
    missing = F.lit(None).cast("string")
    by_id, by_text = (F.col(c).cast("string") if c in docs.columns else missing for c in ("doc_id", "text"))
    key = F.coalesce(by_id, F.concat(F.lit("text:"), by_text), F.lit("text:"))
    return docs.drop("slot", "shard").withColumn("slot", slot_of(key, slots)).join(F.broadcast(table), "slot", "left").select(*[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")
