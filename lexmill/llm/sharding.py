"""Sharding by fixed virtual slots: records are hashed into thousands of
slots, bytes are summed per slot, and a versioned map from slots to shards is
stored and edited when shards are rebalanced or added.

A record never changes its slot, so that an edit of the map (as many rows as
there are slots, whatever the input) is all that rebalancing needs. A map is a
folder of Parquet, one part per version, which are only ever added: a run given
its path starts from the last version, others can be read again.

Cases: a null text has no bytes and counts 1 for its row; a null id is hashed
like any other value; rows that are equal in id and text are spread over the
slots by their places in the input, and get different places in their shards;
an empty table gives an empty result and a map that spreads slots evenly. Only
the id and text columns are read, so that others cannot clash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, text_key

SLOTS = 4096
SEED = 17


class SlotMap:
    """The shard of every slot, by version. ``shards[v]`` is version v."""

    def __init__(self, n_shards: int, n_slots: int = SLOTS):
        self.n_shards = n_shards
        self.shards = [[slot * n_shards // n_slots for slot in range(n_slots)]]

    def rebalance(self, weights: dict[int, int]) -> int:
        """A further version with even sums of weights: slots leave the shards
        that hold more than the mean, heaviest first, and go to the lightest
        shard; then single slots move or swap as long as that narrows the gap."""
        old = self.shards[-1]
        mean = sum(weights.values()) / self.n_shards
        held = [0] * self.n_shards
        new = list(old)
        leaving: list[int] = []
        for slot in sorted(range(len(old)), key=lambda s: (-weights.get(s, 0), s)):
            w = weights.get(slot, 0)
            if held[old[slot]] + w <= mean or not held[old[slot]]:
                held[old[slot]] += w
            else:
                leaving.append(slot)
        light = [(h, shard) for shard, h in enumerate(held)]
        heapq.heapify(light)
        for slot in leaving:
            h, shard = heapq.heappop(light)
            new[slot] = shard
            held[shard] += weights.get(slot, 0)
            heapq.heappush(light, (held[shard], shard))
        self._narrow(new, held, weights)
        self.shards.append(new)
        return len(self.shards) - 1

    def _narrow(self, new: list[int], held: list[int], weights: dict[int, int], rounds: int = 2000) -> None:
        own: list[set[int]] = [set() for _ in held]
        for slot, shard in enumerate(new):
            own[shard].add(slot)
        for _ in range(rounds):
            top, low = max(range(len(held)), key=held.__getitem__), min(range(len(held)), key=held.__getitem__)
            gap = held[top] - held[low]
            give = sorted((weights.get(s, 0), s) for s in own[top])
            take = sorted((weights.get(s, 0), s) for s in own[low])
            best, j = (gap, None, None), 0
            for w, s in give:  # what moves should weigh half the gap more than what comes back
                if 0 < w < gap and abs(gap - 2 * w) < best[0]:
                    best = (abs(gap - 2 * w), s, None)
                while j + 1 < len(take) and take[j + 1][0] <= w - gap / 2:
                    j += 1
                for v, t in take[j:j + 2]:
                    if 0 < w - v < gap and abs(gap - 2 * (w - v)) < best[0]:
                        best = (abs(gap - 2 * (w - v)), s, t)
            _, s, t = best
            if s is None:
                return
            for slot, a, b in ((s, top, low), (t, low, top)):
                if slot is not None:
                    new[slot] = b
                    own[a].remove(slot)
                    own[b].add(slot)
                    held[a] -= weights.get(slot, 0)
                    held[b] += weights.get(slot, 0)

    def grow(self) -> int:
        """A further version with one more shard, which takes an even share of
        the slots of every other; no slot moves between the old shards."""
        new = list(self.shards[-1])
        for shard in range(self.n_shards):
            own = [s for s, x in enumerate(new) if x == shard]
            for slot in own[:: self.n_shards + 1]:
                new[slot] = self.n_shards
        self.n_shards += 1
        self.shards.append(new)
        return len(self.shards) - 1

    def move(self, slot: int, shard: int) -> int:
        """A further version with one slot elsewhere."""
        if not 0 <= shard < self.n_shards:
            raise ValueError(f"there is no shard {shard}")
        new = list(self.shards[-1])
        new[slot] = shard
        self.shards.append(new)
        return len(self.shards) - 1

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds the versions that the folder does not have yet."""
        known = _versions(spark, path)
        if known and known != list(range(len(known))) or len(known) > len(self.shards):
            raise ValueError(f"{path} holds versions {known} of another map")
        for v in range(len(known), len(self.shards)):
            rows = [(slot, shard, self.n_shards) for slot, shard in enumerate(self.shards[v])]
            spark.createDataFrame(rows, "vslot int, shard int, n_shards int").coalesce(1).write.parquet(f"{path}/version={v}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        rows = spark.read.parquet(path).orderBy("version", "vslot").collect()  # slots times versions
        out = cls(rows[-1].n_shards, 1 + max(r.vslot for r in rows))
        out.shards = [[] for _ in range(1 + max(r.version for r in rows))]
        for r in rows:
            out.shards[r.version].append(r.shard)
        return out

    @staticmethod
    def stored(spark: SparkSession, path: str, version: int) -> DataFrame:
        return spark.read.parquet(f"{path}/version={version}").select("vslot", "shard")


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, size in UTF-8 bytes plus 1, text_crc32, vslot, place). The hash
    covers the text, so that rows that share an id do not share a slot."""
    scratch = scratch or Scratch(docs.sparkSession, "slots")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    key = F.xxhash64(F.lit(SEED), F.col(id_col), text_key(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), key.alias("key"), F.monotonically_increasing_id().alias("place"))
    rows = scratch.save(rows, "rows")
    repeated = scratch.save(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(1).alias("again")), "repeated")
    spread = F.when(F.col("again") == 1, F.xxhash64("key", "place")).otherwise(F.col("key"))
    rows = rows.join(broadcast_if_small(repeated), "key", "left")
    return rows.select("doc_id", "size", "text_crc32", F.pmod(spread, F.lit(n_slots)).cast("int").alias("vslot"), "place")


def shard_by_slots(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Rows with size, text_crc32, virtual slot (vslot), shard and the place in
    the shard (slot, gapless from 0).

    A new map's first version spreads the slots evenly; a map that is stored
    under ``map_path`` (with as many slots and shards) is taken up instead. The
    next version evens out the shards' bytes; it is stored and read back. Places
    are numbered per slot, thousands of independent groups, and start at the rows
    of the shard's earlier slots."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = scratch.save(with_slots(docs, id_col, text_col, n_slots, scratch), "slotted")
    sums = {r.vslot: (r.bytes, r.n) for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    path = map_path or f"{scratch.base}/map"
    slot_map = SlotMap.load(spark, path) if _versions(spark, path) else SlotMap(n_shards, n_slots)
    if (slot_map.n_shards, len(slot_map.shards[-1])) != (n_shards, n_slots):
        raise ValueError(f"{path} maps {len(slot_map.shards[-1])} slots to {slot_map.n_shards} shards")
    version = slot_map.rebalance({s: b for s, (b, _) in sums.items()})
    slot_map.save(spark, path)
    starts, filled = [], [0] * n_shards
    for slot, shard in enumerate(slot_map.shards[version]):
        starts.append((slot, filled[shard]))
        filled[shard] += sums.get(slot, (0, 0))[1]
    offsets = spark.createDataFrame(starts, "vslot int, start long").coalesce(1)
    by_slot = F.broadcast(SlotMap.stored(spark, path, version).join(offsets, "vslot"))  # n_slots rows
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "place")) - 1
    return rows.withColumn("nth", place).join(by_slot, "vslot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).alias("slot"), "vslot", F.lit(version).alias("map_version")
    )
