"""Sharding over fixed virtual slots.

Records are hashed into SLOTS slots, bytes are summed for each slot, and a versioned map says
which shard each slot belongs to.  Rebalancing edits the map: slots leave shards that are too
heavy for shards that are too light, all others stay where they are.  What is gathered is one
row a slot, however many records there are.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import gapless_positions, new_folder, text_or_empty, written

SLOTS = 16_384


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot]; version counts the edits, moved the slots of the last one."""

    shards: int
    shard_of: tuple[int, ...]
    version: int = 1
    moved: int = 0
    history: tuple[str, ...] = field(default=())

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(shards, tuple(s % shards for s in range(slots)), history=(f"1: {slots} slots over {shards} shards in turn",))

    def loads(self, slot_bytes: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, n in slot_bytes.items():
            out[self.shard_of[slot]] += n
        return out

    def _edited(self, shard_of: list[int], shards: int, why: str) -> SlotMap:
        moved = sum(a != b for a, b in zip(self.shard_of, shard_of))
        version = self.version + 1
        return SlotMap(shards, tuple(shard_of), version, moved, (*self.history, f"{version}: {why}, {moved} slots moved"))

    def rebalanced(self, slot_bytes: dict[int, int]) -> SlotMap:
        """Move slots until no move or exchange of two slots brings the heaviest and lightest shard closer.

        Heavy shards first give up slots, largest first, as far as they exceed the mean; the slots
        given up go, largest first, to the lightest shard; then the two outermost shards move or
        exchange slots as long as that narrows the gap.
        """
        shard_of = list(self.shard_of)
        inside: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, n in slot_bytes.items():
            if n > 0:
                inside[shard_of[slot]].append(slot)
        loads = self.loads(slot_bytes)
        mean = sum(loads) / self.shards
        pool: list[int] = []
        for shard, slots in enumerate(inside):
            slots.sort(key=lambda s: (-slot_bytes[s], s))
            stay = []
            for slot in slots:
                if loads[shard] - slot_bytes[slot] >= mean:
                    loads[shard] -= slot_bytes[slot]
                    pool.append(slot)
                else:
                    stay.append(slot)
            if loads[shard] > mean and stay:  # the smallest slot that brings it to the mean or below
                out = next((s for s in reversed(stay) if loads[shard] - slot_bytes[s] <= mean), stay[0])
                stay.remove(out)
                loads[shard] -= slot_bytes[out]
                pool.append(out)
            inside[shard] = stay
        heap = [(n, shard) for shard, n in enumerate(loads)]
        heapq.heapify(heap)
        for slot in sorted(pool, key=lambda s: (-slot_bytes[s], s)):
            n, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            inside[shard].append(slot)
            loads[shard] = n + slot_bytes[slot]
            heapq.heappush(heap, (loads[shard], shard))
        self._narrow(shard_of, inside, loads, slot_bytes)
        return self._edited(shard_of, self.shards, "rebalanced by bytes")

    def _narrow(self, shard_of: list[int], inside: list[list[int]], loads: list[int], size: dict[int, int], rounds: int = 2_000) -> None:
        import bisect

        for _ in range(rounds):
            heavy, light = max(range(self.shards), key=loads.__getitem__), min(range(self.shards), key=loads.__getitem__)
            gap = loads[heavy] - loads[light]
            others = sorted((size[s], s) for s in inside[light])
            others.insert(0, (0, -1))
            best = None
            for a in inside[heavy]:  # what moves over, less what comes back, should be half the gap
                want = size[a] - gap / 2
                i = bisect.bisect_left(others, (want, -1))
                for n, b in others[max(0, i - 1) : i + 1]:
                    left = abs(gap - 2 * (size[a] - n))
                    if 0 < size[a] - n < gap and (best is None or left < best[0]):
                        best = (left, a, b)
            if best is None or best[0] >= gap:
                return
            _, a, b = best
            for slot, old, new in ((a, heavy, light), (b, light, heavy)):
                if slot >= 0:
                    shard_of[slot] = new
                    inside[old].remove(slot)
                    inside[new].append(slot)
                    loads[old] -= size[slot]
                    loads[new] += size[slot]

    def grown(self, slot_bytes: dict[int, int] | None = None) -> SlotMap:
        """One more shard, which takes its share of slots from all others; no slot moves between old shards."""
        share, shard_of, new = len(self.shard_of) // (self.shards + 1), list(self.shard_of), self.shards
        size = slot_bytes or dict.fromkeys(range(len(shard_of)), 1)
        loads = [0] * self.shards
        inside: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(shard_of):
            loads[shard] += size.get(slot, 0)
            inside[shard].append(slot)
        heap = [(-n, shard) for shard, n in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(share):
            n, shard = heapq.heappop(heap)
            slot = inside[shard].pop()
            shard_of[slot] = new
            heapq.heappush(heap, (n + size.get(slot, 0), shard))
        return self._edited(shard_of, self.shards + 1, "one more shard")

    def save(self, spark: SparkSession, path: str) -> DataFrame:
        """Store this version: a file of slots under a fresh name, then a row in `versions` that names it.

        A save that ends between the two leaves a file that no row names, and two saves of one
        version at once leave two files of which `load` takes one; no map mixes the slots of two.
        """
        name = f"v{self.version}-{uuid.uuid4().hex}"
        slots = self.table(spark)
        slots.coalesce(1).write.parquet(f"{path}/slots/{name}")
        about = [(self.version, name, self.shards, self.moved, list(self.history))]
        spark.createDataFrame(about, "version int, file string, shards int, moved int, history array<string>").coalesce(1).write.mode("append").parquet(f"{path}/versions")
        return slots

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The last stored version (of equals the first by file name), or None where nothing is stored; a version counts once its row in `versions` is there."""
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
        if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return None
        last = spark.read.parquet(f"{path}/versions").orderBy(F.desc("version"), "file").first()
        if last is None:
            return None
        rows = spark.read.parquet(f"{path}/slots/{last['file']}").collect()  # a row a slot
        shard_of = tuple(r["map_shard"] for r in sorted(rows, key=lambda r: r["map_slot"]))
        return cls(last["shards"], shard_of, last["version"], last["moved"], tuple(last["history"]))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "map_version int, map_slot int, map_shard int")


def virtual_slot(df: DataFrame, id_col: str, text_col: str, slots: int = SLOTS) -> DataFrame:
    """doc id, size, text_crc32 and virtual slot of each record, and the partition that made it.

    size: UTF-8 bytes of the text (null: none) plus 8.  The slot hashes the id; a null id has a
    slot like any other, so records that share an id share its slot.
    """
    text = F.col(f"`{text_col}`").cast("string")
    return df.select(
        F.col(f"`{id_col}`"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.spark_partition_id().alias("_piece"))


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes of each slot; one row a slot reaches the driver."""
    return {r["virtual_slot"]: r["n"] for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("n")).collect()}


def shard(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every record into a shard, sizes near equal, and number the records of each shard.

    The last map stored at map_path is loaded and edited by the bytes of the slots, so records
    stay in their shards but for the slots that the edit moves; where more shards are asked for,
    the map grows first.  Without a stored map the slots are dealt in turn (version 1).  Each
    edit is stored as a new version beside the others, and the last one is used.  Without
    map_path the map lives in the scratch folder, for this call alone.
    Returns id, size, text_crc32, law (`bytes`), shard, slot (place in the shard, gapless from
    0), grown_shard (null for this law), virtual_slot and map_version.  An empty table gives an
    empty result.  Records with one id or one slot stay together in one shard.
    """
    spark = df.sparkSession
    records = written(virtual_slot(df, id_col, text_col, slots), "slots")
    path = map_path or new_folder(spark, "slot-map")
    sizes, last = slot_bytes(records), SlotMap.load(spark, path) if map_path else None
    if last is None:
        last = SlotMap.first(shards, slots)
        last.save(spark, path)
    elif len(last.shard_of) != slots or last.shards > shards:
        raise ValueError(f"the stored map has {len(last.shard_of)} slots and {last.shards} shards")
    while last.shards < shards:
        last = last.grown(sizes)
        last.save(spark, path)
    last = last.rebalanced(sizes)
    current = last.save(spark, path)
    placed = records.join(F.broadcast(current), F.col("virtual_slot") == F.col("map_slot")).withColumnRenamed("map_shard", "shard")
    numbered = gapless_positions(placed, "shard", [f"`{id_col}`", "text_crc32"], "slot", "_piece")
    return numbered.select(
        F.col(f"`{id_col}`"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", "map_version")
