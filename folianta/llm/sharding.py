"""Sharding by fixed virtual slots.

A record hashes into one of ``slots`` virtual slots for good. Bytes are summed per slot (a
table of fixed size, however large the corpus), and a versioned map deals slots to shards,
heaviest first, each to the lightest shard. Maps are stored, one folder per version. When
records have come or gone, the newest stored map is edited: the next version moves a few
slots, as many as bring the shards back to nearly equal bytes; records never rehash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folianta.llm.common import cut, shared_dir

#: Virtual slots; fixed for the life of a corpus.
SLOTS = 8192
#: Share by which the heaviest shard may exceed the mean before slots move.
TOLERANCE = 0.002
#: Bytes counted for a record besides its text.
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot. Versions only ever grow."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())

    @staticmethod
    def build(loads: dict[int, int], slots: int, shards: int) -> SlotMap:
        """Version 1: slots by falling weight, each to the lightest shard (ties: the lower number)."""
        heap = [(0, s) for s in range(shards)]
        out = [0] * slots
        for slot in sorted(range(slots), key=lambda v: (-loads.get(v, 0), v)):
            load, shard = heapq.heappop(heap)
            out[slot] = shard
            heapq.heappush(heap, (load + max(1, loads.get(slot, 0)), shard))
        return SlotMap(1, shards, tuple(out))

    def loads(self, per_slot: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += per_slot.get(slot, 0)
        return out

    def rebalance(self, per_slot: dict[int, int], shards: int | None = None, tolerance: float = TOLERANCE) -> SlotMap:
        """The next version for new weights or another number of shards.

        Slots of shards that go away are dealt again; then slots move from the heaviest to
        the lightest shard while that narrows the gap and the heaviest is over the mean by
        more than ``tolerance``. Everything else stays where it is.
        """
        shards = shards or self.shards
        out = list(self.shard_of)
        held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        load = [0] * shards
        homeless = []
        for slot, shard in enumerate(out):
            w = per_slot.get(slot, 0)
            if shard < shards:
                held[shard].append((w, slot))
                load[shard] += w
            else:
                homeless.append((w, slot))
        for w, slot in sorted(homeless, key=lambda x: (-x[0], x[1])):
            s = min(range(shards), key=lambda i: (load[i], i))
            out[slot], load[s] = s, load[s] + w
            held[s].append((w, slot))
        mean = sum(load) / shards
        for _ in range(len(out)):
            top, low = max(range(shards), key=lambda i: (load[i], -i)), min(range(shards), key=lambda i: (load[i], i))
            gap = load[top] - load[low]
            if load[top] <= mean * (1 + tolerance):
                break
            best = max(((w, slot) for w, slot in held[top] if 0 < w < gap), key=lambda x: (-abs(x[0] - gap / 2), -x[1]), default=None)
            if best is None:
                break
            held[top].remove(best)
            held[low].append(best)
            out[best[1]] = low
            load[top] -= best[0]
            load[low] += best[0]
        moved = tuple(i for i, (a, b) in enumerate(zip(self.shard_of, out, strict=True)) if a != b)
        return replace(self, version=self.version + 1, shards=shards, shard_of=tuple(out), moved=moved)

    def save(self, spark: SparkSession, path: str) -> None:
        """One file per version below ``path``; an existing version is never overwritten."""
        row = [(self.version, self.shards, list(self.shard_of), list(self.moved), json.dumps({"slots": len(self.shard_of)}))]
        schema = "map_version int, shards int, shard_of array<int>, moved array<int>, note string"
        spark.createDataFrame(row, schema).coalesce(1).write.mode("error").parquet(f"{path.rstrip('/')}/v{self.version:08d}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the newest by default."""
        found = spark.read.option("recursiveFileLookup", "true").parquet(path)
        found = found.filter(F.col("map_version") == version) if version else found.orderBy(F.desc("map_version"))
        row = found.first()
        if row is None:
            raise LookupError(f"no such version: {version}")
        return SlotMap(row["map_version"], row["shards"], tuple(row["shard_of"]), tuple(row["moved"]))


    @staticmethod
    def newest(spark: SparkSession, path: str) -> SlotMap | None:
        """The newest stored version, or None where nothing is stored yet."""
        from pyspark.errors import AnalysisException

        try:
            return SlotMap.load(spark, path)
        except (AnalysisException, LookupError) as e:
            if isinstance(e, AnalysisException) and e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None


def slot_of(key: Column, *more: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record by its key and what else tells it apart; null is a value like others."""
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    return F.pmod(F.xxhash64(text, *more), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows). At most as many rows as there are slots reach the driver."""
    return {r["vslot"]: (r["b"], r["n"]) for r in records.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of each row."""
    text = F.col("text").cast("string")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    # a record without an id has no identity to be found by; its place in the read spreads a hot group of them
    lone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        crc.alias("text_crc32"),
        slot_of(F.col("doc_id"), crc, lone, slots=slots).alias("vslot"),
    )


def assign(records: DataFrame, slot_map: SlotMap, counts: dict[int, int]) -> DataFrame:
    """Shard of each record by the map, and its place in the shard.

    The place is the number of rows in the shard's earlier slots, known from the slot table,
    plus the row's rank in its own slot: thousands of small windows, none over a shard.
    The map is broadcast: one row for each slot, a fixed number.
    """
    offsets, seen = [0] * len(slot_map.shard_of), [0] * slot_map.shards
    for slot, shard in enumerate(slot_map.shard_of):
        offsets[slot] = seen[shard]
        seen[shard] += counts.get(slot, 0)
    lookup = records.sparkSession.createDataFrame(
        list(zip(range(len(offsets)), slot_map.shard_of, offsets, strict=True)),
        T.StructType([T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("offset", T.LongType())]),
    )
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size"))
    ranked = records.withColumn("place", rank)
    return ranked.join(F.broadcast(lookup), "vslot").withColumn("slot", (F.col("offset") + F.col("place") - 1).cast("long")).drop("place", "offset")


def current_map(spark: SparkSession, weights: dict[int, int], slots: int, shards: int, map_path: str | None) -> SlotMap:
    """The map to use: the newest stored one, edited and stored as the next version where the weights ask for it, or a new one."""
    held = SlotMap.newest(spark, map_path) if map_path else None
    if held is not None and len(held.shard_of) != slots:
        raise ValueError(f"the stored map has {len(held.shard_of)} slots, not {slots}; the number of slots is fixed for life")
    made = SlotMap.build(weights, slots, shards) if held is None else held.rebalance(weights, shards)
    if held is not None and made.shard_of == held.shard_of and made.shards == held.shards:
        return held
    if map_path:
        made.save(spark, map_path)
    return made


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per row of ``docs`` under the law ``bytes``: doc_id, size, text_crc32, law, shard,
    slot (place in the shard, from 0 without gaps), grown_shard (null under this law), vslot, map_version.

    The slot is that of id and text; rows without an id are spread by their place in the read. Null text has size
    16. Rows that repeat id and text stay together and get places of their own. Other columns are ignored;
    an empty table gives no rows. With ``map_path`` the newest map stored there is rebalanced for the
    new weights and stored as the next version if any slot moved; the first run stores version 1.
    """
    spark = docs.sparkSession
    records = cut(sized(docs, slots))
    loads = slot_loads(records)
    made = current_map(spark, {k: v[0] for k, v in loads.items()}, slots, shards, map_path)
    out = assign(records, made, {k: v[1] for k, v in loads.items()})
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").cast("long").alias("vslot"), F.lit(made.version).alias("map_version"),
    )


def map_path_of(spark: SparkSession, sf_dir: str, corpus: str) -> str:
    """Where the maps of a corpus are stored: a folder of the shared one, named by the corpus and its path."""
    return f"{shared_dir(spark).rstrip('/')}/slot-maps/{corpus}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
