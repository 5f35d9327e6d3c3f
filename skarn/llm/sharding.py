"""Sharding through fixed virtual slots: records hash into thousands of slots, and a versioned map deals slots to shards.

A record's virtual slot depends on its key alone and never changes. What changes is the map from slots to shards: a stored
table (version, slot, part, parts, shard, bytes) that covers all slots. The first version deals whole slots, largest
first onto the lightest shard. Every later one is an edit of the one before, a version of its own: slots that are too heavy
are split, and pieces move off shards that are heavier than their share or closed. Moving data is then moving pieces.

A slot that is over ``SPLIT_SHARE`` of a shard's fair share (one key may have a third of all rows) can't be halved by its
key. It is cut into parts of about ``PART_SHARE`` of the fair share by a hash of whole rows, and rows equal in key and
text, of which one group may be as large and any one may stand for another, by their place in the read. The planner sees
at most SLOTS + shards / PART_SHARE counts, whatever the number of rows.

Only DataFrame functions touch the rows. Shards come from a stored version, for the table it was planned from as for any
other (``place``); positions in a shard are counted on the rows that are placed: rows of the pieces before, and the row's
place in its own piece, so that no task sorts a whole shard.

Defined cases: a null text counts as empty; null keys form a slot by hash like any other; equal rows are all placed, and
equal texts under different keys are in the slots of their keys, so that a group of copies is spread; texts of any length
are whole records; an empty table gives an empty result and a map that deals all slots; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranks
from .common import Stored, named, planned, shared_folder

SLOTS, SHARDS, OVERHEAD = 4096, 40, 16
SPLIT_SHARE, PART_SHARE, TOLERANCE = 0.05, 0.01, 0.002


@dataclass(frozen=True)
class Piece:
    """A slot, or one part of a split slot, on its shard."""

    slot: int
    part: int
    parts: int
    shard: int
    bytes: int


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def record_bytes(text_column: str) -> Column:
    return (F.octet_length(F.coalesce(named(text_column), F.lit(""))) + F.lit(OVERHEAD)).cast("long")


def deal(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> list[Piece]:
    """A first map of all slots, by the bytes of those that have rows; empty slots go round."""
    light = [(0, 0, s) for s in range(shards)]
    out = []
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, many, shard = heapq.heappop(light)
        out.append(Piece(slot, 0, 1, shard, sizes.get(slot, 0)))
        heapq.heappush(light, (load + out[-1].bytes, many + 1, shard))
    return out


def split(pieces: list[Piece], parts: dict[int, list[int]]) -> list[Piece]:
    """The map with some whole slots cut into parts of these bytes, all still on the slot's shard."""
    out = []
    for p in pieces:
        own = parts.get(p.slot)
        out += [p] if own is None else [Piece(p.slot, part, len(own), p.shard, size) for part, size in enumerate(own)]
    return out


def rebalance(pieces: list[Piece], shards: int, tolerance: float = TOLERANCE) -> list[Piece]:
    """An edited map for this number of shards. All pieces of closed shards leave; shards heavier than the fair share by more
    than the tolerance shed pieces, largest first, each that leaves them no lighter than the share less the tolerance.
    What left goes to the lightest shards, largest first; all other pieces stay."""
    fair = sum(p.bytes for p in pieces) / shards
    load = dict.fromkeys(range(shards), 0)
    stay: list[Piece] = []
    moving: list[Piece] = []
    by_shard: dict[int, list[Piece]] = defaultdict(list)
    for p in pieces:
        by_shard[p.shard].append(p)
    for shard, own in by_shard.items():
        total = sum(p.bytes for p in own)
        for p in sorted(own, key=lambda p: (-p.bytes, p.slot, p.part)):
            if shard >= shards or (p.bytes and total > fair * (1 + tolerance) and total - p.bytes >= fair * (1 - tolerance)):
                total -= p.bytes
                moving.append(p)
            else:
                stay.append(p)
        if shard < shards:
            load[shard] = total
    light = [(b, 0, s) for s, b in load.items()]
    heapq.heapify(light)
    for p in sorted(moving, key=lambda p: (-p.bytes, p.slot, p.part)):
        total, many, shard = heapq.heappop(light)
        stay.append(replace(p, shard=shard))
        heapq.heappush(light, (total + p.bytes, many + 1, shard))
    return sorted(stay, key=lambda p: (p.slot, p.part))


MAP_SCHEMA = "version long, slot int, part int, parts int, shard int, bytes long"


def write_map(pieces: list[Piece], version: int, path: str, spark: SparkSession) -> None:
    """Adds a version to the stored map; an older version is never changed."""
    rows = planned(spark, [[version, p.slot, p.part, p.parts, p.shard, p.bytes] for p in pieces], MAP_SCHEMA)
    rows.coalesce(1).write.mode("error").parquet(f"{path}/map_version={version}")


def map_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored rows of a version, the last one if none is named."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[Piece]:
    return sorted((Piece(r["slot"], r["part"], r["parts"], r["shard"], r["bytes"]) for r in map_table(spark, path, version).collect()), key=lambda p: (p.slot, p.part))


def slotted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, vslot, content, place) of docs: a hash of the row, and one of its place in the read.
    To be stored."""
    text = F.coalesce(named(text_column), F.lit(""))
    key = named(id_column).cast("long")
    return docs.select(
        key.alias("doc_id"),
        record_bytes(text_column).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(key).alias("vslot"),
        F.xxhash64(key, text).alias("content"),
        F.xxhash64(F.monotonically_increasing_id()).alias("place"),
    )


def _parted(rows: DataFrame, parts: DataFrame, part_bytes: float) -> DataFrame:
    """rows with their part. parts: (slot, parts) of all slots, a broadcast of at most SLOTS rows. Groups of equal rows that
    are heavier than a part, so few that they are broadcast, are dealt by place; all others by content."""
    known = rows.join(F.broadcast(parts.withColumnRenamed("slot", "vslot")), "vslot")
    groups = known.where("parts > 1").groupBy("content").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > part_bytes)
    copies = groups.select("content", F.lit(True).alias("copied"))  # at most shards / PART_SHARE rows of the planned table
    spread = F.when(F.col("copied"), F.col("place")).otherwise(F.xxhash64("content"))
    return known.join(F.broadcast(copies), "content", "left").withColumn("part", F.pmod(spread, F.col("parts")).cast("int")).drop("copied")


def plan(rows: DataFrame, shards: int, path: str) -> int:
    """Plans a map for the stored rows of ``slotted`` and writes its versions: a first one of whole slots, and where this is
    uneven the edit that splits and moves. The last version."""
    spark = rows.sparkSession
    counted = {r["vslot"]: (r["bytes"], r["n"]) for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # at most SLOTS rows
    fair = sum(b for b, _ in counted.values()) / shards
    pieces = deal({s: b for s, (b, _) in counted.items()}, shards)
    write_map(pieces, 1, path, spark)
    many = {s: math.ceil(b / (PART_SHARE * fair)) for s, (b, n) in counted.items() if n > 1 and b > SPLIT_SHARE * fair}
    if many:
        table = planned(spark, [[s, n] for s, n in sorted(many.items())], "slot int, parts int")
        sizes = {s: [0] * n for s, n in many.items()}
        for r in _parted(rows, table, PART_SHARE * fair).groupBy("vslot", "part").agg(F.sum("size").alias("bytes")).collect():  # at most shards / PART_SHARE rows and one for each slot
            sizes[r["vslot"]][r["part"]] = r["bytes"]
        pieces = split(pieces, sizes)
    edited = rebalance(pieces, shards)
    if edited == read_map(spark, path, 1):
        return 1
    write_map(edited, 2, path, spark)
    return 2


def shard(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", map_path: str | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot, vslot, map_version): the shard, and the place in it (0, 1, ... without
    gaps). Sizes of shards are near equal. The map is stored at ``map_path``, or in the shared folder, and read from there."""
    spark = docs.sparkSession
    path = map_path or f"{shared_folder(spark)}/skarn/sharding-map-{uuid.uuid4().hex}"
    rows = Stored(slotted(docs, id_column, text_column), "sharding-rows").df
    version = plan(rows, shards, path)
    return place(rows, path, shards, version)


def place(rows: DataFrame, path: str, shards: int = SHARDS, version: int | None = None) -> DataFrame:
    """The shards and places of the stored rows of ``slotted``, of any table, by a stored version of a map."""
    chart = map_table(rows.sparkSession, path, version)
    total = chart.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    dealt = _parted(rows, chart.where("part = 0").select("slot", "parts"), PART_SHARE * total / shards)
    pieces = chart.select(F.col("slot").alias("vslot"), "part", "shard", F.col("version").alias("map_version"))
    dealt = dealt.join(F.broadcast(pieces), ["vslot", "part"])  # at most SLOTS + shards / PART_SHARE rows and one for each slot
    counts = dealt.groupBy("shard", "vslot", "part").agg(F.count("*").alias("n"))
    first = ranks.before_units(counts.withColumn("piece", F.struct("vslot", "part")), ["shard"], "piece").select("vslot", "part", "before")
    inside = ranks.within_unit(["vslot"], "part", ["doc_id", "text_crc32", "size"])
    ranked = dealt.withColumn("inside", inside).join(F.broadcast(first), ["vslot", "part"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).alias("slot"), "vslot", "map_version")
