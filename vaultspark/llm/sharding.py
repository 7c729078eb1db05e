"""Sharding over fixed virtual slots.

Records are hashed by their text into a fixed number of virtual slots, so
equal texts stay together. Bytes are summed by slot, and a slot-to-shard map
is fitted to those sums: it is a small table with a version that holds every
slot, also those that are empty yet, so that it places any record; rebalancing
or growing edits single entries of it. A slot far above a shard's share is
split further by another hash of the text, and only a text that alone has more
than a shard's share (a group of copies that is too hot) by the record's id.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultspark.llm.shared import folder, written
from vaultspark.llm.textvec import quoted

SLOTS = 6144
#: A slot of more than this part of a shard's fair share is split by text.
HOT = 1 / 4
Entry = tuple[int, int]  # slot, part of a split slot


@dataclass
class SlotMap:
    """Where each entry goes. splits: of each split slot, by text part, into how many parts its records go by id."""

    shards: int
    slots: int = SLOTS
    version: int = 1
    splits: dict[int, list[int]] = field(default_factory=dict)
    shard_of: dict[Entry, int] = field(default_factory=dict)

    def entries(self) -> list[Entry]:
        """All that a record can belong to."""
        return [(s, p) for s in range(self.slots) for p in range(sum(self.splits.get(s, [1])))]

    def part(self, slot: Column, text_hash: Column, doc_id: Column) -> Column:
        """The part of its slot that a record belongs to."""
        if not self.splits:
            return F.lit(0)
        listed = {s: [(sum(n[:k]), n[k]) for k in range(len(n))] for s, n in self.splits.items()}
        cells = F.create_map(*(x for s, own in sorted(listed.items()) for x in (F.lit(s), F.array(*(F.struct(F.lit(a).alias("begin"), F.lit(n).alias("n")) for a, n in own)))))
        own = F.element_at(cells, slot)
        cell = F.get(own, F.pmod(text_hash, F.size(own).cast("long")).cast("int"))
        return F.coalesce(cell["begin"] + F.pmod(F.xxhash64(doc_id), cell["n"].cast("long")).cast("int"), F.lit(0))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, self.slots, s, p, self.splits.get(s), to) for (s, p), to in sorted(self.shard_of.items())]
        return spark.createDataFrame(rows, "version int, shards int, slots int, virtual_slot int, part int, splits array<int>, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the stored map; a version that is there already is an error."""
        try:
            used = {r["version"] for r in spark.read.parquet(path).select("version").distinct().collect()}
        except AnalysisException:  # nothing is stored yet
            used = set()
        if self.version in used:
            raise ValueError(f"version {self.version} of the map is stored already")
        self.table(spark).coalesce(1).write.partitionBy("version").mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the newest by default."""
        every = spark.read.parquet(path)
        version = version if version is not None else every.agg(F.max("version")).first()[0]
        rows = every.filter(F.col("version") == version).collect()  # a row a slot and part, whatever the corpus
        if not rows:
            raise ValueError(f"no version {version} of the map is stored")
        return SlotMap(rows[0]["shards"], rows[0]["slots"], version, {r["virtual_slot"]: r["splits"] for r in rows if r["splits"]}, {(r["virtual_slot"], r["part"]): r["shard"] for r in rows})

    def loads(self, sizes: dict[Entry, int]) -> list[int]:
        out = [0] * self.shards
        for e, to in self.shard_of.items():
            out[to] += sizes.get(e, 0)
        return out

    def rebalance(self, sizes: dict[Entry, int], tolerance: float = 0.01) -> SlotMap:
        """The next version: entries go from the fullest shard to the emptiest while that lowers their difference."""
        new = SlotMap(self.shards, self.slots, self.version + 1, dict(self.splits), dict(self.shard_of))
        loads, own = new.loads(sizes), defaultdict(set)
        for e, to in new.shard_of.items():
            own[to].add(e)
        fair = max(sum(loads) / self.shards, 1)
        while (gap := max(loads) - min(loads)) > tolerance * fair:
            a, b = loads.index(max(loads)), loads.index(min(loads))
            fits = [e for e in own[a] if 0 < sizes.get(e, 0) < gap]
            if not fits:
                break
            e = min(fits, key=lambda e: (abs(2 * sizes[e] - gap), e))
            own[a].discard(e)
            own[b].add(e)
            new.shard_of[e] = b
            loads[a] -= sizes[e]
            loads[b] += sizes[e]
        return new

    def grow(self, sizes: dict[Entry, int]) -> SlotMap:
        """The next version, with one more shard: entries move into that shard only, until it has a fair share."""
        new = SlotMap(self.shards + 1, self.slots, self.version + 1, dict(self.splits), dict(self.shard_of))
        loads = new.loads(sizes)
        fair, last = sum(loads) / new.shards, self.shards
        for e in sorted(sizes, key=lambda e: (-sizes[e], e)):
            a = new.shard_of[e]
            if a != last and loads[a] - sizes[e] >= 0.98 * fair and loads[last] + sizes[e] <= fair:
                new.shard_of[e] = last
                loads[a] -= sizes[e]
                loads[last] += sizes[e]
        return new


def fitted(sizes: dict[Entry, int], shards: int, slots: int = SLOTS, splits: dict[int, list[int]] | None = None) -> SlotMap:
    """A first map of every entry, by falling size, each to the shard that is emptiest then; empty ones are dealt in turn."""
    heap = [(0, 0, k) for k in range(shards)]
    out = SlotMap(shards, slots, 1, dict(splits or {}))
    for e in sorted(out.entries(), key=lambda e: (-sizes.get(e, 0), e)):
        load, n, k = heapq.heappop(heap)
        out.shard_of[e] = k
        heapq.heappush(heap, (load + sizes.get(e, 0), n + 1, k))
    return out


def records(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """A narrow row for each record: doc_id, size, text_crc32, virtual_slot and text_hash. Null text: no bytes."""
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    return docs.select(
        quoted(doc_id).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(body), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.xxhash64(body, F.lit(1)).alias("text_hash"),
    )


def summed(rows: DataFrame, slot_map: SlotMap) -> dict[Entry, tuple[int, int, bool, bool]]:
    """Bytes and rows of each entry of the map, whether it holds one text, and whether one id; at most slots and their parts."""
    part = slot_map.part(F.col("virtual_slot"), F.col("text_hash"), F.col("doc_id"))
    one = lambda c: F.min(c).eqNullSafe(F.max(c))
    found = rows.groupBy("virtual_slot", part.alias("part")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), one("text_hash").alias("t"), one(F.xxhash64("doc_id")).alias("i"))
    return {(r["virtual_slot"], r["part"]): (r["b"], r["n"], r["t"], r["i"]) for r in found.collect()}


def splits_of(rows: DataFrame, shards: int, slots: int) -> tuple[dict[int, list[int]], dict[Entry, tuple[int, int, bool, bool]]]:
    """How hot slots are split, and the sums of all entries then.

    By text, into ever more parts until a part is within a quarter of a
    shard's share or holds one text; then a text that alone exceeds a shard's
    share by id, until that holds for its parts or they are of one id.
    """
    sums = summed(rows, SlotMap(shards, slots))
    fair = max(1.0, sum(b for b, *_ in sums.values()) / shards)
    splits: dict[int, list[int]] = {}
    while True:
        more: dict[int, list[int]] = {}
        for s in {s for s, _ in sums}:
            n = splits.get(s, [1])
            own = [sums.get((s, p)) for p in range(sum(n))]
            if any(x and x[0] > HOT * fair and not x[2] for x in own):
                more[s] = [1] * (4 * len(n) + 1)
                continue
            cells = [own[sum(n[:k]) : sum(n[: k + 1])] for k in range(len(n))]
            wide = [4 * n[k] if any(x and x[0] > fair and not x[3] for x in c) else n[k] for k, c in enumerate(cells)]
            if wide != n:
                more[s] = wide
        if not more:
            return splits, sums
        splits |= more
        hot = rows.filter(F.col("virtual_slot").isin(list(more)))
        sums = {e: x for e, x in sums.items() if e[0] not in more} | summed(hot, SlotMap(shards, slots, 1, splits))


def place(rows: DataFrame, slot_map: SlotMap, counts: dict[Entry, int]) -> DataFrame:
    """Add part, shard and slot, the place of a row in its shard, gapless from 0.

    Rows are numbered within their entry only, and an entry starts where those
    before it in its shard end; so no task holds a shard. counts: the rows of
    each entry under this map.
    """
    spark, begin, to = rows.sparkSession, [0] * slot_map.shards, []
    for e, k in sorted(slot_map.shard_of.items()):
        to.append((*e, k, begin[k]))
        begin[k] += counts.get(e, 0)
    where = spark.createDataFrame(to, "virtual_slot int, part int, shard int, begin long")  # a row a slot and part
    keyed = rows.withColumn("part", slot_map.part(F.col("virtual_slot"), F.col("text_hash"), F.col("doc_id")))
    number = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size"))
    return keyed.withColumn("number", number).join(F.broadcast(where), ["virtual_slot", "part"]).withColumn("slot", F.col("begin") + F.col("number") - 1).drop("begin", "number", "text_hash")


def assign(docs: DataFrame, slot_map: SlotMap, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Place records by a map as it is: every record has an entry, whether or not the map's bytes had one there."""
    rows = written(records(docs, doc_id=doc_id, text=text, slots=slot_map.slots))
    return place(rows, slot_map, {e: n for e, (_, n, *_) in summed(rows, slot_map).items()})


def shard(docs: DataFrame, shards: int, *, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every record into one of the shards so that their bytes are near equal.

    Returns doc_id, size (UTF-8 bytes of the text, null: none, plus 8),
    text_crc32, virtual_slot, part, shard and slot. Equal texts share a shard
    unless they alone exceed its share; null and empty texts count as equal.
    Records of null id are hashed like others; repeated rows get places of
    their own; extra columns are left out; an empty table gives no rows. The
    map is stored as version 1 at map_path (by default in the shared folder)
    and records are placed by the stored one.
    """
    spark = docs.sparkSession
    rows = written(records(docs, doc_id=doc_id, text=text, slots=slots))
    splits, sums = splits_of(rows, shards, slots)
    path = map_path or folder(spark)
    fitted({e: b for e, (b, *_) in sums.items()}, shards, slots, splits).save(spark, path)
    return place(rows, SlotMap.load(spark, path, 1), {e: n for e, (_, n, *_) in sums.items()})
