"""Sharding by a minimax contiguous partition of atomic groups."""

from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._hot import salts
from ._scratch import stored

#: Hex digits of a group's name that make the first blocks; digits more for each refinement.
DIGITS, FINER = 3, 2


@dataclass
class Blocks:
    """Consecutive blocks of groups by the beginning of their names: sizes so far, and how many groups each holds."""

    names: list[str]
    sizes: list[int]
    counts: list[int]
    ends: list[int] = field(init=False)

    def __post_init__(self) -> None:
        total, self.ends = 0, []
        for n in self.sizes:
            total += n
            self.ends.append(total)

    def cut(self, x: int, hopeful: bool) -> tuple[int, int | None]:
        """The last place up to x where groups may be parted, and the block to look into if it isn't known: hopeful takes x itself then, else the block's begin."""
        i = bisect_right(self.ends, x)
        low = self.ends[i - 1] if i else 0
        if i == len(self.ends) or x == low or self.counts[i] == 1:
            return low, None
        return (x if hopeful else low), i

    def fill(self, capacity: int, shards: int, hopeful: bool) -> tuple[bool, list[int], list[int]]:
        """Greedily filled shards: whether all fits, the cuts, the blocks in doubt."""
        at, cuts, doubt = 0, [], []
        for _ in range(shards):
            at, block = self.cut(at + capacity, hopeful)
            cuts.append(at)
            if block is not None:
                doubt.append(block)
        return at >= self.ends[-1], cuts, doubt

    def least(self, shards: int, low: int, high: int, hopeful: bool) -> int:
        """The smallest capacity from low to high that fits all; high does."""
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, hopeful)[0]:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """For groups (name, bytes) in order of name: the cumulative bytes at which the shards end, for the smallest capacity that the greedy filling
    fits in. The driver sees sums of blocks only; blocks that a cut may fall into are split again until each cut is known."""

    def blocks_of(rows: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        got = rows.groupBy(F.substring("name", 1, digits).alias("name")).agg(F.sum("bytes").alias("n"), F.count("*").alias("k")).collect()
        return sorted((r.name, r.n, r.k) for r in got)

    rows = blocks_of(groups, DIGITS)
    if not rows:
        return [0] * shards
    largest, total = groups.agg(F.max("bytes"), F.sum("bytes")).first()
    low, high = max(largest, -(-total // shards)), total // shards + largest + 1
    while True:
        b = Blocks(*(list(x) for x in zip(*rows)))
        low = b.least(shards, low, high, True)
        high = b.least(shards, low, high, False) if b.fill(high, shards, False)[0] else high
        doubt: set[int] = set()
        early, late = b.fill(low, shards, False), b.fill(high, shards, True)
        for x, y in zip(early[1], late[1]):
            i, j = bisect_right(b.ends, x), min(bisect_right(b.ends, y), len(rows) - 1)
            doubt |= {k for k in range(i, j + 1) if b.counts[k] > 1}
        if low == high and not b.fill(low, shards, False)[2]:
            return b.fill(low, shards, False)[1]
        names = [b.names[k] for k in sorted(doubt)] or [b.names[k] for k in b.fill(low, shards, False)[2]]
        by_length: dict[int, list[str]] = {}
        for x in names:
            by_length.setdefault(len(x), []).append(x)
        finer = []
        for digits, own in by_length.items():
            finer += blocks_of(groups.where(F.substring("name", 1, digits).isin(own)), digits + FINER)
        gone = set(names)
        rows = sorted([r for r in rows if r[0] not in gone] + finer)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (gapless from 0) for each row; rows of equal texts stay together.

    The groups of equal texts stand in the order of their texts' MD5 and are cut into `shards` runs, so that the largest is as small as can
    be: a larger group than a fair share makes it that large, and may leave the last shards empty. A null text has one byte, checksum 0 and
    is a group of its own; an empty one likewise. Slots follow the groups' order; in a group, parts by a hash of the id and the partition read, then the ids.
    Repeated rows and null ids have a slot each. Other columns are ignored.

    A group's rows are dealt into parts, whatever their ids are; parts are counted and placed, and only a part's rows are ordered in one task.
    """
    text = F.col(text_col)
    name = F.coalesce(F.md5(text.cast("binary")), F.lit("null"))  # no MD5 reads so
    part = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(salts(docs.count()))).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), name.alias("name"))
    rows = stored(rows.withColumn("part", part), "rows")
    parts = stored(rows.groupBy("name", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "parts")
    groups = stored(parts.groupBy("name").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), "groups")
    cuts = minimax_cuts(groups, shards)
    # running sums: of blocks first, then inside each
    block = F.substring("name", 1, DIGITS)
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = groups.groupBy(block.alias("block")).agg(F.sum("bytes").alias("b"), F.sum("n").alias("k"))
    sums = sums.select("block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("b", "k")))
    inside = W.partitionBy("block").orderBy("name").rowsBetween(W.unboundedPreceding, 0)
    groups = groups.withColumn("block", block).join(F.broadcast(sums), "block")  # at most 16 ** DIGITS + 1 rows
    groups = groups.withColumn("upto", F.col("b") + F.sum("bytes").over(inside)).withColumn("rank", F.col("k") + F.sum("n").over(inside) - F.col("n"))
    number = sum((F.when(F.col("upto") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    groups = stored(groups.select("name", "rank", number.cast("int").alias("shard")), "places")
    base = groups.groupBy("shard").agg(F.min("rank").alias("base"))
    groups = groups.join(F.broadcast(base), "shard").select("name", "shard", (F.col("rank") - F.col("base")).alias("rank"))
    earlier = F.sum("n").over(W.partitionBy("name").orderBy("part")) - F.col("n")
    places = parts.join(groups, "name").select("name", "part", "shard", (F.col("rank") + earlier).alias("begin"))
    placed = rows.join(places, ["name", "part"])
    slot = F.col("begin") + F.row_number().over(W.partitionBy("name", "part").orderBy("doc_id")) - 1
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
