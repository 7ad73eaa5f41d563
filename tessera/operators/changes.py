"""What changed between two snapshots of a table: a hash tree over ranges of keys, descended only where digests differ.

A snapshot holds the digests of its rows by key and, for ranges of keys that widen from level to level, their sums. Sums
don't depend on the order of rows, and a level is summed from the one below. To compare two snapshots, a level is read only
below ranges that differed on the level above, and rows only in the narrowest ranges that differ. All tables lie in folders
by slot, the widest ranges; folders without a difference aren't opened, so what is read grows with what changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import cut

#: Bits that a level adds to the width of a range: a node sums up to 16 of those below.
STEP = 4
#: A digest as two whole numbers below 2 ** 60: sums of any number of rows fit into a decimal.
SUMS = ("n", "a", "b")


@dataclass(frozen=True)
class Ranges:
    """Widths in bits: of the narrowest ranges, of the slots, and of a range that holds all keys."""

    leaf: int
    slot: int
    whole: int

    @property
    def levels(self) -> list[int]:
        """Widths of the levels, wide ones first."""
        return list(range(self.leaf, max(self.whole, self.slot) + STEP, STEP))[::-1]


def ranges_of(df: DataFrame, key: str, rows: int = 64, slots: int = 256) -> Ranges:
    """Ranges for about so many rows at the bottom and so many slots at the top. A later snapshot is taken with the ranges of
    the one that it is to be compared with."""
    r = df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("n")).first()
    if r.low is None:
        return Ranges(0, 0, 0)
    span = r.high - r.low + 1
    leaf = max(0, (span * rows // max(r.n, 1)).bit_length() - 1)
    return Ranges(min(leaf, 60), min(max(leaf, (span // slots).bit_length()), 60), min(span.bit_length() + 1, 63))


def word(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")


@dataclass(frozen=True)
class Snapshot:
    folder: str
    ranges: Ranges


def take(df: DataFrame, key: str, folder: str, ranges: Ranges | None = None) -> Snapshot:
    """Writes the digests of a table's rows and the tree over them. Rows that share a key count as one, whatever their order;
    rows without a key are left out. `key` is a column of whole numbers."""
    ranges = ranges or ranges_of(df, key)
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), digest.alias("d")).select("key", F.lit(1).cast("bigint").alias("n"), word(F.col("d"), 1).alias("a"), word(F.col("d"), 16).alias("b"))
    slot = F.shiftright("key", ranges.slot).alias("slot")
    keyed = rows.groupBy("key").agg(*[F.sum(c).cast("bigint" if c == "n" else "decimal(38,0)").alias(c) for c in SUMS])
    keyed.select("*", slot).repartitionByRange("key").sortWithinPartitions("key").write.partitionBy("slot").parquet(f"{folder}/rows")
    spark = df.sparkSession
    below, width = spark.read.parquet(f"{folder}/rows").select("key", *SUMS), 0
    for level in reversed(ranges.levels):
        nodes = below.groupBy(F.shiftright("key", level - width).alias("key")).agg(*[F.sum(c).cast("bigint" if c == "n" else "decimal(38,0)").alias(c) for c in SUMS])
        at = F.shiftright("key", ranges.slot - level) if level <= ranges.slot else F.lit(-1).cast("bigint")
        nodes.select("*", at.alias("slot")).write.partitionBy("slot").parquet(f"{folder}/level={level}")
        below, width = spark.read.parquet(f"{folder}/level={level}").select("key", *SUMS), level
    return Snapshot(folder, ranges)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose sums differ, or that only one side has, with what became of them."""
    renamed = b.select("key", *[F.col(c).alias(f"{c}_") for c in SUMS])
    same = F.lit(True)
    for c in SUMS:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    change = F.when(F.col("n").isNull(), "added").when(F.col("n_").isNull(), "removed").otherwise("changed")
    return a.join(renamed, "key", "full_outer").where(~same).select("key", change.alias("change"))


def compare(spark: SparkSession, before: Snapshot, after: Snapshot) -> DataFrame:
    """(key, change): added, removed and changed keys."""
    if before.ranges != after.ranges:
        raise ValueError("snapshots are compared that were taken with the same ranges")
    ranges, found, slots, above = before.ranges, None, None, 0

    def part(snapshot: Snapshot, name: str, width: int) -> DataFrame:
        """A level, or the rows, below the ranges that differ; only their slots' folders are listed by name."""
        out = spark.read.schema("key bigint, n bigint, a decimal(38,0), b decimal(38,0), slot bigint").parquet(f"{snapshot.folder}/{name}")
        if slots is not None:
            out = out.where(F.col("slot").isin(slots))
        if found is not None:
            out = out.join(found.select(F.col("key").alias("up")), F.shiftright("key", above - width) == F.col("up"), "left_semi")
        return out.drop("slot")

    for level in ranges.levels:
        found = cut(differing(part(before, f"level={level}", level), part(after, f"level={level}", level)))
        above = level
        if level <= ranges.slot:  # as many numbers as there are slots at most
            slots = [r[0] for r in found.select(F.shiftright("key", ranges.slot - level).alias("slot")).distinct().collect()]
    return differing(part(before, "rows", 0), part(after, "rows", 0))
