"""Per-key results where a few keys hold most rows: aggregation in a tree of bounded fan-in.

Rows are taken in chunks of a fixed size as they are scanned; each chunk's rows of a key are combined where
they are read. The states then meet in rounds: a round merges the states of at most ``fan_in`` neighbouring
chunks, so no task of any round receives more than ``fan_in`` states of one key, however many rows it has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.session import scan_splits, split_bytes

#: Rows of a chunk, and chunks whose states one merge takes.
CHUNK, FAN_IN = 65_536, 8


#: A row of a scan has so many bytes in its file at least, by which the rows of a split are bounded.
LEAST_ROW = 4


def rows_of_split(df: DataFrame) -> int:
    """More rows than a split of the scan can hold, from the size of splits alone."""
    return split_bytes(df.sparkSession) // LEAST_ROW


class State:
    """A result that can be built of parts: how a row enters a state, how states merge, what the result is."""

    def __init__(self, name: str, first: Column, merge: str, done: Column | None = None) -> None:
        self.name, self.first, self.merge, self.done = name, first, merge, done


def count_of(name: str, when: Column | None = None) -> State:
    return State(name, (F.lit(1) if when is None else when.cast("int")).cast("bigint"), "sum")


def sum_of(name: str, value: Column) -> State:
    return State(name, value, "sum")


def max_of(name: str, value: Column) -> State:
    return State(name, value, "max")


def min_of(name: str, value: Column) -> State:
    return State(name, value, "min")


def tree_aggregate(df: DataFrame, key: str, states: list[State], chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each key (null is a key) with the merged value of each state.

    Nulls enter a state as SQL's sum, min and max take them. Columns of ``df`` that no state names play no
    part, even if they have a state's name. An empty table gives no rows. Needs two or more as fan-in.
    """
    if fan_in < 2 or chunk < 1 or chunk & (chunk - 1):
        raise ValueError("fan_in must be 2 or more, chunk a power of two")
    k = "_key"
    # the upper bits of the id are the partition, the lower 33 the row's place in it
    row = F.monotonically_increasing_id()
    src = df.select(F.col(key).alias(k), *(s.first.alias(f"_s{i}") for i, s in enumerate(states)), F.shiftright(row, 33).alias("_p"), (F.shiftright(row.bitwiseAND((1 << 33) - 1), chunk.bit_length() - 1)).alias("_c"))
    merged = lambda d, *by: d.groupBy(k, *by).agg(*(getattr(F, s.merge)(f"_s{i}").alias(f"_s{i}") for i, s in enumerate(states)))
    level = merged(src, "_p", "_c")
    # chunks of one partition meet first, then partitions; the rounds are logarithmic in both
    for _ in range(max(1, math.ceil(math.log(max(1, rows_of_split(df) / chunk), fan_in)) - 1)):
        level = merged(level.withColumn("_c", F.floor(F.col("_c") / fan_in)), "_p", "_c")
    parts = max(scan_splits(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    level = merged(level, "_p")
    for _ in range(max(0, math.ceil(math.log(parts, fan_in)) - 1)):
        level = merged(level.withColumn("_p", F.floor(F.col("_p") / fan_in)), "_p")
    out = merged(level)
    return out.select(F.col(k).alias(key), *((s.done if s.done is not None else F.col(f"_s{i}")).alias(s.name) for i, s in enumerate(states)))


def heavy_keys(counted: DataFrame, key: str, count: str, share: float) -> DataFrame:
    """The keys that hold more than ``share`` of all rows, with their counts, from a table of one row per key.

    At most 1 / share keys can be returned. A null key counts among the rows but is no result.
    """
    total = counted.agg(F.sum(count)).scalar()
    return counted.where((F.col(count) > F.lit(float(share)) * total) & F.col(key).isNotNull()).select(key, count)
