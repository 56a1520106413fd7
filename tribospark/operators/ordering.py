"""Row numbers and bounded chunks for long ordered series.

The sensor operators are positional: they look at the previous row or the last W rows of a joint.
A plain window over a joint puts the whole joint in one task. Here a joint is numbered first and
then cut into chunks of fixed length that carry a short halo of preceding rows, so that a window
partition never holds more than ``chunk_rows + halo`` rows whatever the joint's share of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribospark.session import materialise

MAX_WINDOW_ROWS = 2_000_000
CHUNK_ROWS = 16_384
RANGE_ROWS = 1_000_000


def _sort_keys(order_cols: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order_cols]


def group_rows(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups, from one partially aggregated count."""
    largest, total = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return int(largest or 0), int(total or 0)


def number_rows(
    df: DataFrame,
    keys: list[str],
    order_cols: list[str],
    name: str = "seq",
    max_window_rows: int = MAX_WINDOW_ROWS,
    range_rows: int = RANGE_ROWS,
    without: tuple[str, ...] = (),
) -> DataFrame:
    """Add the 0-based position of each row in its group under ``order_cols``.

    While every group fits in one window partition this is ``row_number``. Beyond that the table is
    range-partitioned on (keys, order), written once, and numbered by per-partition offsets: only
    one small record per (partition, group) takes part in the prefix sum. Columns in ``without`` serve
    the order only: they are neither written nor returned.
    """
    largest, total = group_rows(df, keys)
    if largest <= max_window_rows:
        window = Window.partitionBy(*keys).orderBy(*_sort_keys(order_cols))
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("long")).drop(*without)
    return _number_by_range(df, keys, order_cols, name, range_rows, total, without)


def _number_by_range(
    df: DataFrame, keys: list[str], order_cols: list[str], name: str, range_rows: int, total: int, without: tuple[str, ...] = ()
) -> DataFrame:
    parts = max(1, -(-total // range_rows))
    sort = [F.col(k) for k in keys] + _sort_keys(order_cols)
    ranged = df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    # monotonically_increasing_id packs (partition, row in partition) as partition * 2^33 + row; two
    # narrow numbers, of which one repeats, take half the room of the packed one
    place = F.monotonically_increasing_id()
    ranged = ranged.withColumn("_place", place).drop(*without)
    placed = materialise(ranged.withColumns({
        "_part": F.shiftright("_place", 33).cast("int"), "_place": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).cast("int")}))
    runs = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = materialise(runs.drop("_n"))
    same = placed["_part"] == runs["_part"]
    for k in keys:  # a null key is a group like any other, as it is for a window
        same = same & placed[k].eqNullSafe(runs[k])
    return (
        placed.join(runs.select("_part", *keys, "_first", "_before"), same)
        .select(*[placed[c] for c in df.columns if c not in without], (F.col("_place") - F.col("_first") + F.col("_before")).alias(name))
    )


def chunked(
    df: DataFrame, keys: list[str], halo: int, seq: str = "seq", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Copy each row into its chunk, and the last ``halo`` rows of a chunk also into the next one."""
    if halo > chunk_rows:
        raise ValueError(f"halo {halo} exceeds chunk_rows {chunk_rows}")
    own = F.floor(F.col(seq) / chunk_rows)
    tail = F.col(seq) % chunk_rows >= chunk_rows - halo
    homes = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)) if halo else F.array(own)
    return df.withColumn("chunk", F.explode(homes)).repartition(*keys, "chunk")


def own_rows(seq: str = "seq", chunk_rows: int = CHUNK_ROWS) -> Column:
    """True for rows that belong to the chunk, false for its halo copies."""
    return F.floor(F.col(seq) / chunk_rows) == F.col("chunk")


def with_previous(
    df: DataFrame,
    keys: list[str],
    columns: dict[str, str],
    seq: str = "seq",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add, for each (new name -> source) pair, the value one row earlier in the group."""
    window = Window.partitionBy(*keys, "chunk").orderBy(seq)
    pieces = chunked(df, keys, 1, seq, chunk_rows)
    pieces = pieces.withColumns({new: F.lag(src).over(window) for new, src in columns.items()})
    return pieces.filter(own_rows(seq, chunk_rows)).drop("chunk")


def running_totals(
    df: DataFrame,
    order_col: str,
    totals: dict[str, str],
    max_window_rows: int = MAX_WINDOW_ROWS,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Cumulative sums over the whole table by ascending ``order_col`` (unique per row)."""
    df = materialise(df)
    count = df.count()
    if count <= max_window_rows:
        window = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({new: F.sum(src).over(window) for new, src in totals.items()})
    ranged = df.repartitionByRange(-(-count // range_rows), order_col).sortWithinPartitions(order_col)
    placed = materialise(ranged.withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(*[F.sum(src).alias(new) for new, src in totals.items()])
    sums = sums.select("_part", *[F.coalesce(F.sum(new).over(before), F.lit(0)).alias(f"_b_{new}") for new in totals])
    within = Window.partitionBy("_part").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(materialise(sums), "_part")
    out = out.withColumns({new: F.sum(src).over(within) + F.col(f"_b_{new}") for new, src in totals.items()})
    return out.drop("_part", *[f"_b_{new}" for new in totals])
