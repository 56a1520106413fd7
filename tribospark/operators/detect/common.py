"""Scaling, labelling and model application shared by the detectors."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribospark.operators.ordering import CHUNK_ROWS
from tribospark.operators.quantiles import exact_quantiles
from tribospark.session import materialise

MAX_SHARED_JOINTS = 64
MAX_SHARED_BYTES = 8 * 2**20
CHUNKS_PER_COPY = 64
EPSILON = 2.220446049250313e-16


def numeric_or(value, words: dict):
    """A parameter that is a number, text of a number, or one of some words; any other text means the first word."""
    if isinstance(value, (int, float)):
        return value
    text = str(value).strip()
    if re.fullmatch(r"\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"(\d+\.?\d*|\.\d+)(e-?\d+)?", text) else words.get(text, next(iter(words.values())))


def usable(name: str) -> Column:
    """The value, or null where it is missing, NaN or infinite."""
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def column_moments(features: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, i, c, m, s: for each batch of rows and each column its usable values, their mean and sum of squared deviations.

    One row for each batch, group and column is all that gets shuffled, and one with all rows of the batch and group, at i = -1.
    """
    key = by[0] if by else None
    kinds = dict(features.dtypes)

    def partial(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            if key:
                coded = batch.column(key).dictionary_encode(null_encoding="encode")
                codes, names = coded.indices.to_numpy(), coded.dictionary
            else:
                codes, names = np.zeros(len(x), int), [None]
            for code in range(len(names)):
                own = x[codes == code]
                fine = np.isfinite(own)
                count = fine.sum(axis=0)
                filled = np.where(fine, own, 0.0)
                mean = filled.sum(axis=0) / np.maximum(count, 1)
                spread = np.where(fine, (own - mean) ** 2, 0.0).sum(axis=0)
                columns_ = {"i": pa.array(np.arange(-1, len(columns)), pa.int32()), "c": pa.array(np.append(len(own), count), pa.int64()),
                            "m": pa.array(np.append(0.0, mean)), "s": pa.array(np.append(0.0, spread))}
                if key:
                    columns_ = {key: pa.array([names[code].as_py()] * (len(columns) + 1), names.type)} | columns_
                yield pa.record_batch(columns_)

    # one array passes to Python in an eighth of the time of as many columns
    values = F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")
    schema = (f"`{key}` {kinds[key]}, " if key else "") + "i int, c long, m double, s double"
    return features.select(*by, values).mapInArrow(partial, schema).where("c > 0")


def co_moments(rows: DataFrame, columns: list[str], other: str) -> DataFrame:
    """i, c, m, mo, s, so, x: per column, over rows where it and ``other`` are finite, their number, means, sums
    of squared deviations and of the deviations' products.

    Every batch adds up its own rows; one row for each batch and column is shuffled and merged.
    """

    def partial(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            o = batch.column("_o").to_numpy(zero_copy_only=False).astype(float)[:, None]
            fine = np.isfinite(v) & np.isfinite(o)
            c = fine.sum(axis=0)
            v, o = np.where(fine, v, 0.0), np.where(fine, o, 0.0)
            m, mo = v.sum(axis=0) / np.maximum(c, 1), o.sum(axis=0) / np.maximum(c, 1)
            v, o = np.where(fine, v - m, 0.0), np.where(fine, o - mo, 0.0)
            sums = {"m": m, "mo": mo, "s": (v * v).sum(axis=0), "so": (o * o).sum(axis=0), "x": (v * o).sum(axis=0)}
            yield pa.record_batch({"i": pa.array(np.arange(len(c)), pa.int32()), "c": pa.array(c, pa.int64())} | {k: pa.array(a) for k, a in sums.items()})

    values = F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")
    parts = rows.select(values, F.col(other).cast("double").alias("_o")).mapInArrow(partial, "i int, c long, m double, mo double, s double, so double, x double").where("c > 0")
    together, c = Window.partitionBy("i"), F.col("c")
    centre = lambda name: F.sum(c * F.col(name)).over(together) / F.sum("c").over(together)
    parts = parts.withColumns({"_m": centre("m"), "_mo": centre("mo")})
    dm, do = F.col("m") - F.col("_m"), F.col("mo") - F.col("_mo")
    return parts.groupBy("i").agg(
        F.sum("c").alias("c"), F.max("_m").alias("m"), F.max("_mo").alias("mo"), F.sum(F.col("s") + c * dm * dm).alias("s"),
        F.sum(F.col("so") + c * do * do).alias("so"), F.sum(F.col("x") + c * dm * do).alias("x"))


def scaling_stats(features: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Per group (of one key at most): rows, and arrays with the mean and the scaling unit of every column.

    The unit is the population deviation, or 1 for a constant column (a deviation within the rounding
    error of the mean counts as constant). The rows are read once.
    """
    parts = column_moments(features, columns, by)
    together = Window.partitionBy(*by, "i")
    mean = F.sum(F.col("c") * F.col("m")).over(together) / F.sum("c").over(together)
    off = F.col("m") - F.col("mean")
    stats = parts.withColumn("mean", mean).groupBy(*by, "i").agg(
        F.max("mean").alias("m"), F.sqrt(F.sum(F.col("s") + F.col("c") * off * off) / F.sum("c")).alias("s"), F.sum("c").alias("c"))
    constant = F.col("s") <= F.col("c") * F.abs(F.col("m")) * EPSILON
    stats = stats.select(*by, "i", "c", "m", F.when((F.col("s") == 0) | constant, 1.0).otherwise(F.col("s")).alias("u"))
    entries = F.collect_list(F.when(F.col("i") >= 0, F.struct("i", F.struct("m", "u"))))
    maps = stats.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("i") < 0, F.col("c"))), F.lit(0)).alias("n"), F.map_from_entries(entries).alias("_s"))
    # A column without any usable value has no entry: its rows become zero whatever its mean.
    at = F.sequence(F.lit(0), F.lit(len(columns) - 1))
    arrays = [F.transform(at, lambda i: F.col("_s")[i][part]).alias(name) for part, name in (("m", "means"), ("u", "units"))]
    if by:  # a group without any usable value has no arrays
        arrays = [F.when(F.size("_s") > 0, a).alias(name) for a, name in zip(arrays, ("means", "units"))]
    return maps.select(*by, "n", *arrays)


def scaled_array(columns: list[str]) -> Column:
    """Standard scores of all columns as one array; what is missing becomes zero."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    centred = F.zip_with(values, "means", lambda v, m: v - m)
    return F.zip_with(centred, "units", lambda v, u: F.when(F.abs(v) < float("inf"), v / u).otherwise(0.0))


def standardise(
    features: DataFrame, columns: list[str], by: list[str] | None = None, carry: list[str] | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """joint_id, seq, n, the scaled columns as one array ``x``, and the columns in ``carry`` unchanged.

    ``stats`` is what ``scaling_stats`` gave, if the caller has it.
    """
    by = ["joint_id"] if by is None else by
    stats = materialise(scaling_stats(features, columns, by)) if stats is None else stats
    if by:
        rows = features.join(stats, by)
    else:
        rows = features.withColumn("_s", stats.select(F.struct("*")).scalar()).select("*", "_s.*")
    return rows.select("joint_id", "seq", *(carry or []), "n", scaled_array(columns).alias("x"))


def carried(rows: DataFrame) -> list[str]:
    """Columns of a scaled table that only travel along to the result."""
    return [c for c in rows.columns if c not in ("joint_id", "seq", "n", "x")]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Array column of equal lengths as a 2-D array."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def joint_seed(joint: str, *parts: int) -> np.random.Generator:
    return np.random.default_rng([*parts, *joint.encode()])


def by_joint(batch: pa.RecordBatch):
    """Split a batch into (joint, its rows)."""
    coded = batch.column("joint_id").dictionary_encode()
    codes, table = coded.indices.to_numpy(), pa.Table.from_batches([batch])
    for code, joint in enumerate(coded.dictionary.to_pylist()):
        yield joint, table if len(coded.dictionary) == 1 else table.filter(pa.array(codes == code))


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so both sides of a cogroup may share an origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def shareable(models: DataFrame, max_joints: int, max_bytes: int) -> bool:
    """Whether all models together are small enough to be sent to every task."""
    if models.limit(max_joints + 1).count() > max_joints:
        return False
    size = models.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= max_bytes


def shared_models(models: DataFrame, max_shared_joints: int = MAX_SHARED_JOINTS, max_shared_bytes: int = MAX_SHARED_BYTES, chunk_rows: int = 0) -> dict | None:
    """Each joint's model, to travel with the function that uses it, if all of them are within the bounds."""
    if not shareable(models, max_shared_joints, max_shared_bytes):
        return None
    return {r["joint_id"]: r.asDict(recursive=True) for r in models.collect()}


def with_models(
    rows: DataFrame,
    models: DataFrame,
    run: Callable[[dict, pa.Table], pa.Table],
    schema: str,
    max_shared_joints: int = MAX_SHARED_JOINTS,
    max_shared_bytes: int = MAX_SHARED_BYTES,
    chunk_rows: int = CHUNK_ROWS,
    known: dict | None = None,
) -> DataFrame:
    """Run ``run(model, rows of that joint)`` on batches of ``rows``.

    ``models`` has one row per joint. Small models (a few MB as text, checked) are shared with all tasks
    and the rows stay where they are. Beyond that each bounded chunk of a joint is brought together with a
    copy of its model, so no task and no driver holds all models. A joint of very many chunks has its copies
    made by several tasks, CHUNKS_PER_COPY each. ``known`` is what ``shared_models`` gave, if the caller asked.
    """
    columns = rows.columns
    if known is None:
        known = shared_models(models, max_shared_joints, max_shared_bytes)
    if known is not None:

        def batchwise(batches):
            for batch in batches:
                for joint, part in by_joint(batch):
                    yield from run(known[joint], part).combine_chunks().to_batches()

        return rows.mapInArrow(batchwise, schema)

    placed = rows.withColumn("chunk", F.floor(F.col("seq") / chunk_rows))
    copies = renewed(chunk_models(placed, models))
    return placed.groupBy("joint_id", "chunk").cogroup(copies.groupBy("joint_id", "chunk")).applyInArrow(
        lambda left, right: run(right.to_pylist()[0], left.select(columns)), schema)


def chunk_models(placed: DataFrame, models: DataFrame) -> DataFrame:
    """The model of each (joint_id, chunk) of ``placed``."""
    chunks = placed.select("joint_id", "chunk").distinct()
    counts = chunks.groupBy("joint_id").agg(F.ceil(F.count("*") / CHUNKS_PER_COPY).alias("_n"))
    # as many copies of a model as tasks that hand it on
    spread = models.join(counts, "joint_id").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    dealt = chunks.join(counts, "joint_id").withColumn("_part", F.pmod(F.col("chunk"), F.col("_n"))).drop("_n")
    return dealt.join(spread.drop("_n"), ["joint_id", "_part"]).drop("_part")


def apply_models(rows: DataFrame, models: DataFrame, score: Callable[[dict, np.ndarray], np.ndarray], **sharing) -> DataFrame:
    """Score every row with its joint's model: joint_id, seq, the carried columns and ``value``."""
    kept = ["joint_id", "seq", *carried(rows)]
    types = dict(rows.dtypes)

    def run(model: dict, table: pa.Table) -> pa.Table:
        value = pa.array(np.asarray(score(model, matrix(table["x"])), dtype=float))
        return table.select(kept).append_column("value", value)

    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + ["value double"])
    return with_models(rows.select(*kept, "x"), models, run, schema, **sharing)


def scores_and_values(rows: DataFrame, models: DataFrame, score: Callable[[dict, np.ndarray], np.ndarray], wide: bool, **sharing) -> tuple[DataFrame, DataFrame]:
    """The scored rows, and joint_id and ``value`` of them alone as a written table, for quantiles.

    Only with ``wide`` are the columns that travel along written; else the rows are scored once more as the result is read.
    """
    if wide or not carried(rows):
        scores = materialise(apply_models(rows, models, score, **sharing))
        return scores, scores.select("joint_id", "value")
    values = materialise(apply_models(rows.select("joint_id", "seq", "x"), models, score, **sharing).select("joint_id", "value"))
    return apply_models(rows, models, score, **sharing), values


#: States that one task adds up.
FAN = 64


def add_states(parts: DataFrame, widest: int) -> DataFrame:
    """joint_id and the sum of all ``state`` (float64 numbers as bytes) of a joint; parts has (joint_id, part, state).

    ``widest`` is about how many parts a joint has at most. FAN states or so meet in a task, level by
    level, so a joint of any number of batches is summed by many tasks. Sums are taken in the order of ``part``.
    """

    def add(table: pa.Table) -> pa.Table:
        table, total = table.sort_by("part"), 0.0
        for state in table["state"]:
            total = total + np.frombuffer(state.as_py())
        return pa.table({"joint_id": table["joint_id"][:1], "part": table["part"][:1], "state": pa.array([total.tobytes()], pa.binary())})

    schema = "joint_id string, part long, state binary"
    while widest > FAN:
        widest = -(-widest // FAN)
        parts = parts.groupBy("joint_id", F.pmod(F.xxhash64("part"), F.lit(widest)).alias("_group")).applyInArrow(add, schema)
    return parts.groupBy("joint_id").applyInArrow(add, schema)


def parts_of(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, known: dict | None = None, **sharing) -> int:
    """About how many states a joint comes in, at most: one from each task if the models are shared, else one from each chunk."""
    each = rows.select(F.spark_partition_id().alias("task")).groupBy("task").count()
    n, tasks = each.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    return tasks + 1 if known is not None else tasks + n // chunk_rows + 1


def summed(rows: DataFrame, models: DataFrame, partial: Callable[[dict, np.ndarray], np.ndarray], widest: int, known: dict | None = None, **sharing) -> DataFrame:
    """joint_id, state: ``partial(model, x)``, an array of numbers, summed over all rows of each joint.

    With models that are shared (``known``) a task adds up its batches, so that what is shuffled grows with the
    tasks and not with the rows. Else each chunk of a joint gives one state.
    """
    schema = "joint_id string, part long, state binary"

    def one(model: dict, part: int, state: np.ndarray) -> pa.Table:
        return pa.table({"joint_id": pa.array([model["joint_id"]], pa.string()), "part": pa.array([part], pa.int64()), "state": pa.array([state.tobytes()], pa.binary())})

    def run(model: dict, table: pa.Table) -> pa.Table:
        state = np.ascontiguousarray(partial(model, matrix(table["x"])), dtype=float)
        return one(model, table["seq"][0].as_py(), state)  # the first row tells the parts of a joint apart whatever task has them

    def taskwise(batches):
        states: dict = {}
        for batch in batches:
            for joint, table in by_joint(batch):
                state = np.ascontiguousarray(partial(known[joint], matrix(table["x"])), dtype=float)
                first, total = states.get(joint, (table["seq"][0].as_py(), 0.0))
                states[joint] = first, total + state
        for joint, (first, total) in states.items():
            yield from one(known[joint], first, total).to_batches()

    rows = rows.select("joint_id", "seq", "x")
    parts = rows.mapInArrow(taskwise, schema) if known is not None else with_models(rows, models, run, schema, **sharing)
    return add_states(parts, widest).drop("part")


def label_below(scores: DataFrame, contamination: float, shift: bool, values: DataFrame | None = None) -> DataFrame:
    """-1 for a ``value`` below the contamination quantile of its joint, else 1.

    With ``shift`` the quantile is also subtracted, so that a negative score means anomalous. ``values`` has
    joint_id and value of all scores, if they have been written without the columns that travel along.
    """
    cut = materialise(exact_quantiles(scores if values is None else values, ["joint_id"], "value", [contamination], "_cut"))
    rows = scores.join(cut, "joint_id").withColumn("_at", F.col("_cut")[0])
    value = F.col("value") - F.col("_at") if shift else F.col("value")
    return rows.withColumns({"anomaly": F.when(F.col("value") < F.col("_at"), -1).otherwise(1), "anomaly_score": value}).drop("value", "_cut", "_at")


def label_errors(errors: DataFrame, contamination: float, values: DataFrame | None = None) -> DataFrame:
    """-1 for a ``value`` above the (1 - contamination) quantile of its joint; the score is minus the error.

    ``values`` as in ``label_below``.
    """
    cut = materialise(exact_quantiles(errors if values is None else values, ["joint_id"], "value", [1 - contamination], "_cut"))
    rows = errors.join(cut, "joint_id")
    anomaly = F.when(F.col("value") > F.col("_cut")[0], -1).otherwise(1)
    return rows.withColumns({"anomaly": anomaly, "anomaly_score": -F.col("value")}).drop("value", "_cut")
