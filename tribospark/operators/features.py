"""Sliding-window features of every signal of a canonical table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribospark.functions.batch import feature_batch
from tribospark.functions.spectral import SPECTRAL, power_spectrum
from tribospark.functions.trailing import STATISTICAL, THERMAL, VIBRATION, Trailing
from tribospark.operators.mapping import SignalTable
from tribospark.operators.ordering import CHUNK_ROWS, chunked, own_rows
from tribospark.session import SPARE_NUMBERS, materialise

WINDOW = 50
# Modalities that get each set of features.
SPECTRAL_MODALITIES = {"accelerometer", "gyroscope", "magnetometer", "vibration", "force", "velocity", "motor_current"}
VIBRATION_MODALITIES = {"accelerometer", "vibration"}
THERMAL_MODALITIES = {"temperature"}
TRIAXIAL_MODALITIES = {"accelerometer", "gyroscope", "magnetometer", "force"}
META = ("joint_id", "seq", "timestamp")


def modality_by_name(key: str) -> str:
    """Modality as read from a key alone: everything before its last underscore."""
    return key.rsplit("_", 1)[0]


def finite(c: Column) -> Column:
    """Null, NaN and infinities become zero."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, 0.0).otherwise(c)


def magnitudes(signals: dict[str, str]) -> dict[str, list[str]]:
    """Axis columns behind each magnitude: tri-axial modalities with at least two of x, y, z."""
    axes: dict[str, list[str]] = {}
    for key in signals:
        stem, _, axis = key.rpartition("_")
        if axis in ("x", "y", "z") and stem.split("_")[0] in TRIAXIAL_MODALITIES:
            axes.setdefault(stem, []).append(key)
    return {f"{stem}_magnitude": keys for stem, keys in axes.items() if len(keys) >= 2}


def add_magnitudes(table: SignalTable) -> SignalTable:
    """Euclidean norm per tri-axial group, computed before missing values are filled."""
    extra, signals = {}, dict(table.signals)
    for name, keys in magnitudes(table.signals).items():
        total = sum((F.col(k) * F.col(k) for k in keys[1:]), F.col(keys[0]) * F.col(keys[0]))
        extra[name] = F.sqrt(total)
        signals[name] = name.removesuffix("_magnitude")
    return SignalTable(table.rows.withColumns(extra) if extra else table.rows, signals,
                       table.sampling_rate_hz, table.optional)


def stats_of(modality: str) -> tuple[str, ...]:
    """Feature names computed for a signal of this modality."""
    names = STATISTICAL
    if modality in SPECTRAL_MODALITIES:
        names += SPECTRAL
    if modality in VIBRATION_MODALITIES:
        names += VIBRATION
    if modality in THERMAL_MODALITIES:
        names += THERMAL
    return names


def feature_names(table: SignalTable, strict_names: bool = False) -> list[str]:
    """Names the table's features would have, without computing any."""
    signals = {**table.signals, **{m: m.removesuffix("_magnitude") for m in magnitudes(table.signals)}}
    out = []
    for key, modality in signals.items():
        known = modality_by_name(key) if strict_names else modality
        out += [f"{key}_{stat}" for stat in stats_of(known)]
    return sorted(out)


def sliding_windows(table: SignalTable, signal: str, size: int = WINDOW, step: int = 1,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every ``step``-th full window of a signal as an array, at the window's last row."""
    if step < 1 or size < 1:
        raise ValueError("window size and step must be at least 1")
    pieces = chunked(table.rows.select("joint_id", "seq", signal), ["joint_id"], size - 1, chunk_rows=chunk_rows)
    window = Window.partitionBy("joint_id", "chunk").orderBy("seq").rowsBetween(-(size - 1), 0)
    full = (F.col("seq") >= size - 1) & ((F.col("seq") - (size - 1)) % step == 0)
    # collect_list would drop nulls and shift the window
    lists = pieces.withColumn("window", F.collect_list(F.struct(signal)).over(window))
    return lists.filter(own_rows(chunk_rows=chunk_rows) & full).select(
        "joint_id", "seq", F.transform("window", lambda s: s[signal]).alias("window"))


def power_spectra(table: SignalTable, signal: str, size: int = WINDOW, step: int = 1, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The power of each frequency bin, from zero to size / 2, of every ``step``-th full window, as an array."""

    def transform(batches):
        for batch in batches:
            powers = power_spectrum(np.array([w.as_py() for w in batch.column("window")], float)) if batch.num_rows else []
            columns = [batch.column("joint_id"), batch.column("seq"), pa.array(list(powers), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["joint_id", "seq", "power"])

    windows = sliding_windows(table, signal, size, step, chunk_rows)
    return windows.mapInArrow(transform, "joint_id string, seq long, power array<double>")


def extract_features(
    table: SignalTable,
    size: int = WINDOW,
    selected: list[str] | None = None,
    strict_names: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    engine: str = "arrow",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Wide feature matrix: joint_id, seq, timestamp, the columns of the rows in ``carry`` and ``<signal>_<stat>`` columns.

    One shuffle on (joint, chunk) serves all signals and all features; only features in ``selected``
    are computed. ``engine="builtin"`` evaluates everything but spectra with Spark's own window
    frames, which is slower for many features but stays in the JVM.
    """
    full = add_magnitudes(table)
    rows, absent = full.rows, {}
    if table.optional:
        rows, absent = _absent_flags(rows, table.optional, full.signals)
    rows = rows.withColumns({s: finite(F.col(s)) for s in full.signals})
    wanted = {}
    for key, modality in full.signals.items():
        names = stats_of(modality_by_name(key) if strict_names else modality)
        wanted[key] = [s for s in names if selected is None or f"{key}_{s}" in selected]
    wanted = {key: names for key, names in wanted.items() if names}
    flags = [f"{s}__absent" for s in table.optional]
    pieces = chunked(
        rows.select("joint_id", "seq", F.col("t").alias("timestamp"), *carry, *wanted, *flags),
        ["joint_id"], 2 * (size - 1), chunk_rows=chunk_rows)
    kept = ["joint_id", "seq", "timestamp", *carry, *flags]
    if engine == "builtin":
        pieces, wanted_here, kept = _framed(pieces, wanted, size, kept)
    else:
        wanted_here = wanted
    if wanted_here:
        types = dict(pieces.dtypes)
        schema = ", ".join([f"`{c}` {types[c]}" for c in kept]
                           + [f"`{key}_{s}` double" for key, names in wanted_here.items() for s in names])
        pieces = pieces.groupBy("joint_id", "chunk").applyInArrow(
            feature_batch(wanted_here, size, chunk_rows, kept), schema)
    else:
        pieces = pieces.filter(own_rows(chunk_rows=chunk_rows))
    values = []
    for key, names in wanted.items():
        for s in names:
            column = F.col(f"{key}_{s}")
            values.append((F.when(~absent[key], column) if key in absent else column).alias(f"{key}_{s}"))
    return pieces.select("joint_id", "seq", "timestamp", *carry, *values)


def spared(features: DataFrame, series: DataFrame) -> DataFrame:
    """The features of ``series``, written if they are SPARE_NUMBERS numbers at most, because later stages read them several times.

    A larger matrix is made again by each reader: the series it comes from takes a small part of its room.
    """
    return materialise(features) if series.count() * len(features.columns) <= SPARE_NUMBERS else features


def _framed(pieces: DataFrame, wanted: dict[str, list[str]], size: int, kept: list[str]):
    """Everything but spectra by built-in window frames; returns what is left for the Arrow pass."""
    trailing = Trailing(Window.partitionBy("joint_id", "chunk").orderBy("seq"), size)
    level1, level2, level3, final = {}, {}, {}, {}
    for key, names in wanted.items():
        level1.update(trailing.sums(F.col(key), key))
        level2.update(trailing.deviations(F.col(key), key))
        level3.update(trailing.moments(key))
        found = trailing.features(F.col(key), key)
        final.update({f"{key}_{s}": found[f"{key}_{s}"] for s in names if s not in SPECTRAL})
    spectral = {key: [s for s in names if s in SPECTRAL] for key, names in wanted.items()}
    spectral = {key: names for key, names in spectral.items() if names}
    out = pieces.withColumns(level1).withColumns(level2).withColumns(level3)
    out = out.select("chunk", *kept, *spectral, *[c.alias(k) for k, c in final.items()])
    return out, spectral, [*kept, *final]


def _absent_flags(rows: DataFrame, optional: tuple[str, ...], signals: dict[str, str]):
    """A text channel without a single number in a joint is no signal of that joint."""
    seen = materialise(rows.groupBy("joint_id").agg(*[(F.count(s) == 0).alias(f"{s}__absent") for s in optional]))
    absent = {}
    for s in signals:
        parts = [o for o in optional if o == s or (s.endswith("_magnitude") and o.startswith(s.removesuffix("magnitude")))]
        test = F.lit(False)
        for o in parts:
            test = test | F.col(f"{o}__absent")
        absent[s] = test
    return rows.join(seen, "joint_id"), absent


def magnetometer_features(series: DataFrame, size: int = WINDOW, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The fixed feature set of a magnetometer-only log."""
    norm = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    rows = series.select("joint_id", "seq", F.col("timestamp").cast("double").alias("t"), norm.alias("mag"))
    table = SignalTable(rows.withColumn("own", finite(F.col("mag"))), {"mag": "magnetometer"})
    names = {
        "mag_mean": "mag_mean", "mag_std": "mag_std", "jerk": "mag_jerk", "energy": "mag_energy",
        "spectral_energy": "mag_spectral_energy", "dominant_frequency": "mag_dominant_frequency",
        "entropy": "mag_spectral_entropy",
    }
    features = extract_features(table, size, list(names.values()), chunk_rows=chunk_rows, carry=("own",))
    return features.select(
        "joint_id", "seq", "timestamp", F.col("own").alias("mag"), F.col("mag_mean"), F.col("mag_std"), F.col("mag_std").alias("rolling_std"),
        *[F.col(src).alias(new) for new, src in names.items() if new not in ("mag_mean", "mag_std")])
