"""Data-quality checks of a raw sensor table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, TimestampNTZType, TimestampType

from tribospark.operators.fileorder import steps_by_runs
from tribospark.operators.ordering import MAX_WINDOW_ROWS, number_rows, with_previous
from tribospark.operators.quantiles import exact_quantiles
from tribospark.operators.roles import DatasetSchema
from tribospark.session import materialise

IQR_FACTOR = 3.0
MIN_OUTLIER_ROWS = 20
GAP_FACTOR = 3.0


@dataclass(frozen=True)
class QualityReport:
    """``summary`` has one row, ``columns`` one row per column and ``joints`` one row per joint."""

    summary: DataFrame
    columns: DataFrame
    joints: DataFrame


def epoch_divisor(reference: Column) -> Column:
    """Units per second, guessed from the size of an epoch value."""
    size = F.abs(reference)
    return F.when(size > 1e17, 1e9).when(size > 1e14, 1e6).when(size > 1e11, 1e3).otherwise(1.0)


#: Of the sketches: log2 of the registers of distinct counts (error 0.8 %), and the size that bounds the error of a
#: quartile's rank (below 0.1 %).
DISTINCT_BITS, QUANTILE_SIZE = 14, 8_192


def _numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _value(name: str) -> Column:
    return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, and rows beyond the first of each set of equal rows."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def _counted(df: DataFrame, name: str, numeric: bool) -> DataFrame:
    """Each value of a column that is not missing, with its number of copies; numbers also as ``value``."""
    fractional = isinstance(df.schema[name].dataType, (FloatType, DoubleType))
    raw = (_value(name) if fractional else F.col(f"`{name}`")).alias("raw")
    counts = df.select(raw).where(F.col("raw").isNotNull()).groupBy("raw").agg(F.count("*").alias("copies"))
    value = F.col("raw").cast("double") if numeric else F.lit(None).cast("double")
    return counts.select(F.lit(name).alias("column"), value.alias("value"), "copies")


def _exact_facts(df: DataFrame, columns: list[str], numeric: set[str]) -> tuple[DataFrame, DataFrame | None]:
    """Per column its facts but the outliers, and the counted values of numeric columns.

    Every column is grouped by itself, in its own type, so the table is read column by column and equal
    values meet before they are shuffled.
    """
    facts = [
        _counted(df, c, False).agg(F.sum("copies").alias("_present"), F.count("*").alias("unique_count")).select(
            F.lit(c).alias("column"), "_present", "unique_count", *[F.lit(None).cast("double").alias(n) for n in ("min_val", "max_val", "mean_val", "q1", "q3")])
        for c in columns if c not in numeric]
    counted = None
    if numeric & set(columns):
        value, copies = F.col("value"), F.col("copies")
        counted = materialise(reduce(DataFrame.unionByName, [_counted(df, c, True) for c in columns if c in numeric]))
        present = counted.groupBy("column").agg(
            F.sum(copies).alias("_present"), F.count("*").alias("unique_count"), F.min(value).alias("min_val"), F.max(value).alias("max_val"),
            (F.sum(value * copies) / F.sum(copies)).alias("mean_val"))
        quartiles = exact_quantiles(counted, ["column"], "value", [0.25, 0.75], "_q", weight="copies")
        facts.append(present.join(quartiles, "column", "left").withColumns({"q1": F.col("_q")[0], "q3": F.col("_q")[1]}).drop("_q"))
    return reduce(DataFrame.unionByName, facts), counted


def column_sketches(df: DataFrame, columns: list[str] | None = None, part: Column | None = None) -> DataFrame:
    """One row per part and column, from one scan: part, column, n, present, lo, hi, mean, m2 and the sketches.

    ``part`` may name the input file or its date: rows of new files are then added to those kept,
    ``merged_sketches`` joins them, and no old file is read again. Distinct counts are kept as HyperLogLog, values as KLL sketches.
    """
    columns = columns or df.columns
    numeric = set(_numeric_columns(df))
    none = F.lit(None)
    facts = []
    for name in columns:
        v = _value(name) if name in numeric else none.cast("double")
        cell = v if name in numeric and isinstance(df.schema[name].dataType, (FloatType, DoubleType)) else F.col(f"`{name}`")
        present = F.when(cell.isNotNull(), F.xxhash64(cell))
        facts.append(F.struct(
            F.lit(name).alias("column"), F.count("*").alias("n"), F.count(cell).alias("present"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"),
            (F.var_pop(v) * F.count(v)).alias("m2"), F.hll_sketch_agg(present, DISTINCT_BITS).alias("distinct"),
            (F.kll_sketch_agg_double(v, QUANTILE_SIZE) if name in numeric else none.cast("binary")).alias("values")))
    wide = df.groupBy((part if part is not None else none.cast("string")).alias("part")).agg(F.array(*facts).alias("_c"))
    return wide.select("part", F.explode("_c").alias("_c")).select("part", "_c.*")


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """The parts of ``column_sketches`` put together: one row per column, part null."""
    known = F.when(F.col("mean").isNotNull(), F.col("present"))
    whole = Window.partitionBy("column")
    centre = F.try_divide(F.sum(F.col("mean") * known).over(whole), F.sum(known).over(whole))
    off = F.col("mean") - F.col("_centre")
    return sketches.withColumn("_centre", centre).groupBy("column").agg(
        F.lit(None).cast("string").alias("part"), F.sum("n").alias("n"), F.sum("present").alias("present"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max("_centre").alias("mean"), F.sum(F.col("m2") + known * off * off).alias("m2"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("values", QUANTILE_SIZE).alias("values")).select(*sketches.columns)


def _sketched_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    sketches = column_sketches(df, columns)
    marks = F.when(F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double("values", F.array(F.lit(0.25), F.lit(0.75))))
    facts = sketches.withColumn("_q", marks)
    return facts.select(
        "column", F.col("present").alias("_present"), F.hll_sketch_estimate("distinct").alias("unique_count"), F.col("lo").alias("min_val"), F.col("hi").alias("max_val"),
        F.col("mean").alias("mean_val"), F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"),
        F.sqrt(F.try_divide("m2", F.when(F.col("mean").isNotNull(), F.col("present")) - 1)).alias("std_val"))


def _fences(stats: DataFrame) -> DataFrame:
    """The stats with the bounds beyond which a value is an outlier; null where none is."""
    spread = F.col("q3") - F.col("q1")
    fenced = (F.col("_present") >= MIN_OUTLIER_ROWS) & (spread >= 1e-12)
    return stats.withColumns({"_low": F.when(fenced, F.col("q1") - IQR_FACTOR * spread), "_high": F.when(fenced, F.col("q3") + IQR_FACTOR * spread)})


def profile_columns(df: DataFrame, exact: bool | list[str] = True) -> DataFrame:
    """One row per column: type, missing and distinct counts; for numeric columns also the moments,
    quartiles and outliers outside the 3-IQR fences.

    ``exact`` names the columns (True: all, False: none) whose distinct counts and quartiles are exact. That
    costs a shuffle of their distinct values. Those of the others come from mergeable sketches, in one scan that
    shuffles a row for each task; columns with values beyond the fences are read once more to count them.
    """
    numeric, columns, types = _numeric_columns(df), df.columns, dict(df.dtypes)
    sure = columns if exact is True else [c for c in columns if exact and c in exact]
    rough = [c for c in columns if c not in sure]
    frame = df.sparkSession.createDataFrame(
        [(i, c, types[c]) for i, c in enumerate(columns)], "position int, column string, dtype string")
    totals = materialise(df.agg(F.count("*").alias("total_rows")))
    frame = frame.withColumn("total_rows", totals.select("total_rows").scalar())
    parts, counted = [], None
    if sure:
        facts, counted = _exact_facts(df, sure, set(numeric))
        parts.append(facts.withColumn("std_val", F.lit(None).cast("double")))
    if rough:
        parts.append(_sketched_facts(df, rough))
    facts = reduce(DataFrame.unionByName, parts)
    stats = frame.join(facts, "column", "left").fillna(0, ["unique_count", "_present"])
    stats = materialise(_fences(stats.withColumn("missing_count", F.col("total_rows") - F.col("_present"))))  # one row for each column
    around = []
    if counted is not None:
        value, copies = F.col("value"), F.col("copies")
        off = value - F.col("mean_val")
        around.append(counted.join(stats.select("column", "mean_val", "_low", "_high"), "column").groupBy("column").agg(
            F.sqrt(F.try_divide(F.sum(copies * off * off), F.sum(copies) - 1)).alias("_std"),
            F.sum(F.when((value < F.col("_low")) | (value > F.col("_high")), copies).otherwise(0)).alias("outlier_count")))
    beyond = stats.where((F.col("min_val") < F.col("_low")) | (F.col("max_val") > F.col("_high"))).select("column", "_low", "_high").collect() if rough else []
    beyond = [row for row in beyond if row["column"] in rough]
    if beyond:
        counts = [F.struct(F.lit(row["column"]).alias("column"), F.lit(None).cast("double").alias("_std"),
                           F.count_if((_value(row["column"]) < row["_low"]) | (_value(row["column"]) > row["_high"])).alias("outlier_count")) for row in beyond]
        around.append(df.agg(F.array(*counts).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*"))
    if around:
        stats = stats.join(reduce(DataFrame.unionByName, around), "column", "left")
    else:
        stats = stats.withColumns({"_std": F.lit(None).cast("double"), "outlier_count": F.lit(0)})
    missing_pct = F.round(F.try_divide(F.col("missing_count"), F.col("total_rows")) * 100, 2)
    return stats.select(
        "position", "column", "dtype", "missing_count", F.coalesce(missing_pct, F.lit(0.0)).alias("missing_pct"), "unique_count", "min_val", "max_val", "mean_val",
        F.coalesce("_std", "std_val").alias("std_val"), "q1", "q3", F.coalesce("outlier_count", F.lit(0)).cast("long").alias("outlier_count"), "total_rows",
    )


def column_warnings(profile: DataFrame, max_missing_pct: float = 50.0) -> DataFrame:
    """Columns that are entirely null, and columns with too many missing cells."""
    share = F.try_divide(F.col("missing_count"), F.col("total_rows")) * 100
    return profile.filter((F.col("missing_count") == F.col("total_rows")) | (share > max_missing_pct)).select(
        "position", "column", (F.col("missing_count") == F.col("total_rows")).alias("fully_null"), "missing_pct")


def time_value(df: DataFrame, column: str) -> Column:
    """Time as a double: epoch seconds of a timestamp, or the number itself; null if unreadable."""
    kind = df.schema[column].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp")) / 1e6
    if isinstance(kind, NumericType):
        return _value(column)
    return F.unix_micros(F.try_to_timestamp(F.col(column).cast("string"))) / 1e6


def time_steps(
    df: DataFrame,
    timestamp: str,
    order_cols: list[str],
    by: list[str] | None = None,
    max_window_rows: int = MAX_WINDOW_ROWS,
    by_runs: bool = True,
    **chunking,
) -> DataFrame:
    """Difference between each time value and the one before it in file order (per ``by`` group).

    Rows that lie in order (``fileorder``) are not sorted, and only those of the runs' edges are
    shuffled. Other tables are numbered by a sort, as all are with ``by_runs=False``.
    """
    by = by or []
    times = df.select(*by, *[c for c in order_cols if c not in by and c != timestamp], timestamp)
    times = times.withColumn("_time", time_value(df, timestamp)).filter(F.col("_time").isNotNull())
    found = steps_by_runs(times, by, order_cols) if by_runs else None
    if found is not None:
        return found
    # The file order may contain the time column itself, so keep every order column until numbered.
    keep = [*by, "_seq", "_time"]
    numbered = number_rows(times, by, order_cols, "_seq", max_window_rows).select(*keep)
    return with_previous(numbered, by, {"_before": "_time"}, "_seq", **chunking).select(
        *by, F.col("_seq").alias("seq"), F.col("_time").alias("time"), (F.col("_time") - F.col("_before")).alias("step"))


def sampling_summary(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Reversals, sampling rate, step deviation and gaps, for the table or for each group.

    The deviation stays in the raw time unit while the rate is per second.
    """
    by = by or []
    steps = materialise(steps)
    medians = exact_quantiles(steps.filter("step is not null"), by, "step", [0.5], "_median")
    firsts = steps.groupBy(*by).agg(
        F.min_by("time", "seq").alias("_first"), F.stddev_samp("step").alias("_std"),
        F.count_if(F.col("step") < 0).alias("reversals"))
    if by:
        stats = _left_join(firsts, medians, by)
        joined = _left_join(steps, medians, by)
    else:
        stats = firsts.withColumn("_median", medians.select("_median").scalar())
        joined = steps.withColumn("_median", medians.select("_median").scalar())
    median = F.col("_median")[0]
    gaps = joined.groupBy(*by).agg(
        F.count_if((median > 0) & (F.col("step") > GAP_FACTOR * median)).alias("timestamp_gaps"))
    stats = _left_join(stats, gaps, by) if by else stats.withColumn("timestamp_gaps", gaps.select("timestamp_gaps").scalar())
    rate = F.when(median > 0, F.round(1.0 / (median / epoch_divisor(F.col("_first"))), 2))
    return stats.select(
        *by, "reversals", (F.col("reversals") > 0).alias("non_monotonic"), rate.alias("sampling_rate_hz"),
        F.when(median > 0, F.round("_std", 6)).alias("sampling_rate_std"), "timestamp_gaps")


def _left_join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join in which a null group finds itself."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    same = reduce(lambda x, y: x & y, [left[c].eqNullSafe(other[f"_r_{c}"]) for c in by])
    return left.join(other, same, "left").drop(*[f"_r_{c}" for c in by])


def sampling_rate(df: DataFrame, timestamp: str, order_cols: list[str], **numbering) -> DataFrame:
    """One row: samples per second over the whole table in file order."""
    return sampling_summary(time_steps(df, timestamp, order_cols, **numbering)).select("sampling_rate_hz")


def joint_names(df: DataFrame, joint: str | None) -> DataFrame:
    """Distinct joints as text, or the single joint ``default``."""
    if joint is None or joint not in df.columns:
        return df.sparkSession.createDataFrame([("default",)], "joint_id string")
    return df.filter(F.col(joint).isNotNull()).select(F.col(joint).cast("string").alias("joint_id")).distinct()


def validate_dataset(
    df: DataFrame,
    schema: DatasetSchema,
    order_cols: list[str],
    max_missing_pct: float = 50.0,
    max_duplicate_pct: float = 30.0,
    by_joint: bool = False,
    exact: bool | list[str] = True,
    facts: DataFrame | None = None,
) -> QualityReport:
    """All checks. ``order_cols`` give the file order; ``by_joint`` measures time steps inside joints.

    ``facts`` is the ``sampling_summary`` of the whole table, if the caller has it already.
    """
    spark = df.sparkSession
    extra = [c for c in order_cols if c.startswith("_file_")]
    data = df.drop(*extra)
    columns = profile_columns(data, exact)
    flagged = column_warnings(columns, max_missing_pct)
    summary = duplicate_rows(data).withColumn("total_columns", F.lit(len(data.columns)))
    duplicate_pct = F.try_divide(F.col("duplicate_rows"), F.col("total_rows")) * 100
    nulls = flagged.filter("fully_null").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "column"))), lambda s: s["column"]))
    sparse = flagged.filter("not fully_null").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("position", "column", "missing_pct"))),
        lambda s: F.concat(s["column"], F.lit(" has "), s["missing_pct"].cast("string"), F.lit("% missing cells"))))
    joints = joint_names(data, schema.joint)
    summary = summary.withColumns({
        "fully_null_columns": nulls.scalar(),
        "_sparse": sparse.scalar(),
        "joint_count": joints.agg(F.count("*")).scalar(),
    })
    timing = [f.name for f in data.schema.fields if f.name == schema.timestamp
              and isinstance(f.dataType, (NumericType, TimestampType, TimestampNTZType))]
    if timing:
        by = [schema.joint] if by_joint and schema.joint else []
        if facts is None or by:
            facts = sampling_summary(time_steps(df, schema.timestamp, order_cols, by), by)
        if by:
            facts = facts.agg(
                F.sum("reversals").alias("reversals"), F.max("non_monotonic").alias("non_monotonic"),
                F.median("sampling_rate_hz").alias("sampling_rate_hz"),
                F.median("sampling_rate_std").alias("sampling_rate_std"), F.sum("timestamp_gaps").alias("timestamp_gaps"))
        summary = summary.withColumn("_time", facts.select(F.struct("*")).scalar())
        for name in ("reversals", "non_monotonic", "sampling_rate_hz", "sampling_rate_std", "timestamp_gaps"):
            summary = summary.withColumn(name, F.col(f"_time.{name}"))
        summary = summary.drop("_time")
    else:
        empty = {"reversals": "long", "non_monotonic": "boolean", "sampling_rate_hz": "double",
                 "sampling_rate_std": "double", "timestamp_gaps": "long"}
        summary = summary.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()})
        summary = summary.withColumns({"reversals": F.lit(0).cast("long"), "timestamp_gaps": F.lit(0).cast("long"),
                                       "non_monotonic": F.lit(False)})

    def text(condition: Column, *parts) -> Column:
        return F.array_compact(F.array(F.when(condition, F.concat(*parts))))

    summary = summary.withColumn("warnings", F.when(F.col("total_rows") == 0, F.array(F.lit("table has no rows"))).otherwise(
        F.concat(
            text(duplicate_pct > max_duplicate_pct, F.format_number(duplicate_pct, 1), F.lit("% of rows are copies of another row")),
            F.col("_sparse"),
            text(F.col("non_monotonic"), F.lit("time runs backwards "), F.col("reversals").cast("string"), F.lit(" times")),
            text(F.col("timestamp_gaps") > 0, F.col("timestamp_gaps").cast("string"), F.lit(" gaps of more than three median steps")),
            text(F.size("fully_null_columns") > 0, F.lit("columns without any value: "), F.array_join("fully_null_columns", ", ")),
        )))
    summary = verdict(summary).drop("_sparse")
    return QualityReport(summary, columns.drop("total_rows"), joints)


def verdict(summary: DataFrame) -> DataFrame:
    """Invalid with no rows, more than five warnings, or fewer than ten rows.

    The warning about short data is added after the count, so it never tips the balance itself.
    """
    short = (F.col("total_rows") < 10) & (F.col("total_rows") > 0)
    valid = (F.size("warnings") <= 5) & (F.col("total_rows") >= 10)
    return summary.withColumn("is_valid", valid).withColumn(
        "warnings", F.when(short, F.concat("warnings", F.array(F.lit("table has fewer than ten rows")))).otherwise(F.col("warnings")))
