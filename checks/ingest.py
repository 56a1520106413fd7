"""Sources, column roles, quality and mapping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.fixtures import EVENTS, LINE_ORDER, R, CATALOGUE, catalogue, event_series, line_series, r, rounded, table
from tribospark.operators import mapping, quality, roles
from tribospark.operators.ordering import number_rows
from tribospark.session import materialise, scratch_root
from tribospark.sources import readers, samples

LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}
NUMERIC = [c for c, t in LINE_TYPES.items() if t in ("bigint", "int", "double")]
ORDER = ", ".join(LINE_ORDER)


def csv_scan(spark, d):
    path = f"{scratch_root(spark)}/csv-{uuid.uuid4().hex}"
    columns = ["event_id", "user_id", "event_type", "value"]
    table(spark, d, "events").select(*columns).write.option("header", True).csv(path)
    return readers.read_sensor_csv(spark, path, "event_id long, user_id long, event_type string, value double")


def csv_inferred(spark, d):
    path = f"{scratch_root(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, d, "supplier").write.option("header", True).csv(path)
    return readers.read_sensor_csv(spark, path).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def materials_default_cost(spark, d):
    return readers.materials(catalogue(spark, d).drop("cost_factor", "position")).select("material_name", "cost_factor", r("density").alias("density"))


def scores(spark, d):
    events = table(spark, d, "events")
    out = roles.column_scores(events, ["event_id"])
    return out.select("column", *[F.round(c, 6).alias(c) for c in ("time_score", "joint_score", "sensor_score")])


def _score_sql():
    parts = []
    kinds = {"event_id": ("i", 0), "ts": ("s", 1), "user_id": ("i", 2), "event_type": ("s", 3), "value": ("f", 4), "props": ("s", 5)}
    for name, (kind, place) in kinds.items():
        number = kind != "s"
        v = f"CAST({name} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
        parts.append(f"""SELECT {place} AS place, '{name}' AS "column", {number} AS num, {kind == 'f'} AS flt, count(*) AS nrows, count(v) AS n,
          count(DISTINCT u) AS uniq, avg(CASE WHEN st >= 0 THEN 1.0::DOUBLE WHEN st < 0 THEN 0 END) AS rising, avg(st) AS sm, stddev_samp(st) AS ss,
          stddev_samp(v) AS sd, min_by(v, event_id) AS f FROM (SELECT event_id, {v} AS v, CAST({name} AS VARCHAR) AS u,
          {v} - lag({v}) OVER (ORDER BY event_id) AS st FROM h)""")
    return f"""h AS (SELECT * FROM events), st AS ({' UNION ALL '.join(parts)}),
    scores AS (SELECT place, "column",
      round(CASE WHEN num THEN (CASE WHEN rising > 0.98 THEN 0.5 ELSE 0 END + CASE WHEN ss / (sm + 1e-12) < 0.1 THEN 0.3 ELSE 0 END
        + CASE WHEN f >= 0 THEN 0.1 ELSE 0 END)::DOUBLE ELSE 0 END, 6) AS time_score,
      round((CASE WHEN num THEN CASE WHEN uniq BETWEEN 1 AND 30 AND uniq < nrows * 0.01 THEN 0.5 ELSE 0 END
        WHEN uniq BETWEEN 1 AND 50 AND uniq / nrows < 0.05 THEN 0.8 WHEN uniq = 1 THEN 0.6 ELSE 0 END)::DOUBLE, 6) AS joint_score,
      round((CASE WHEN num AND n >= 10 THEN CASE WHEN rising < 0.9 THEN 0.3 ELSE 0 END + CASE WHEN sd > 1e-8 THEN 0.3 ELSE 0 END
        + CASE WHEN flt OR n < nrows OR uniq > 20 THEN 0.2 ELSE 0 END ELSE 0 END)::DOUBLE, 6) AS sensor_score FROM st)"""


def roles_inferred(spark, d):
    schema = roles.infer_schema(table(spark, d, "events"), ["event_id"])
    return schema.as_frame(spark).withColumn("confidence", r(F.lit(schema.confidence)))


def roles_overridden(spark, d):
    schema = roles.infer_schema(table(spark, d, "events"), ["event_id"])
    schema = roles.override_schema(schema, {"joint": "user_id", "sensors": {"temperature": ["value"]}})
    return schema.as_frame(spark)


ROLES_SQL = f"""WITH {_score_sql()}, jt AS (SELECT min(place) AS jp FROM scores WHERE joint_score > 0.5 AND "column" <> 'ts'),
  rl AS (SELECT "column", CASE WHEN "column" = 'ts' THEN 'timestamp' WHEN place = jp THEN 'joint' WHEN sensor_score > 0.5 THEN 'sensor' ELSE 'unmapped' END AS role
    FROM scores, jt)
  SELECT "column", role, CASE WHEN role = 'sensor' THEN 'unknown_signal' END AS modality, CASE WHEN role = 'sensor' THEN "column" END AS axis,
    (SELECT {R("least(count(*) FILTER (role <> 'unmapped') / count(*) + 0.2, 1)")} FROM rl) AS confidence FROM rl"""


OVERRIDDEN_SQL = ROLES_SQL[: ROLES_SQL.rindex("SELECT \"column\", role")] + """SELECT 'ts' AS "column", 'timestamp' AS role, NULL AS modality, NULL AS axis
  UNION ALL SELECT 'user_id', 'joint', NULL, NULL UNION ALL SELECT 'value', 'sensor', 'temperature', 'value'
  UNION ALL SELECT "column", role, CASE WHEN role = 'sensor' THEN 'unknown_signal' END, CASE WHEN role = 'sensor' THEN "column" END FROM rl WHERE role IN ('sensor', 'unmapped')"""


def duplicates(spark, d):
    return quality.duplicate_rows(table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


def profile(spark, d):
    out = quality.profile_columns(table(spark, d, "lineitem").select(*LINE_TYPES))
    out = out.drop("position", "total_rows")
    return rounded(out, ["min_val", "max_val", "mean_val", "std_val", "q1", "q3"])


def profile_parts(spark, d):
    """Facts of each column from sketches kept per return flag and then put together."""
    lines = table(spark, d, "lineitem").select(*LINE_TYPES)
    out = quality.merged_sketches(materialise(quality.column_sketches(lines, list(NUMERIC), F.col("l_returnflag"))))
    std = F.sqrt(F.col("m2") / (F.col("present") - 1))
    return out.select("column", F.col("n").alias("total_rows"), F.col("present").alias("present"), r("lo").alias("min_val"), r("hi").alias("max_val"),
                      r("mean").alias("mean_val"), r(std).alias("std_val"))


def profile_sketch(spark, d):
    """The sketch form: what is exact in it as it is, distinct counts and quartile ranks against the table within their errors."""
    lines = table(spark, d, "lineitem").select(*LINE_TYPES)
    out = quality.profile_columns(lines, exact=False).select("column", "missing_count", "unique_count", r("min_val").alias("min_val"), r("max_val").alias("max_val"), r("mean_val").alias("mean_val"), "q1", "q3")
    true = lines.agg(*[F.count_distinct(c).alias(c) for c in LINE_TYPES]).unpivot([], list(LINE_TYPES), "column", "_distinct")
    marks = {row["column"]: (row["q1"], row["q3"]) for row in out.collect()}
    ranks = [F.struct(F.lit(c).alias("column"), *[F.avg((F.col(c) <= q).cast("double")).alias(n) for n, q in zip(("_r1", "_r3"), marks[c])],
                      *[F.avg((F.col(c) < q).cast("double")).alias(n) for n, q in zip(("_l1", "_l3"), marks[c])]) for c in NUMERIC]
    ranks = lines.agg(F.array(*ranks).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    both = out.join(true, "column").join(ranks, "column", "left")
    near = (F.col("_l1") <= 0.251) & (F.col("_r1") >= 0.249) & (F.col("_l3") <= 0.751) & (F.col("_r3") >= 0.749)
    return both.select("column", "missing_count", "min_val", "max_val", "mean_val",
                       (F.abs(F.col("unique_count") - F.col("_distinct")) <= 0.08 * F.col("_distinct") + 1).alias("distinct_near"), F.coalesce(near, F.lit(True)).alias("quartiles_near"))


def _sketch_sql():
    parts = []
    for c in LINE_TYPES:
        stats = ", ".join(R(f"{f}(CAST({c} AS DOUBLE))") for f in ("min", "max", "avg")) if c in NUMERIC else ", ".join(["CAST(NULL AS DOUBLE)"] * 3)
        parts.append(f"SELECT '{c}', count(*) - count({c}), {stats}, true, true FROM lineitem")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS p(\"column\", missing_count, min_val, max_val, mean_val, distinct_near, quartiles_near)"


def _profile_sql():
    parts = []
    for c, kind in LINE_TYPES.items():
        if c in NUMERIC:
            v = f"CAST({c} AS DOUBLE)"
            stats = (f"{R(f'min({v})')}, {R(f'max({v})')}, {R(f'avg({v})')}, {R(f'stddev_samp({v})')}, {R(f'quantile_cont({v}, 0.25)')}, "
                     f"{R(f'quantile_cont({v}, 0.75)')}, (SELECT count(*) FROM lineitem, (SELECT quantile_cont({v}, 0.25) AS a, quantile_cont({v}, 0.75) AS b "
                     f"FROM lineitem) WHERE b - a >= 1e-12 AND ({v} < a - 3 * (b - a) OR {v} > b + 3 * (b - a)))")
        else:
            stats = ", ".join(["CAST(NULL AS DOUBLE)"] * 6) + ", CAST(0 AS BIGINT)"
        parts.append(f"SELECT '{c}', '{kind}', count(*) - count({c}), round((count(*) - count({c})) / count(*) * 100, 2), count(DISTINCT {c}), {stats} FROM lineitem")
    names = '"column", dtype, missing_count, missing_pct, unique_count, min_val, max_val, mean_val, std_val, q1, q3, outlier_count'
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS p({names})"


def outliers(spark, d):
    out = quality.profile_columns(table(spark, d, "events"))
    return out.select("column", "outlier_count")


def null_columns(spark, d):
    events = table(spark, d, "events").select(
        "event_id", F.lit(None).cast("double").alias("gone"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("sparse"), "value")
    out = quality.column_warnings(quality.profile_columns(events))
    return out.select("column", "fully_null", "missing_pct")


def steps(spark, d, by=None, order=("user_id", "event_id")):
    return quality.time_steps(table(spark, d, "events"), "ts", list(order), by)


def time_facts(spark, d):
    out = quality.sampling_summary(steps(spark, d))
    return out.withColumns({"sampling_rate_hz": r("sampling_rate_hz"), "sampling_rate_std": r(F.round("sampling_rate_std", 1))})


def time_facts_by_joint(spark, d):
    out = quality.sampling_summary(steps(spark, d, ["event_type"], ["event_id"]), ["event_type"])
    return out.select("event_type", "reversals", "non_monotonic", "timestamp_gaps", r("sampling_rate_hz").alias("sampling_rate_hz"))


TIME_SQL = f"""WITH o AS (SELECT epoch_us(ts) / 1e6 AS t, row_number() OVER (ORDER BY user_id, event_id) AS i FROM events),
  s AS (SELECT *, t - lag(t) OVER (ORDER BY i) AS st FROM o), md AS (SELECT quantile_cont(st, 0.5) AS md FROM s)
  SELECT count(*) FILTER (st < 0) AS reversals, count(*) FILTER (st < 0) > 0 AS non_monotonic,
    CASE WHEN any_value(md) > 0 THEN {R('round(1 / any_value(md), 2)')} END AS sampling_rate_hz,
    CASE WHEN any_value(md) > 0 THEN {R('round(round(stddev_samp(st), 6), 1)')} END AS sampling_rate_std,
    count(*) FILTER (md > 0 AND st > 3 * md) AS timestamp_gaps FROM s, md"""
TIME_BY_SQL = f"""WITH s AS (SELECT event_type, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type ORDER BY event_id) AS st FROM events),
  md AS (SELECT event_type, quantile_cont(st, 0.5) AS md FROM s GROUP BY event_type)
  SELECT event_type, count(*) FILTER (st < 0) AS reversals, count(*) FILTER (st < 0) > 0 AS non_monotonic,
    count(*) FILTER (st > 3 * md) AS timestamp_gaps, {R('round(1 / any_value(md), 2)')} AS sampling_rate_hz FROM s JOIN md USING (event_type) GROUP BY event_type"""


def joints(spark, d):
    return quality.joint_names(table(spark, d, "events"), "user_id")


def whole_report(spark, d):
    schema = roles.infer_schema(table(spark, d, "events"), ["event_id"])
    out = quality.validate_dataset(table(spark, d, "events"), schema, ["user_id", "event_id"]).summary
    return out.select("total_rows", F.col("total_columns").cast("long").alias("total_columns"), "duplicate_rows", F.col("joint_count").cast("long").alias("joint_count"),
                      F.size("warnings").cast("long").alias("n_warnings"), "is_valid", "non_monotonic", "reversals")


REPORT_SQL = """WITH s AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY user_id, event_id) AS st FROM events),
  k AS (SELECT count(*) FILTER (st < 0) AS rev, quantile_cont(st, 0.5) AS md FROM s),
  g AS (SELECT count(*) FILTER (md > 0 AND st > 3 * md) AS gaps FROM s, k), u AS (SELECT count(*) AS u FROM (SELECT DISTINCT * FROM events))
  SELECT count(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns, count(*) - any_value(u) AS duplicate_rows, count(DISTINCT event_type) AS joint_count,
    CAST(CASE WHEN any_value(rev) > 0 THEN 1 ELSE 0 END + CASE WHEN any_value(gaps) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_warnings, count(*) >= 10 AS is_valid,
    any_value(rev) > 0 AS non_monotonic, any_value(rev) AS reversals FROM events, k, g, u"""


def epoch_units(spark, d):
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    units = F.array(*[F.struct(F.lit(n).alias("unit"), (us * k).cast("double").alias("v")) for n, k in (("s", 1e-6), ("ms", 1e-3), ("us", 1.0), ("ns", 1e3))])
    rows = table(spark, d, "orders").select("o_orderpriority", F.explode(units).alias("u"))
    return rows.groupBy("o_orderpriority", "u.unit").agg(quality.epoch_divisor(F.max("u.v")).alias("divisor"))


EPOCH_SQL = """WITH u AS (SELECT o_orderpriority, unit, max(epoch_us(o_orderdate) * k) AS v FROM orders,
  (VALUES ('s', 1e-6::DOUBLE), ('ms', 1e-3::DOUBLE), ('us', 1.0::DOUBLE), ('ns', 1e3::DOUBLE)) AS k(unit, k) GROUP BY ALL)
  SELECT o_orderpriority, unit, CASE WHEN v > 1e17 THEN 1e9 WHEN v > 1e14 THEN 1e6 WHEN v > 1e11 THEN 1e3 ELSE 1 END::DOUBLE AS divisor FROM u"""


def joint_time(spark, d):
    return event_series(spark, d).rows.select("joint_id", "seq", r("t").alias("t"))


def numeric_text(spark, d):
    """A text channel: only clicks carry a number, so the other joints have no such signal."""
    text = F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k")).otherwise("n/a")
    events = table(spark, d, "events").withColumn("load", text)
    schema = roles.override_schema(roles.DatasetSchema("ts", "event_type"), {"sensors": {"force": ["load"], "vibration": ["value"]}})
    mapped = mapping.map_dataset(events, schema, ["event_id"])
    return mapping.to_long(mapped).groupBy("joint_id", "signal", "modality").agg(F.count("value").alias("n"), r(F.sum("value")).alias("total"))


NUMERIC_TEXT_SQL = f"""SELECT event_type AS joint_id, 'force_load' AS signal, 'force' AS modality, count(*) AS n,
    {R("sum(CAST(json_extract_string(props, '$.k') AS DOUBLE))")} AS total FROM events WHERE event_type = 'click' GROUP BY event_type
  UNION ALL SELECT event_type, 'vibration_value', 'vibration', count(*), {R('sum(value)')} FROM events GROUP BY event_type"""


def numbered_lines(spark, d):
    return number_rows(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], LINE_ORDER).select("l_returnflag", "l_linestatus", *LINE_ORDER[1:], "seq")


def numbered_lines_by_range(spark, d):
    rows = number_rows(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], LINE_ORDER, max_window_rows=1, range_rows=20_000)
    return rows.select("l_returnflag", "l_linestatus", *LINE_ORDER[1:], "seq")


NUMBER_SQL = f"""SELECT l_returnflag, l_linestatus, {', '.join(LINE_ORDER[1:])},
  row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {ORDER}) - 1 AS seq FROM lineitem"""


def rate(spark, d):
    return quality.sampling_rate(table(spark, d, "events"), "ts", ["event_id"]).select(r("sampling_rate_hz").alias("sampling_rate_hz"))


def long_signals(spark, d):
    return mapping.to_long(line_series(spark, d)).select("joint_id", "seq", "signal", "modality", r("value").alias("value"))


LONG_SQL = f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {ORDER}) - 1 AS seq FROM lineitem)
  SELECT l_returnflag || l_linestatus AS joint_id, seq, signal, 'accelerometer' AS modality, {R('value')} AS value FROM l,
    LATERAL (VALUES ('accelerometer_x', l_quantity), ('accelerometer_y', l_extendedprice / 1000), ('accelerometer_z', l_discount * 100)) AS a(signal, value)"""


def six_segments(spark, d):
    whole = event_series(spark, d, joint=F.lit("a"))
    split = mapping.with_synthetic_joints(whole)
    return split.rows.select("joint_id", "seq", r("vibration").alias("vibration"))


SIX = """CASE least(i // (n // 6), 5) WHEN 0 THEN 'base' WHEN 1 THEN 'shoulder' WHEN 2 THEN 'elbow' WHEN 3 THEN 'wrist_1' WHEN 4 THEN 'wrist_2' ELSE 'wrist_3' END"""
SIX_SQL = f"""WITH o AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
  SELECT {SIX} AS joint_id, i - least(i // (n // 6), 5) * (n // 6) AS seq, {R('value')} AS vibration FROM o"""


def magnetometer(spark, d):
    e = table(spark, d, "events")
    raw = e.select(F.col("event_type").alias("name"), F.col("ts").alias("time"), F.col("value").alias("magX"), F.col("user_id").cast("double").alias("magY"),
                   F.get_json_object("props", "$.k").cast("double").alias("magZ"), "event_id")
    return raw


def magnetometer_rows(spark, d):
    rows = mapping.magnetometer_series(magnetometer(spark, d), ["event_id"])
    return rows.select("joint_id", "seq", r("mx").alias("mx"), r("my").alias("my"), r("mz").alias("mz"))


def magnetometer_split(spark, d):
    one = magnetometer(spark, d).withColumn("name", F.lit("IMU"))
    return mapping.magnetometer_series(one, ["event_id"]).groupBy("joint_id").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), r(F.sum("mx")).alias("mx"))


MAG_SQL = f"""SELECT event_type AS joint_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq, {R('value')} AS mx,
  {R('user_id')} AS my, {R("CAST(json_extract_string(props, '$.k') AS DOUBLE)")} AS mz FROM events"""
MAG_SPLIT_SQL = f"""WITH o AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
  q AS (SELECT {SIX} AS joint_id, i - least(i // (n // 6), 5) * (n // 6) AS seq, value FROM o)
  SELECT joint_id, count(*) AS n, max(seq) AS last_seq, {R('sum(value)')} AS mx FROM q GROUP BY joint_id"""


def summary(spark, d):
    out = mapping.dataset_summary(line_series(spark, d))
    return out.select("joint_id", "samples", F.array_join("modalities", ",").alias("modalities"))


KEYED = {"A3": "md5('42:' || CAST(o_orderkey AS VARCHAR))"}

QUERIES = {
    "scan_csv_explicit_schema": (csv_scan, "SELECT event_id, user_id, event_type, value FROM events"),
    "scan_csv_inferred_schema": (csv_inferred, "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"),
    "scan_parquet": (lambda s, d: readers.read_sensor_table(s, f"{d}/part.parquet").select("p_partkey", "p_size", "p_retailprice"),
                     "SELECT p_partkey, p_size, p_retailprice FROM part"),
    "materials_default_cost": (materials_default_cost, f"WITH {CATALOGUE} SELECT material_name, 3 AS cost_factor, {R('density')} AS density FROM cat"),
    "sample_row_cap": (lambda s, d: samples.cap_rows(table(s, d, "orders"), ["o_orderkey"], 5000).select("o_orderkey", "o_custkey"),
                       f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {KEYED['A3']}, o_orderkey LIMIT 5000"),
    "sample_head": (lambda s, d: samples.head_rows(table(s, d, "lineitem"), LINE_ORDER).select(*LINE_ORDER[1:]),
                    f"SELECT {', '.join(LINE_ORDER[1:])} FROM lineitem ORDER BY {ORDER} LIMIT 2000"),
    "sample_discovery": (lambda s, d: samples.discovery_rows(event_series(s, d).rows).select("joint_id", "seq", r("vibration").alias("v")),
                         f"WITH {EVENTS} SELECT joint_id, seq, {R('v')} AS v FROM s WHERE joint_id = (SELECT min(joint_id) FROM s) AND seq < 500"),
    "roles_column_scores": (scores, f'WITH {_score_sql()} SELECT "column", time_score, joint_score, sensor_score FROM scores'),
    "roles_inferred": (roles_inferred, ROLES_SQL),
    "roles_overridden": (roles_overridden, OVERRIDDEN_SQL),
    "quality_duplicates": (duplicates, """SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority
        FROM orders)) AS duplicate_rows FROM orders"""),
    "quality_column_profile": (profile, _profile_sql()),
    "quality_column_profile_parts": (profile_parts, " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS total_rows, count({c}) AS present, {R(f'min({c})')} AS min_val, {R(f'max({c})')} AS max_val, "
        f"{R(f'avg({c})')} AS mean_val, {R(f'stddev_samp({c})')} AS std_val FROM lineitem" for c in NUMERIC)),
    "quality_column_profile_sketch": (profile_sketch, _sketch_sql()),
    "quality_outliers": (outliers, "SELECT c AS \"column\", CAST(CASE WHEN c = 'value' THEN (SELECT count(*) FROM events, (SELECT quantile_cont(value, 0.25) AS a, "
                         "quantile_cont(value, 0.75) AS b FROM events) WHERE value < a - 3 * (b - a) OR value > b + 3 * (b - a)) ELSE 0 END AS BIGINT) AS outlier_count "
                         "FROM (VALUES ('event_id'), ('ts'), ('user_id'), ('event_type'), ('value'), ('props')) AS v(c)"),
    "quality_null_columns": (null_columns, """SELECT 'gone' AS "column", true AS fully_null, 100.0::DOUBLE AS missing_pct FROM (SELECT count(*) FROM events)
        UNION ALL SELECT 'sparse', false, round(count(*) FILTER (event_type <> 'click') / count(*) * 100, 2) FROM events"""),
    "quality_time_facts": (time_facts, TIME_SQL),
    "quality_time_facts_by_joint": (time_facts_by_joint, TIME_BY_SQL),
    "quality_joint_names": (joints, "SELECT DISTINCT CAST(user_id AS VARCHAR) AS joint_id FROM events"),
    "quality_report_summary": (whole_report, REPORT_SQL),
    "map_epoch_units": (epoch_units, EPOCH_SQL),
    "map_joint_time": (joint_time, f"WITH {EVENTS} SELECT joint_id, seq, {R('t')} AS t FROM s"),
    "map_numeric_text": (numeric_text, NUMERIC_TEXT_SQL),
    "map_row_numbers": (numbered_lines, NUMBER_SQL),
    "map_row_numbers_by_range": (numbered_lines_by_range, NUMBER_SQL),
    "map_sampling_rate": (rate, f"WITH s AS (SELECT epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (ORDER BY event_id) AS st FROM events) "
                          f"SELECT {R('round(1 / quantile_cont(st, 0.5), 2)')} AS sampling_rate_hz FROM s"),
    "map_long_signals": (long_signals, LONG_SQL),
    "map_six_segments": (six_segments, SIX_SQL),
    "map_magnetometer_rows": (magnetometer_rows, MAG_SQL),
    "map_magnetometer_split": (magnetometer_split, MAG_SPLIT_SQL),
    "map_dataset_summary": (summary, "SELECT l_returnflag || l_linestatus AS joint_id, count(*) AS samples, 'accelerometer' AS modalities FROM lineitem GROUP BY ALL"),
}
