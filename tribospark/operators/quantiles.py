"""Exact linear-interpolation quantiles that never gather a large group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribospark.session import materialise

MAX_GROUP_VALUES = 1_000_000
BUCKETS = 8_192
LINEAR_SPAN = 1.0


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    name: str = "quantiles",
    weight: str | None = None,
    max_group_values: int = MAX_GROUP_VALUES,
) -> DataFrame:
    """One row per group with an array of quantiles of ``value`` (nulls and NaN are ignored).

    Groups of at most ``max_group_values`` rows use the built-in exact ``percentile``, whose state is
    then bounded. A larger group is narrowed by counting: its rows are counted in buckets
    between the current bounds, and the bucket that holds the wanted rank becomes the new bounds,
    until that bucket holds a single value. Only bucket counts are shuffled. Buckets have equal width on
    a logarithmic scale, infinities included, until the bounds are within a factor of two, and on the plain
    scale from there: one pass and at most five more, as a double has 53 bits.
    """
    weighted = F.col(weight) if weight else F.lit(1)
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys, F.col(value).cast("double").alias("_v"), weighted.cast("long").alias("_w")
    )
    small = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]), F.col("_w")).alias(name)
    spans = clean.groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    big = materialise(spans.filter(F.col("_rows") > max_group_values))
    if big.isEmpty():
        return clean.groupBy(*keys).agg(small)
    if not keys:
        return _narrowed(clean, big, keys, probs, name)
    on = _null_safe(keys)
    rest = clean.alias("a").join(big.alias("b"), on, "left_anti").groupBy(*keys).agg(small)
    return rest.unionByName(_narrowed(clean, big, keys, probs, name))


def _null_safe(keys: list[str], left: str = "a", right: str = "b") -> Column:
    terms = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda x, y: x & y, terms, F.lit(True))


def _narrowed(clean: DataFrame, big: DataFrame, keys: list[str], probs: list[float], name: str) -> DataFrame:
    # Every probability needs the two order statistics around (n - 1) * p.
    position = F.col("_p") * (F.col("_n") - 1)
    targets = (
        big.select(*keys, "_n", "_lo", "_hi", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))))
        .select(*keys, "_rank", F.lit(0).cast("long").alias("_below"), "_lo", "_hi")
        .distinct()
    )
    found = None
    open_targets = materialise(targets)
    while True:
        done = open_targets.filter(F.col("_lo") == F.col("_hi")).select(*keys, "_rank", F.col("_lo").alias("_value"))
        found = done if found is None else found.unionByName(done)
        open_targets = open_targets.filter(F.col("_lo") < F.col("_hi"))
        if open_targets.isEmpty():
            break
        open_targets = materialise(_next_bounds(clean, open_targets, keys))
    found = materialise(found)
    wanted = big.select(
        *keys, "_n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p")
    ).withColumn("_pos", F.col("_p") * (F.col("_n") - 1))
    low, high = found.withColumnRenamed("_value", "_a"), found.withColumnRenamed("_value", "_b")
    left = wanted.alias("a").join(low.alias("b"), _null_safe(keys) & (F.floor("a._pos") == F.col("b._rank")))
    left = left.select(*[F.col(f"a.{k}") for k in keys], "_i", "_pos", "_a")
    both = left.alias("a").join(high.alias("b"), _null_safe(keys) & (F.ceil("a._pos") == F.col("b._rank")))
    part = F.col("a._pos") - F.floor("a._pos")
    both = both.select(*[F.col(f"a.{k}") for k in keys], "_i", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias("_q"))
    ordered = F.sort_array(F.collect_list(F.struct("_i", "_q")))
    return both.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_q"]).alias(name))


def _scale(v: Column) -> Column:
    """Rises with v, by one for each doubling: the sign times log2 |v| + 1076; zero for zero, 2200 for infinity."""
    size = F.when(F.abs(v) == float("inf"), 2200.0).when(v == 0, 0.0).otherwise(F.log2(F.abs(v)) + 1076.0)
    return F.when(v < 0, -size).otherwise(size)


def _next_bounds(clean: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    spans = targets.select(*keys, "_lo", "_hi", "_below").distinct()
    # Halved terms keep the width finite for bounds near the largest double.
    plain = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    low, high = _scale(F.col("_lo")), _scale(F.col("_hi"))
    share = F.when(high - low <= LINEAR_SPAN, plain).otherwise((_scale(F.col("_v")) - low) / (high - low))
    inside = clean.alias("a").join(
        spans.alias("b"), _null_safe(keys) & F.col("a._v").between(F.col("b._lo"), F.col("b._hi"))
    )
    buckets = (
        inside.select(*[F.col(f"a.{k}") for k in keys], "_lo", "_hi", "_below", "_v", "_w")
        .withColumn("_bucket", F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)))
        .groupBy(*keys, "_lo", "_hi", "_below", "_bucket")
        .agg(F.sum("_w").alias("_c"), F.min("_v").alias("_new_lo"), F.max("_v").alias("_new_hi"))
    )
    run = Window.partitionBy(*keys, "_lo", "_hi", "_below").orderBy("_bucket")
    buckets = buckets.withColumn("_end", F.col("_below") + F.sum("_c").over(run))
    buckets = buckets.withColumn("_start", F.col("_end") - F.col("_c"))
    hit = (
        _null_safe(keys)
        & (F.col("a._lo") == F.col("b._lo"))
        & (F.col("a._hi") == F.col("b._hi"))
        & (F.col("a._below") == F.col("b._below"))
        & (F.col("a._rank") >= F.col("b._start"))
        & (F.col("a._rank") < F.col("b._end"))
    )
    return targets.alias("a").join(buckets.alias("b"), hit).select(
        *[F.col(f"a.{k}") for k in keys],
        "a._rank",
        F.col("b._start").alias("_below"),
        F.col("b._new_lo").alias("_lo"),
        F.col("b._new_hi").alias("_hi"),
    )
